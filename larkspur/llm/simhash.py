"""SimHash fingerprints of documents, and the search for near ones by permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, id_text, read, shown_id

BITS = 128
#: Every 16th bit of a hash is a lane of one long; a lane holds the votes of one bit for up to SEGMENT terms.
LANES, SEGMENT = 4, 32_767
WORD_BREAK = r"[\x20\x09-\x0D]+"


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with fp0 and fp1, the two halves of the 128-bit SimHash of ``text``.

    Terms are pairs of neighbouring words (lower case) and the last word alone; a term weighs as often as it
    occurs. Each term's hash votes on every bit, and a bit is set when more than half of the votes are for it. Votes
    of four bits share one long, so that 32 sums a document hold all 128, combined before the only shuffle,
    which moves one row a document and task. A text without words has all bits clear.
    """
    words = F.filter(F.split(F.lower(F.col(text)), WORD_BREAK), lambda w: w != "")
    many = texts.select(*keys, words.alias("w"))
    pairs = F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b")))
    terms = many.select(*keys, pairs.alias("at", "pair"))
    here = F.col("pair").isNotNull()
    hashes = [F.when(here, F.xxhash64(F.lit(s), F.col("pair.a"), F.col("pair.b"))) for s in (1, 2)]
    terms = terms.select(*keys, F.floor(F.coalesce("at", F.lit(0)) / SEGMENT).alias("segment"), hashes[0].alias("h0"), hashes[1].alias("h1"))
    mask = sum(1 << (16 * i) for i in range(LANES))
    sums = [F.sum(F.expr(f"shiftrightunsigned(h{h}, {s}) & {mask}L")).alias(f"s{h}_{s}") for h in (0, 1) for s in range(16)]
    voted = terms.groupBy(*keys, "segment").agg(F.count("h0").alias("n"), *sums)

    def lane(h: int, bit: int) -> Column:
        return F.expr(f"shiftrightunsigned(s{h}_{bit % 16}, {bit // 16 * 16}) & 65535L")

    # one segment is the rule; longer texts add up their segments' votes bit by bit
    votes = voted.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(lane(h, b)).alias(f"v{h}_{b}") for h in (0, 1) for b in range(64)))

    def half(h: int) -> Column:
        out = F.lit(0).cast("long")
        for b in range(64):
            out = out.bitwiseOR(F.when(F.col(f"v{h}_{b}") * 2 > F.col("n"), F.lit(-(2**63) if b == 63 else 1 << b)).otherwise(F.lit(0).cast("long")))
        return out

    return votes.select(*keys, half(0).alias("fp0"), half(1).alias("fp1"))


def hex_of(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))


def likeness(d: Column) -> Column:
    """1 for equal fingerprints, 0 from as many differing bits as unrelated ones have: 1 - 2 d / BITS."""
    return F.round(F.greatest(F.lit(0.0), 1 - 2 * d / BITS), 6)


def blocks_of(blocks: int) -> list[Column]:
    """The 128 bits of fp0, fp1 cut into that many runs of neighbouring bits, each as a long."""
    ends = [BITS * i // blocks for i in range(blocks + 1)]

    def bits(a: int, b: int) -> Column:  # within one half
        part = F.shiftrightunsigned(F.col(f"fp{a // 64}"), a % 64)
        return part if b - a == 64 else part.bitwiseAND(F.lit((1 << (b - a)) - 1))

    def block(a: int, b: int) -> Column:
        if a // 64 == (b - 1) // 64:
            return bits(a, b)
        return F.shiftleft(bits(64, b), 64 - a).bitwiseOR(bits(a, 64))

    return [block(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def neighbours(queries: DataFrame, classes: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """(q0, q1, fp0, fp1, distance): all fingerprints of ``classes`` within ``radius`` bits of those of ``queries``.

    Both have distinct fp0, fp1, so a group of copies is one row. The 128 bits are cut into blocks; fingerprints
    within the radius agree on at least blocks - radius of them, so one table for each choice of that many blocks
    finds them all. With the standard values that is four tables with keys of 32 bits.
    """
    if not radius < blocks <= BITS // 2:
        raise ValueError("there must be more blocks than bits in the radius")
    parts = blocks_of(blocks)
    choices = list(combinations(range(blocks), blocks - radius))
    tables = F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.array(*(parts[i] for i in c)).alias("key")) for k, c in enumerate(choices))))
    held = classes.select("fp0", "fp1", tables.alias("k"))
    asked = queries.select("fp0", "fp1", tables.alias("k")).select(F.col("fp0").alias("q0"), F.col("fp1").alias("q1"), "k")
    d = distance(("q0", "q1"), ("fp0", "fp1"))
    return asked.join(held, "k").where(d <= radius).select("q0", "q1", "fp0", "fp1", d.alias("distance")).distinct()


def next_documents(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, n_chars, times, next_doc, next_tag) for each distinct (doc_id, tag); behind the last comes the first.

    Only ids, tags and sizes are dealt by ranges and sorted; each range finds the next document within itself, its
    last one the head of the next range. The number of ranges is that of shuffle partitions.
    """
    ids = rows.groupBy("doc_id", "tag").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("times"))
    ranged = cut(ids.repartitionByRange("doc_id", "tag").select("*", F.spark_partition_id().alias("range")))
    here = F.struct("doc_id", "tag")
    heads = ranged.groupBy("range").agg(F.min(here).alias("head"))  # a row a range
    over = Window.orderBy("range")
    first = F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("range", F.coalesce(F.lead("head").over(over), first).alias("after"))
    own = F.lead(here).over(Window.partitionBy("range").orderBy("doc_id", "tag"))
    chain = ranged.withColumn("own", own).join(F.broadcast(heads), "range").withColumn("next", F.coalesce("own", "after"))
    return chain.select("doc_id", "tag", "n_chars", "times", F.col("next.doc_id").alias("next_doc"), F.col("next.tag").alias("next_tag"))


def edited_pairs(rows: DataFrame, chain: DataFrame) -> DataFrame:
    """doc_id, tag, text, edited: the last quarter replaced by the beginning of the next document.

    Each document lends the document before it as many characters as that needs, so whole texts are shuffled once
    and what is lent once more.
    """
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    asked = chain.select(F.col("next_doc").alias("doc_id"), F.col("next_tag").alias("tag"), F.col("doc_id").alias("to_doc"), F.col("tag").alias("to_tag"), quarter.alias("quarter"))
    lent = rows.join(asked.hint("merge"), ["doc_id", "tag"]).select(F.col("to_doc").alias("doc_id"), F.col("to_tag").alias("tag"), "quarter", F.substring(F.col("text"), F.lit(1), F.col("quarter")).alias("lent"))
    lent = lent.groupBy("doc_id", "tag", "quarter").agg(F.max("lent").alias("lent"))  # of rows that repeat, one
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("quarter")), F.col("lent"))
    return rows.join(lent.hint("merge"), ["doc_id", "tag"]).select("doc_id", "tag", "text", edited.alias("edited"))


def simhash_report(docs: DataFrame, asked: Column, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_near, near_least.

    Where ``asked`` holds of the doc_id, n_near is how many other rows have a fingerprint within ``radius`` bits and near_least
    the smallest id among them and itself (see ``neighbours``); elsewhere both are null.

    Null text counts as empty. The next document is the one with the next larger id; rows that repeat an id come
    in the order of a hash of their texts, and rows that repeat both are one document with a row for each. A single
    document is its own next. A null id sorts first, is shown as null and is not asked for. An empty table gives an
    empty result.
    """
    rows = id_text(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    chain = cut(next_documents(rows))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))
    keys = ["doc_id", "tag", "edited_sha256"]
    made = edited_pairs(rows, chain).select("doc_id", "tag", F.sha2("edited", 256).alias("edited_sha256"), F.explode(both).alias("t"))
    fps = fingerprints(made.select(*keys, "t.which", "t.text"), [*keys, "which"])
    pick = lambda w, c: F.max(F.when(F.col("which") == w, F.col(c)))
    found = cut(fps.groupBy(*keys).agg(*(pick(w, f"fp{h}").alias(f"{'fe'[w]}p{h}") for w in (0, 1) for h in (0, 1))))
    nexts = found.select(F.col("doc_id").alias("next_doc"), F.col("tag").alias("next_tag"), F.col("fp0").alias("n0"), F.col("fp1").alias("n1"))
    whole = found.join(chain, ["doc_id", "tag"]).join(nexts, ["next_doc", "next_tag"])
    whole = whole.withColumn("asked", F.coalesce(asked & (F.col("doc_id") != NULL_ID), F.lit(False)))
    classes = whole.groupBy("fp0", "fp1").agg(F.sum("times").alias("n"), F.min("doc_id").alias("least"), F.max("asked").alias("asked"))
    near = neighbours(classes.where("asked"), classes, radius, radius + 1).join(classes, ["fp0", "fp1"])
    near = near.groupBy("q0", "q1").agg((F.sum("n") - 1).alias("n_near"), F.min("least").alias("near_least")).withColumnsRenamed({"q0": "fp0", "q1": "fp1"})
    none = whole.where("NOT asked").withColumns({c: F.lit(None).cast("long") for c in ("n_near", "near_least")})
    out = none.unionByName(whole.where("asked").join(near, ["fp0", "fp1"]))
    return out.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select(
        shown_id(), "n_chars", "edited_sha256", hex_of("fp0", "fp1").alias("fingerprint"), hex_of("ep0", "ep1").alias("edited_fingerprint"),
        likeness(distance(("fp0", "fp1"), ("ep0", "ep1"))).alias("near_edited"), likeness(distance(("fp0", "fp1"), ("n0", "n1"))).alias("near_next"),
        "n_near", shown_id("near_least"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(read(spark, sf_dir, "documents"), asked=F.col("doc_id") % 50 == 0)
