"""Joins of nearly equal strings: q-grams that a pair must share find it, the distance itself decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Counters of a sketch that tells rare grams from common ones. It orders the grams and never decides a pair.
SLOTS = 1 << 16
#: Characters before and after a text, so that its first and last characters have as many grams as others.
BEFORE, AFTER = "\u0001", "\u0002"


def padded_grams(text: Column, q: int) -> Column:
    """The length + q - 1 grams of ``q`` characters of a padded text; one edit changes ``q`` of them at most."""
    full = F.concat(F.lit(BEFORE * (q - 1)), text, F.lit(AFTER * (q - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(text) + q - 1), lambda i: F.substring(full, i, F.lit(q)))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's words in lower case, each word with two spaces before it and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def _strings(left: DataFrame, right: DataFrame, by: list[str], left_text: str, right_text: str) -> DataFrame:
    """(sid, *by, text, is_left, is_right), written: the distinct strings of both sides."""
    side = lambda df, text, lefts: df.select(*by, F.col(text).alias("text"), F.lit(lefts).alias("l"))
    both = side(left, left_text, True).unionByName(side(right, right_text, False)).where("text IS NOT NULL")
    each = both.groupBy(*by, "text").agg(F.bool_or("l").alias("is_left"), F.bool_or(~F.col("l")).alias("is_right"))
    return written(each.withColumn("sid", F.monotonically_increasing_id()))


def _slot(g: Column) -> Column:
    return F.pmod(F.xxhash64(g["gram"], g["nth"]), F.lit(SLOTS)).cast("int")


def _sketch(rows: DataFrame) -> bytes:
    """A byte for each slot: the logarithm of how many grams of the arrays ``g`` are in it. It comes from SLOTS rows at most."""
    common = rows.select(F.explode("g").alias("g")).groupBy(_slot(F.col("g")).alias("slot")).agg(F.count("*").alias("seen")).toArrow()
    counts = np.zeros(SLOTS)
    counts[common.column("slot").to_numpy()] = common.column("seen").to_numpy()
    return np.minimum(8 * np.log2(counts + 1), 255).astype(np.uint8).tobytes()


def _prefixes(strings: DataFrame, grams: Column, most: Column, by: list[str], repeated: bool) -> DataFrame:
    """The ``most`` rarest grams of each string: sid, *by, size, gram, nth. With ``repeated`` a gram that stands twice is two.

    Grams are numbered and ranked within their string's row, so no task holds or sorts the grams of a table."""
    keep = ["sid", *by, "is_left", "is_right"]
    rows = strings.select(*keep, most.cast("int").alias("_most"), F.length("text").alias("length"), F.sort_array(grams).alias("_grams"))
    nth = lambda g, i: i + 2 - F.array_position("_grams", g).cast("int") if repeated else F.lit(1)
    rows = written(rows.select(*keep, "_most", "length", F.transform("_grams", lambda g, i: F.struct(g.alias("gram"), nth(g, i).alias("nth"))).alias("g")))
    sketch = F.lit(_sketch(rows))
    ranked = F.sort_array(F.transform("g", lambda g: F.struct(F.substring(sketch, _slot(g) + 1, F.lit(1)).alias("seen"), g["gram"].alias("gram"), g["nth"].alias("nth"))))
    first = rows.select(*keep, "length", F.size("g").alias("size"), F.explode(F.slice(ranked, F.lit(1), F.col("_most"))).alias("g"))
    return written(first.select(*keep, "length", "size", "g.gram", "g.nth"))


def _candidates(prefixes: DataFrame, by: list[str], near: str) -> DataFrame:
    """(l, r): strings of both sides that share a gram of their prefixes and satisfy ``near`` on their sizes."""
    on = [*by, "gram", "nth"]
    a = prefixes.where("is_left").select(*on, F.col("sid").alias("l"), F.col("length").alias("l_length"), F.col("size").alias("l_size"))
    b = prefixes.where("is_right").select(*on, F.col("sid").alias("r"), F.col("length").alias("r_length"), F.col("size").alias("r_size"))
    return a.join(b, on).where(near).select("l", "r").distinct()


def _told(pairs: DataFrame, strings: DataFrame, by: list[str]) -> DataFrame:
    a = strings.select(F.col("sid").alias("l"), *by, F.col("text").alias("left_text"))
    b = strings.select(F.col("sid").alias("r"), F.col("text").alias("right_text"))
    return pairs.join(a, "l").join(b, "r")


def edit_pairs(left: DataFrame, right: DataFrame, threshold: float, by: list[str], left_text: str = "text", right_text: str = "text") -> DataFrame:
    """(*by, left_text, right_text, similarity): the distinct strings of both sides, equal in ``by``, with 1 - distance / length of the longer
    from ``threshold`` (0.5 at least) on; the distance is Levenshtein's (F11, F12, V11).

    Two strings of up to L characters may be floor((1 - threshold) * L) edits apart, and an edit changes q grams at most. So of a string's
    grams, the rarest first, one of that many times q, plus one, is also one of its partner's: only such strings of fitting
    lengths are compared, by a distance that stops beyond the limit. No pair is lost. Null strings, and rows with a null in
    ``by``, meet nothing; rows that repeat a string count once.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("a threshold from 0.5 to 1 is needed")
    q, slack, loss = 3 if threshold >= 0.7 else 2, 1e-9, 1 - threshold
    strings = _strings(left, right, by, left_text, right_text)
    budget = F.floor(F.lit(loss) * F.floor(F.length("text") / threshold + slack) + slack)  # edits to the longest partner
    prefixes = _prefixes(strings, padded_grams(F.col("text"), q), budget * q + 1, by, True)
    near = f"least(l_length, r_length) >= greatest(l_length, r_length) * {threshold} - {slack}"
    pairs = _told(_candidates(prefixes, by, near), strings, by)
    longer = F.greatest(F.length("left_text"), F.length("right_text"))
    pairs = pairs.withColumn("_longer", longer).withColumn("_limit", F.floor(F.lit(loss) * F.col("_longer") + slack).cast("int"))
    apart = F.expr("levenshtein(left_text, right_text, _limit)")
    near_enough = pairs.withColumn("_d", apart).where("_d >= 0")
    similarity = F.when(F.col("_longer") == 0, 1.0).otherwise(1 - F.col("_d") / F.col("_longer"))
    return near_enough.select(*by, "left_text", "right_text", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def trigram_pairs(left: DataFrame, right: DataFrame, threshold: float, by: list[str], left_text: str = "text", right_text: str = "text") -> DataFrame:
    """(*by, left_text, right_text, similarity): the same for the share of common trigrams among all of both (``pg_trgm``).

    With A trigrams in one string the pair shares ceil(threshold * A) of them at least, so one of the rarest A - ceil(threshold * A) + 1
    is common. Strings without letters and digits have no trigrams and meet nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0 and up to 1 is needed")
    slack = 1e-9
    strings = _strings(left, right, by, left_text, right_text)
    grams = trigrams(F.col("text"))
    most = F.size(grams) - F.ceil(F.lit(threshold) * F.size(grams) - slack) + 1
    prefixes = _prefixes(strings, grams, most, by, False)
    near = f"least(l_size, r_size) >= greatest(l_size, r_size) * {threshold} - {slack}"
    pairs = _told(_candidates(prefixes, by, near), strings, by)
    a, b = trigrams(F.col("left_text")), trigrams(F.col("right_text"))
    pairs = pairs.select(*by, "left_text", "right_text", F.size(F.array_intersect(a, b)).alias("_both"), F.size(F.array_union(a, b)).alias("_any"))
    return pairs.select(*by, "left_text", "right_text", (F.col("_both") / F.col("_any")).alias("similarity")).where(F.col("similarity") >= threshold)
