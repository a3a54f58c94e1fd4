"""N-gram Jaccard join: components of documents whose shingle sets overlap enough."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, SLICE_BYTES, connected_components, cut, drop_table, mix64, random_words, read, slices, text_bytes
from .words import span_hashes, word_spans

_SALT = random_words(201, 64)
#: Ids from here on are ids; smaller ones stand for texts of rows without one.
NAMED = -(2**62)
#: Token groups of a count vector, and points or boxes under one box of the tree.
GROUPS, LEAF = 32, 16
#: Shingles of one block of a candidate cluster.
BLOCK_SHINGLES = 250_000
#: Documents of one block of a bucket, of which a task compares two.
BUCKET_BLOCK = 1000
#: Hash slots in which repeated shingles are counted.
SLOTS = 1 << 20
_SLOT_SHIFT = np.uint64(64 - 20)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each text as sorted 64-bit hashes; A-Z count as a-z, words end at white space."""
    body, offsets = text_bytes(texts)
    starts, ends, of_text = word_spans(body, offsets)
    words = span_hashes(body, starts, ends, fold=True)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = (grams + words[k : k + len(grams)]) * (_SALT[k] | np.uint64(1))
    grams = mix64(grams)
    out = []
    for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:  # fewer words: the whole sequence is one shingle
            whole = np.zeros(1, np.uint64)
            for w in words[a:b]:
                whole = (whole + w) * (_SALT[32 + b - a] | np.uint64(1))
            out.append(mix64(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_counts(rows: DataFrame, n: int) -> np.ndarray:
    """How often the shingles of each of SLOTS hash slots repeat among documents that a task reads together.

    Frequent shingles stand out from the many that occur once. The counts decide an order of shingles, never a
    result, and their number is fixed, so each task may hold all of them.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, limit=2 * SLICE_BYTES):
                hashes, times = np.unique(np.concatenate(shingle_sets(part.column("text"), n)), return_counts=True)
                again = times > 1
                np.add.at(slots, (hashes[again] >> _SLOT_SHIFT).astype(np.int64), times[again])
        used = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(slots[used])], ["slot", "times"])

    summed = rows.select("text").mapInArrow(count, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[summed.column("slot").to_numpy()] = summed.column("times").to_numpy()
    return out


def rare_prefix(own: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets that link share at least one of theirs.

    A partner holds at least num/den of the set, so in one common order of all shingles (by the count of their
    slot, then by hash) the two cannot have their first common shingle behind this prefix.
    """
    if not len(own):
        return own
    keep = len(own) - -(-num * len(own) // den) + 1
    order = np.argsort(counts[(own >> _SLOT_SHIFT).astype(np.int64)], kind="stable")
    return own[order[:keep]]


def count_vector(own: np.ndarray) -> np.ndarray:
    """Shingles in each hash group: a power of two of groups that grows with the set, so that vectors of unrelated
    sets stay apart. A vector folds to fewer groups by adding its parts."""
    groups = max(64, 1 << (len(own) // 8).bit_length())
    return np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint16)


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.int64)


class CountTree:
    """An R-tree of count vectors: boxes of up to LEAF neighbouring points, boxes of up to LEAF boxes, up to the root.

    Points lie in the order of sizes, then of their first counts. The summed minima of two vectors bound the overlap of
    their sets, those of a vector and a box's upper corner the overlap with any set in the box.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels, corner, least, most = [], self.points, self.sizes, self.sizes
        while len(corner) > LEAF:
            at = np.arange(0, len(corner), LEAF)
            corner, least, most = np.maximum.reduceat(corner, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((corner, least, most))

    def before(self, k: int, num: int, den: int) -> np.ndarray:
        """Places before k, in order, of points that may link with that at k: overlap * (num + den) >= num * (n + m)."""
        point, n = self.points[k], int(self.sizes[k])
        floor = -(-n * num // den)  # smaller sets cannot link
        some = np.arange(len(self.levels[-1][0]) if self.levels else k)
        for level in range(len(self.levels) - 1, -1, -1):
            corner, least, most = (x[some] for x in self.levels[level])
            bound = np.minimum(corner, point).sum(axis=1)
            open_boxes = (bound * (num + den) >= num * (n + np.maximum(least, floor))) & (least <= n) & (most >= floor)
            some = (some[open_boxes][:, None] * LEAF + np.arange(LEAF)).ravel()
            some = some[some < (len(self.levels[level - 1][0]) if level else k)]
        bound = np.minimum(self.points[some], point).sum(axis=1)
        return some[(self.sizes[some] >= floor) & (bound * (num + den) >= num * (n + self.sizes[some]))]


def close_pairs(ids: np.ndarray, sizes: np.ndarray, vectors: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose summed minima of counts let their sets link; the tree holds vectors folded
    to the size of the shortest, pairs are judged on those of the shorter of the two."""
    coarse = min(map(len, vectors))
    tree = CountTree(np.array([fold(v, coarse) for v in vectors]), sizes)
    root, out = np.arange(len(ids)), []
    for k in range(1, len(ids)):
        i = tree.order[k]
        for j in tree.order[tree.before(k, num, den)].tolist():
            if root[i] == root[j]:
                continue
            g = min(len(vectors[i]), len(vectors[j]))
            if g == coarse or int(np.minimum(fold(vectors[i], g), fold(vectors[j], g)).sum()) * (num + den) >= num * int(sizes[i] + sizes[j]):
                root[root == root[i]] = root[j]
                out.append((int(ids[i]), int(ids[j])))
    return out


def linked_pairs(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``: pairs that a tree of their counts in GROUPS hash groups lets
    through, and that are not yet connected, are verified on the sets themselves."""
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    counts = np.zeros((len(some), GROUPS), np.int32)
    for row, i in enumerate(some):
        counts[row] = np.bincount((sets[i] & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    tree, root, out = CountTree(counts, sizes[some]), np.arange(len(sets)), []
    order = some[tree.order]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, i in enumerate(order.tolist()):
        n = int(sizes[i])
        for j in order[tree.before(k, num, den)].tolist():
            a, b = find(i), find(j)
            if a == b:
                continue
            both = int(np.isin(sets[j], sets[i], assume_unique=True).sum()) if sizes[j] * 20 < n else len(
                np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * (num + den) >= num * (n + int(sizes[j])):
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def in_block_pairs(rows: DataFrame) -> DataFrame:
    """Each row once for every pair (low, high) of blocks that it is compared in; up to two blocks are one pair."""
    few = F.col("blocks") <= 2
    other = F.explode(F.when(few, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("other", other).select(
        *rows.drop("blocks", "block").columns,
        F.when(few, 0).otherwise(F.least("block", "other")).alias("low"),
        F.when(few, 0).otherwise(F.greatest("block", "other")).alias("high"),
    )


def group_ends(table: pa.Table) -> list[int]:
    """Where runs of rows with the same (key, low, high) end."""
    if not table.num_rows:
        return []
    cols = [table.column(c).to_numpy() for c in ("key", "low", "high")]
    new = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return [*(np.flatnonzero(new) + 1).tolist(), table.num_rows]


def split_last(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The runs that are over, and the last one, which the next batch may go on with."""
    ends = group_ends(table)
    at = ends[-2] if len(ends) > 1 else 0
    return table.slice(0, at), table.slice(at)


def jaccard_components(
    docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id that links reach, itself included).

    Two documents link when den * |A and B| >= num * |A or B| for their sets of distinct n-word shingles (with
    fewer words, the whole sequence is one). Empty or null texts have no shingle and link with nothing.

    Candidates meet by the rarest shingles of each set (see ``rare_prefix``), which Spark shuffles and groups: rows
    of two numbers. What shares one is a bucket; of buckets with the same documents one is kept. Within a bucket
    (a large one is dealt into blocks, compared two at a time) documents whose count vectors allow a link are
    chained, and the chains form clusters; each is dealt into blocks of about BLOCK_SHINGLES, and one task takes
    two blocks at most, so a hot cluster is many tasks, none of them large. Within a task a count-vector R-tree
    finds the pairs to verify, and only a spanning forest of the verified links leaves it: no link between
    components is lost, and no group is written out as pairs. Equal sets are joined by their 128-bit hash, and
    only one of them takes part in the rest. Every step up to the verification is exact; shingles
    are told apart by 64-bit hashes.

    Rows that repeat an id are one node. Rows with a null id are one node for each text: such rows link only as their texts do, and equal ones
    link anyway. They are shown as null, as is the component of all that they reach (null comes before all ids); ids below -2^62
    are kept for them. Extra columns are ignored.
    """
    num, den = threshold
    text = F.coalesce(F.col(text_col), F.lit(""))
    unnamed = F.lit(NULL_ID) + F.xxhash64(text).bitwiseAND(F.lit(NAMED - NULL_ID - 1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("doc_id"), text.alias("text"))
    repeats = shingle_counts(rows, n)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), n)
                seen, keys, counted = set(), [], []
                ids = np.zeros((len(sets), 2), np.int64)
                for i, own in enumerate(sets):
                    ids[i] = np.array([own.sum(), mix64(own ^ _SALT[42]).sum()], np.uint64).view(np.int64)
                    first = (whole := ids[i].tobytes()) not in seen
                    seen.add(whole)
                    counted.append(count_vector(own).tobytes() if first and len(own) else b"")
                    keys.append(rare_prefix(own, repeats, num, den).view(np.int64) if first else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]),
                     pa.array(counted, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))],
                    ["doc_id", "n_shingles", "set1", "set2", "counts", "keys"],
                )

    scanned = cut(rows.mapInArrow(scan, "doc_id long, n_shingles long, set1 long, set2 long, counts binary, keys array<long>"))
    nodes = cut(scanned.drop("keys"))
    heads = cut(
        nodes.where("n_shingles > 0").groupBy("set1", "set2", "n_shingles")
        .agg(F.min("doc_id").alias("head"), F.min(F.when(F.length("counts") > 0, F.col("doc_id"))).alias("keeper"))
    )
    w = Window.partitionBy("key")
    met = cut(
        scanned.join(heads.select(F.col("keeper").alias("doc_id")), "doc_id", "left_semi")
        .select("doc_id", F.explode("keys").alias("key"))
        .select(
            "doc_id", "key", F.count("*").over(w).alias("size"), F.min("doc_id").over(w).alias("least"),
            F.sum(F.shiftrightunsigned(F.xxhash64("doc_id"), 33)).over(w).alias("sum"),
            F.bit_xor(F.xxhash64("doc_id", F.lit(1))).over(w).alias("xor"),
        )
        .where("size > 1")
    )
    drop_table(scanned)  # the keys have met
    kept = met.groupBy("size", "least", "sum", "xor").agg(F.min("key").alias("key")).select("key")
    buckets = met.join(kept.hint("merge"), "key", "left_semi").withColumn("blocks", F.ceil(F.col("size") / BUCKET_BLOCK).cast("int"))
    buckets = buckets.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    buckets = in_block_pairs(buckets.select("doc_id", "key", "blocks", "block")).join(
        nodes.where("length(counts) > 0").select("doc_id", "n_shingles", "counts").hint("merge"), "doc_id"
    )

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            done, rest = split_last(rest)
            yield chained(done)
        if rest is not None:
            yield chained(rest)

    def chained(table: pa.Table) -> pa.RecordBatch:
        ids, sizes = table.column("doc_id").to_numpy(), table.column("n_shingles").to_numpy()
        vectors = [np.frombuffer(v, np.uint16) for v in table.column("counts").to_pylist()]
        ends, pairs = group_ends(table), []
        for a, b in zip([0, *ends[:-1]], ends, strict=False):
            pairs += close_pairs(ids[a:b], sizes[a:b], vectors[a:b], num, den)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    near = buckets.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(chain, "a long, b long")
    clusters = connected_components(near).withColumnRenamed("node", "doc_id")
    weight = nodes.where("n_shingles > 0").join(clusters, "doc_id").groupBy("root").agg(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks")
    )
    members = cut(clusters.join(weight, "root").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")))
    # a merge join at every size, so that the plan measured on small inputs is the one that large ones get
    dealt = in_block_pairs(rows.join(members.hint("merge"), "doc_id").select("doc_id", "text", "root", "blocks", "block"))

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, text = table.column("doc_id").to_numpy(), table.column("text").combine_chunks()
        sets = []
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"])):
            sets += shingle_sets(part.column("text"), n)
        pairs = linked_pairs(sets, num, den)
        return pa.table({"a": pa.array([ids[i] for i, _ in pairs], pa.int64()), "b": pa.array([ids[j] for _, j in pairs], pa.int64())})

    links = dealt.groupBy("root", "low", "high").applyInArrow(verify, "a long, b long")
    equal = nodes.join(heads, ["set1", "set2", "n_shingles"]).where("doc_id <> head").select("doc_id", "head")
    found = connected_components(links.union(equal.toDF("a", "b")))
    named = lambda c: F.when(c >= NAMED, c)
    return nodes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        named(F.col("doc_id")).alias("doc_id"), "n_shingles", named(F.coalesce("root", "doc_id")).alias("component_id")
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), n=3, threshold=(9, 10))
