"""Hard-negative mining by norm-bucketed search in exact integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .centroids import dot, finite, whole_numbers
from .common import cut, drop_table, read

#: Stands for a null id: after all others where scores are equal.
NO_ID = 2**63 - 1
#: Vectors of a bucket, and anchors of a block.
BUCKET, BLOCK = 4096, 256
#: Shares into which the pairing of blocks with buckets is dealt.
SALT = 16
#: Where a window has no limit.
LEAST, MOST = -(2**62), 2**62
#: Rounding of norms as doubles never hides a row.
SLACK = 1e-9

POINT = "row bigint, id bigint, label int, dims int, norm double, vec binary"
SHELF = "label int, dims int, high double, rows array<bigint>, ids array<bigint>, norms array<double>, vecs binary"
HIT = "anchor bigint, slot int, row bigint, id bigint, score bigint"


def points_of(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """POINT rows, written: floor(scale * x) of each component as 4-byte integers, with a number of its own for each row."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("vector").value_lengths())
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            vectors = np.split(whole_numbers(flat, 1, scale).ravel(), np.cumsum(sizes)[:-1]) if len(batch) else []
            norms = [float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in vectors]
            if any(n >= 2.0**31 for n in norms):
                raise ArithmeticError("a vector is too long: its inner products may not fit a long")
            vecs = pa.array([v.astype(np.int32).tobytes() for v in vectors], pa.binary())
            made = [pa.array(sizes, pa.int32()), pa.array(norms, pa.float64()), vecs]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "id", "label")] + made, names=["row", "id", "label", "dims", "norm", "vec"])

    kept = rows.where(F.col(label_col).isNotNull() & finite(F.col(vector_col))).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("vector"),
    )
    return cut(kept.mapInArrow(whole, POINT))


def shelved(points: DataFrame, most: int, name: str) -> DataFrame:
    """Points of one label and number of components in the order of falling norms, ``most`` in a row (SHELF and the row's number
    ``name``), written. Ranges end anywhere, so a label or a norm that many rows share is spread over tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for point in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= most or held[0][2:4] != point[2:4]):
                    yield shelf(held)
                    held = []
                held.append(point)
        if held:
            yield shelf(held)

    def shelf(held: list[tuple]) -> pa.RecordBatch:
        rows, ids, labels, dims, norms, vecs = zip(*held, strict=True)
        lists = [pa.array([rows], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([norms], pa.list_(pa.float64()))]
        head = [pa.array(labels[:1], pa.int32()), pa.array(dims[:1], pa.int32()), pa.array(norms[:1], pa.float64())]
        return pa.RecordBatch.from_arrays(head + lists + [pa.array([b"".join(vecs)], pa.binary())],
            names=["label", "dims", "high", "rows", "ids", "norms", "vecs"])

    order = ["dims", "label", F.desc("norm"), "row"]
    sorted_points = points.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(sorted_points.mapInArrow(pack, SHELF).withColumn(name, F.monotonically_increasing_id()))


def vectors_of(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).astype(np.int64).reshape(-1, dims)


def best_in_bucket(block: dict, bucket: dict, k: int) -> list[tuple[int, int, int, int, int]]:
    """HIT rows: the first ``k`` of a bucket in each window of a block of anchors.

    A window takes scores from ``low`` on; by Cauchy-Schwarz only rows with norm >= low / |anchor| can reach it, and these
    stand first in the bucket. Rows past every window's bound are not multiplied, nor are anchors that no row can serve.
    """
    norms, limits = np.asarray(bucket["norms"]), []
    for w in block["windows"]:
        norm = block["norms"][w["pos"]]
        bound = w["low"] / norm * (1 - SLACK) - SLACK if norm and w["low"] > 0 else 0.0 if w["low"] <= 0 else np.inf
        limits.append(int(np.searchsorted(-norms, -bound, "right")))
    used = sorted({w["pos"] for w, n in zip(block["windows"], limits, strict=True) if n})
    if not used:
        return []
    at = {pos: i for i, pos in enumerate(used)}
    scores = dot(vectors_of(block["vecs"], block["dims"])[used], vectors_of(bucket["vecs"], bucket["dims"])[: max(limits)].T)
    rows, ids, out = np.asarray(bucket["rows"]), np.asarray(bucket["ids"]), []
    for w, n in zip(block["windows"], limits, strict=True):
        if not n:
            continue
        own, anchor = scores[at[w["pos"]], :n], block["rows"][w["pos"]]
        found = np.flatnonzero((own >= w["low"]) & (own <= w["high"]) & (rows[:n] != anchor))
        if len(found) > k:
            found = found[own[found] >= np.partition(own[found], -k)[-k]]
        found = found[np.lexsort((rows[found], ids[found], -own[found]))[:k]]
        out += [(anchor, w["slot"], int(rows[i]), int(ids[i]), int(own[i])) for i in found]
    return out


def first_hits(hits: DataFrame, k: int) -> DataFrame:
    """Of each window the first ``k`` by score, id and row, with their ``rank``."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(blocks: DataFrame, windows: DataFrame, shelves: DataFrame, k: int, same_label: bool, bucket: int) -> DataFrame:
    """(anchor, slot, row, id, score, rank), written: of each window the first ``k`` rows of the anchor's label, or of the others.

    ``windows`` has block, pos, anchor, slot, low, high. A block of anchors meets a bucket only where the bucket's greatest norm can
    reach the lower limit of one of its windows. Buckets are searched in rounds of 1, 2, 4, ... times ``bucket`` rows a label, those of the
    greatest norms first; after each round a window's lower limit rises to its k-th score, so later rounds meet fewer buckets. Buckets
    meet blocks by their numbers alone until both are joined to their vectors, and every round is written.
    """
    order = Window.partitionBy("dims", "label").orderBy(F.desc("high"), "shelf").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    about = shelves.select("shelf", "dims", "label", "high", F.size("rows").alias("n"))
    about = cut(about.withColumn("place", F.floor(before / bucket) + 1).drop("n"))
    last = about.agg(F.max("place")).first()[0] or 0
    norm = blocks.select("block", F.posexplode("norms").alias("pos", "norm"))
    sized = cut(windows.join(norm, ["block", "pos"]))
    found, first, size = None, 1, 1
    while first <= last:
        asked = sized
        if found is not None:
            full = found.where(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("kth"))
            asked = sized.join(full, ["anchor", "slot"], "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low")))
        bound = F.when(F.col("low") <= 0, 0.0).when(F.col("norm") > 0, F.col("low") / F.col("norm") * (1 - SLACK) - SLACK)
        ready = asked.groupBy("block").agg(
            F.min(bound).alias("need"), F.collect_list(F.struct("pos", "slot", "low", "high")).alias("windows")
        ).where("need IS NOT NULL")
        known = blocks.select("block", F.col("dims").alias("_dims"), F.col("label").alias("_label"))
        wanted = ready.select("block", "need").join(known, "block").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        here = about.where(F.col("place").between(first, first + size - 1)).withColumn("_salt", F.pmod(F.xxhash64("shelf"), F.lit(SALT)).cast("int"))
        fits = (F.col("dims") == F.col("_dims")) & (here["_salt"] == wanted["_salt"]) & (F.col("high") >= F.col("need"))
        label = F.col("label") == F.col("_label")
        pairs = wanted.join(here, fits & (label if same_label else ~label)).select("block", "shelf")
        held = blocks.join(ready, "block").select("block", F.struct("dims", "rows", "norms", "vecs", "windows").alias("a"))
        full_pairs = pairs.join(held.hint("merge"), "block").join(
            shelves.select("shelf", F.struct("dims", "rows", "ids", "norms", "vecs").alias("b")).hint("merge"), "shelf"
        )

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(len(batch)):
                    block, bucket = batch.column("a")[row].as_py(), batch.column("b")[row].as_py()
                    hits = best_in_bucket(block, bucket, k)
                    columns = zip(*hits, strict=True) if hits else [()] * 5
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "slot", "row", "id", "score"])

        hits = full_pairs.select("a", "b").mapInArrow(meet, HIT)
        if found is not None:
            hits = hits.unionByName(found.drop("rank"))
        after = cut(first_hits(hits, k))
        if found is not None:
            drop_table(found)
        found, first, size = after, first + size, 2 * size
    drop_table(sized)
    drop_table(about)
    return found


def hard_negatives(
    rows: DataFrame, anchors: Column, scale: int = 256, k_positives: int = 5, k_negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label", bucket: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first ``k_positives`` other
    rows of its label the first ``k_negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    ``anchors`` is a condition on ``id``, the row's id. Components x count as floor(scale * x); a score is the exact inner product with the anchor; higher
    scores come first, ties go by the smaller id. Rows with a null label or vector, without components, or with a null or not finite component take no
    part. Vectors of another number of components than the anchor's have no score with it. Each row counts for itself: rows that repeat an id are rows of their own (an anchor
    is no positive of itself only), and equal ones give equal results. A null id is no anchor, may be found, and comes last
    of equal scores. An anchor without positives, and a positive without negatives, give no rows. Vectors with a norm of 2^31 or more after
    scaling raise an error. Other columns are not read.

    Both searches are the anchors, in blocks, against all rows, in buckets of falling norms (see ``search``).
    """
    if not 0 <= low < high:
        raise ValueError("the window needs 0 <= low < high")
    points = points_of(rows, scale, id_col, vector_col, label_col)
    shelves = shelved(points, bucket, "shelf")
    blocks = shelved(points.where(anchors & (F.col("id") != NO_ID)), block, "block")
    each = blocks.select("block", F.posexplode(F.arrays_zip("rows", "ids")).alias("pos", "a")).select(
        "block", "pos", F.col("a.rows").alias("anchor"), F.col("a.ids").alias("anchor_id")
    )
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    open_ends = each.select("block", "pos", "anchor", F.lit(0).alias("slot"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    positives = search(blocks, open_ends, shelves, k_positives, True, bucket)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if positives is None:
        return rows.sparkSession.createDataFrame([], out)
    told = positives.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    # a negative score has no window, as low * score lies above high * score
    limits = told.where("positive_score >= 0").select(
        "anchor", "slot", F.expr(f"({low} * positive_score + 99) div 100").alias("low"), F.expr(f"({high} * positive_score) div 100").alias("high")
    )
    windows = each.select("block", "pos", "anchor").join(limits, "anchor").where("low <= high")
    negatives = search(blocks, windows, shelves, k_negatives, False, bucket)
    rows_out = negatives.select("anchor", "slot", F.col("id").alias("negative"), F.col("score").alias("negative_score"), "rank")
    return rows_out.join(told, ["anchor", "slot"]).join(each.select("anchor", "anchor_id"), "anchor").select(
        "anchor_id", shown("positive").alias("positive_id"), "rank", shown("negative").alias("negative_id"), "positive_score", "negative_score"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; where an id is divisible by 7 the label is the next of ten."""
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5
"""
