"""Centroid clustering of vectors by Lloyd rounds over kd-trees, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, cut, read, shown_id

#: Bytes of the integer vectors of one tree.
TREE_BYTES = 4 << 20
#: Vectors of a leaf.
LEAF = 32
#: Greatest component whose squared distances surely fit a long with 64 components.
LARGEST = 1 << 27
#: Integers up to this one, and their sums, are exact as doubles.
EXACT = 1 << 53

TREE = "ids array<bigint>, points binary, bounds binary, child binary, low binary, high binary, sums binary, squares binary"
PARTIAL = "cluster int, part int, value bigint"
#: Numbers of the two parts of a partial row that are no component.
COUNT, INERTIA = -1, -2


class Tree(NamedTuple):
    """Vectors in an order in which each node is a run; a node's right child follows its left one, a leaf has child -1."""

    points: np.ndarray
    bounds: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    squares: np.ndarray


class Model(NamedTuple):
    trees: DataFrame
    centroids: np.ndarray
    inertia: list[int]


def finite(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector is there with ``dims`` components (any number above 0 without it), none of them null or not finite."""
    sized = F.size(vector) == dims if dims else F.size(vector) > 0
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sized & whole, F.lit(False))


def whole_numbers(flat: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors that stand end to end, x as double, a row a vector."""
    scaled = np.floor(scale * np.asarray(flat, dtype=np.float64))
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ArithmeticError(f"a component is beyond {LARGEST} after scaling: its squared distances may not fit a long")
    return scaled.astype(np.int64).reshape(-1, dims)


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """The order of ``points`` in their kd-tree, and the tree: nodes are halved at the median of their widest component until
    they have ``leaf`` points or all their points are equal."""
    order, bounds, child, low, high = np.arange(len(points)), [(0, len(points))], [], [], []
    for start, end in bounds:
        own = points[order[start:end]]
        low.append(own.min(0))
        high.append(own.max(0))
        width = high[-1] - low[-1]
        axis = int(width.argmax())
        if end - start <= leaf or not width[axis]:
            child.append(-1)
            continue
        half = (end - start) // 2
        order[start:end] = order[start:end][np.argpartition(own[:, axis], half)]
        child.append(len(bounds))
        bounds += [(start, start + half), (start + half, end)]
    points, at = points[order], np.array(bounds, dtype=np.int64)
    totals = np.vstack([np.zeros((1, points.shape[1]), np.int64), points.cumsum(0)])
    squares = np.concatenate([[0], (points * points).sum(1).cumsum()])
    return order, Tree(
        points, at, np.array(child, dtype=np.int64), np.array(low), np.array(high), totals[at[:, 1]] - totals[at[:, 0]], squares[at[:, 1]] - squares[at[:, 0]]
    )


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer matrices: by doubles while every sum fits them, else by longs."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def filtered(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Descends ``tree`` with the centroids that are still in question.

    Of a node's candidates the one nearest to the middle of its box stands against each other one: where even the corner of the
    box that favours the other is strictly farther from it, the other goes. A node with one candidate is assigned whole;
    a leaf with several compares its points with these. Gives the whole nodes as (node, cluster) runs, and of points
    in leaves their places, clusters and squared distances; of equal distances the smaller number counts.
    """
    k = len(centroids)
    nodes, alive, whole, places, masks = np.zeros(1, np.int64), np.ones((1, k), bool), [], [], []
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        middle = low + high
        far = ((middle[:, None] - 2 * centroids[None]) ** 2).sum(2)
        far[~alive] = np.iinfo(np.int64).max
        near = far.argmin(1)
        step = centroids[None] - centroids[near][:, None]
        corner = np.where(step > 0, high[:, None], low[:, None])
        beyond = (step * (centroids[None] + centroids[near][:, None] - 2 * corner)).sum(2)
        alive = alive & (beyond <= 0)
        alone = alive.sum(1) == 1
        whole.append((nodes[alone], near[alone]))
        nodes, alive = nodes[~alone], alive[~alone]
        leaf = tree.child[nodes] < 0
        for node, mask in zip(nodes[leaf], alive[leaf], strict=True):
            places.append(np.arange(*tree.bounds[node]))
            masks.append(np.broadcast_to(mask, (len(places[-1]), k)))
        left = tree.child[nodes[~leaf]]
        nodes, alive = np.concatenate([left, left + 1]), np.concatenate([alive[~leaf], alive[~leaf]])
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    points = tree.points[at]
    distance = (points**2).sum(1)[:, None] - 2 * dot(points, centroids.T) + (centroids**2).sum(1)[None]
    if places:
        distance[~np.concatenate(masks)] = np.iinfo(np.int64).max
    cluster = distance.argmin(1)
    return whole, at, cluster, distance[np.arange(len(at)), cluster]


def trees_of(vectors: DataFrame, dims: int, scale: int, leaf: int = LEAF, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """A tree a row over runs of the rows (id, vector) of each partition; a run has ``tree_bytes`` of vectors at most."""
    most = max(1, tree_bytes // (8 * dims))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), most):
                run = batch.slice(at, most)
                ids = run.column("id").to_numpy(zero_copy_only=False)
                order, tree = grow(whole_numbers(run.column("vector").flatten().to_numpy(zero_copy_only=False), dims, scale), leaf)
                raw = [x.astype(np.int32 if name in ("points", "low", "high") else np.int64).tobytes() for name, x in tree._asdict().items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[order]], pa.list_(pa.int64()))] + [pa.array([x], pa.binary()) for x in raw], names=["ids", *Tree._fields]
                )

    return cut(vectors.mapInArrow(build, TREE))


def loaded(batch: pa.RecordBatch, row: int, dims: int) -> Tree:
    def part(name: str) -> np.ndarray:
        kind = np.int32 if name in ("points", "low", "high") else np.int64
        return np.frombuffer(batch.column(name)[row].as_py(), kind).astype(np.int64)

    shaped = {"points": dims, "low": dims, "high": dims, "sums": dims, "bounds": 2}
    return Tree(*(part(n).reshape(-1, shaped[n]) if n in shaped else part(n) for n in Tree._fields))


def totals_of(trees: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int], int]]:
    """Of each centroid the number of vectors nearest to it, their componentwise sums and their squared distances' sum.

    A task gives a row for each cluster and part, so the driver gets some k * (dims + 2) numbers however many vectors there are.
    """
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, squares = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        for batch in batches:
            for row in range(len(batch)):
                tree = loaded(batch, row, dims)
                whole, at, cluster, distance = filtered(tree, centroids)
                for nodes, near in whole:
                    size = tree.bounds[nodes, 1] - tree.bounds[nodes, 0]
                    np.add.at(count, near, size)
                    np.add.at(sums, near, tree.sums[nodes])
                    inner = (tree.sums[nodes] * centroids[near]).sum(1)
                    apart = tree.squares[nodes] - 2 * inner + size * (centroids[near] ** 2).sum(1)
                    for c, d in zip(near.tolist(), apart.tolist(), strict=True):
                        squares[c] += d
                np.add.at(count, cluster, 1)
                np.add.at(sums, cluster, tree.points[at])
                for c in range(k):
                    squares[c] += int(distance[cluster == c].sum())
        rows = [(c, COUNT, int(count[c])) for c in range(k)] + [(c, INERTIA, squares[c]) for c in range(k)]
        rows += [(c, j, int(sums[c, j])) for c in range(k) for j in range(dims)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)],
            names=["cluster", "part", "value"])

    summed = trees.mapInArrow(partial, PARTIAL).groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    found = {(r.cluster, r.part): int(r.value) for r in summed.collect()}
    return [(found.get((c, COUNT), 0), [found.get((c, j), 0) for j in range(dims)], found.get((c, INERTIA), 0)) for c in range(k)]


def fitted(
    rows: DataFrame, k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding",
    leaf: int = LEAF, tree_bytes: int = TREE_BYTES,
) -> Model | None:
    """The trees over all kept vectors and the centroids after ``rounds``; None where no vector is kept.

    Kept are vectors with exactly ``dims`` components, none null or not finite; each component x counts as floor(scale * x).
    The first centroids are the vectors whose ``seed``:id has the least SHA-256 (null ids last, repeated ids by their components; fewer
    than ``k`` vectors make fewer centroids). A round replaces each centroid that has vectors by floor(sum / count) of theirs.
    Trees are written once, and a round reads them: a lost executor costs its part of one round. Components beyond 2^27
    after scaling raise an error, as their distances may not fit a long.
    """
    kept = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vector_col).alias("vector")).where(
        finite(F.col(vector_col), dims)
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), shown_id("id").cast("string")), 256)
    first = kept.withColumn("_h", digest).orderBy(F.asc_nulls_last("_h"), "vector").limit(k).collect()
    if not first:
        return None
    centroids = whole_numbers(np.array([r.vector for r in first]), dims, scale)
    trees = trees_of(kept, dims, scale, leaf, tree_bytes)
    for _ in range(rounds):
        totals = totals_of(trees, centroids)
        centroids = np.array([[s // n for s in sums] if n else old for (n, sums, _), old in zip(totals, centroids.tolist(), strict=True)], dtype=np.int64)
    return Model(trees, centroids, [i for _, _, i in totals_of(trees, centroids)])


def assigned(model: Model) -> DataFrame:
    """(id, cluster, distance) of every vector: its nearest centroid, the smaller number of equal ones, and its squared distance."""
    centroids = model.centroids

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                tree = loaded(batch, row, centroids.shape[1])
                whole, at, cluster, distance = filtered(tree, centroids)
                nearest, apart = np.zeros(len(tree.points), np.int32), np.zeros(len(tree.points), np.int64)
                for nodes, near in whole:
                    for node, c in zip(nodes, near, strict=True):
                        run = slice(*tree.bounds[node])
                        nearest[run], apart[run] = c, ((tree.points[run] - centroids[c]) ** 2).sum(1)
                nearest[at], apart[at] = cluster, distance
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, pa.array(nearest), pa.array(apart)], names=["id", "cluster", "distance"])

    return model.trees.mapInArrow(emit, "id bigint, cluster int, distance bigint")


def clustered(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that ``fitted`` keeps.

    Rows that repeat an id count each; null ids stay null; a table without such vectors gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    model = fitted(rows, id_col=id_col, vector_col=vector_col, **settings)
    if model is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    total = sum(model.inertia)
    about = [
        (c, i, total, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
        for c, (i, centroid) in enumerate(zip(model.inertia, model.centroids.tolist(), strict=True))
    ]
    told = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # one row a centroid
    return assigned(model).join(F.broadcast(told), "cluster").select(
        shown_id("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read(spark, sf_dir, "embeddings"))


def _round_sql(name: str, before: str) -> str:
    """One round over the kept vectors ``v``: the nearest centroid of each, then the floored means."""
    return f"""
{name}_a AS (SELECT v.vec_id, v.x, arg_min(c.c, struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c.c)) AS c
  FROM v, {before} AS c GROUP BY v.vec_id, v.x),
{name}_s AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM {name}_a, range(1, 65) AS t(i) GROUP BY c, i),
{name} AS (SELECT b.c, coalesce(m.x, b.x) AS x FROM {before} AS b LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM {name}_s GROUP BY c) AS m ON m.c = b.c)"""


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < 16),{_round_sql("c1", "c0")},{_round_sql("c2", "c1")},{_round_sql("c3", "c2")},
a AS (SELECT vec_id, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c.c)) AS m FROM v, c3 AS c GROUP BY vec_id)
SELECT vec_id, a.m.c::INTEGER AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.x, ',')) AS centroid_sha256 FROM a JOIN c3 ON c3.c = a.m.c
"""
