"""Vector search by an inverted file: codes lie in cells around centroids, and a query meets the cells that it probes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written

#: Cells of an index, and sampled codes a cell that its centroids are fitted on.
CELLS, SAMPLE = 100, 64
ROUNDS = 8
#: Codes and queries that meet as one product of matrices.
CODE_BLOCK, QUERY_BLOCK = 1024, 256
#: Pairs of a vector and a cell that are made at a time, as a vector can be placed in each cell.
PLACED = 1 << 14
#: What products of matrices and angles may be off by; a pair that passes with it is computed anew.
SLACK = 1e-7


class VectorIndex(NamedTuple):
    """``blocks``: cell, keys, kinds, vecs (unit vectors as doubles) of up to CODE_BLOCK codes; ``centroids``: a row a cell;
    ``reach``: the least cosine of a cell's codes to its centroid; ``key``: the names of a code's key."""

    blocks: DataFrame
    centroids: np.ndarray
    reach: np.ndarray
    key: list[str]


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and not only zeros."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of a column of lists; an error where one has not ``dims`` components."""
    sizes = np.asarray(column.value_lengths())
    if len(sizes) and (sizes != dims).any():
        raise ValueError(f"vectors of {dims} and {int(sizes[sizes != dims][0])} dimensions")
    rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def fit_centroids(codes: DataFrame, key: list[str], vector: str, cells: int, sample: int) -> np.ndarray:
    """Centroids of spherical k-means over at most ``cells`` * ``sample`` codes, those with the least hash of their key."""
    some = codes.select(F.col(vector).alias("v"), F.xxhash64(*key).alias("h")).orderBy("h", "v").limit(cells * sample).toArrow()
    column = some.column("v").combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    rows = units(column, len(column[0]))
    means = np.unique(rows[: max(cells, 1) * 4], axis=0)
    means = means[np.linspace(0, len(means) - 1, min(cells, len(means))).astype(int)]
    for _ in range(ROUNDS):
        cell = (rows @ means.T).argmax(1)
        sums = np.zeros_like(means)
        np.add.at(sums, cell, rows)
        norms = np.sqrt((sums * sums).sum(1))
        means = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], means)
    return means


def packed(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """``rows`` (cell, *columns, vec) with up to ``most`` of a cell in a row: cell, ``columns`` as an array of structs, vecs.

    Ranges of cells end anywhere, so a cell that holds much of the table is spread over tasks.
    """
    inner = T.StructType([rows.schema[c] for c in columns])
    schema = T.StructType().add("cell", "integer").add("keys", T.ArrayType(inner)).add("vecs", "binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            ends = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip([0, *ends], [*ends, len(cell)], strict=True):
                for at in range(a, b, most):
                    n = min(most, b - at)
                    keys = pa.StructArray.from_arrays([batch.column(c).slice(at, n) for c in columns], names=columns)
                    vecs = b"".join(batch.column("vec").slice(at, n).to_pylist())
                    made = [pa.array([cell[at]], pa.int32()), pa.ListArray.from_arrays([0, n], keys), pa.array([vecs], pa.binary())]
                    yield pa.RecordBatch.from_arrays(made, names=["cell", "keys", "vecs"])

    order = ["cell", F.xxhash64("vec")]
    return rows.repartitionByRange(*order).sortWithinPartitions("cell").mapInArrow(pack, schema)


def placed(rows: DataFrame, columns: list[str], vector: str, centroids: np.ndarray, choose) -> DataFrame:
    """``rows`` once for each cell that ``choose`` gives for their unit vector: *columns, cell, near (cosine to its centroid), vec."""
    schema = T.StructType([rows.schema[c] for c in columns]).add("cell", "integer").add("near", "double").add("vec", "binary")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = max(PLACED // len(centroids), 1)
        for part in (batch.slice(at, few) for batch in batches for at in range(0, len(batch), few)):
            own = units(part.column(vector), centroids.shape[1])
            near = own @ centroids.T
            row, cell = np.nonzero(choose(near))
            raw = pa.array([own[i].tobytes() for i in row], pa.binary())
            made = [part.column(c).take(pa.array(row)) for c in columns] + [pa.array(cell, pa.int32()), pa.array(near[row, cell]), raw]
            yield pa.RecordBatch.from_arrays(made, names=[*columns, "cell", "near", "vec"])

    return rows.select(*columns, vector).mapInArrow(place, schema)


def nearest_cell(near: np.ndarray) -> np.ndarray:
    mask = np.zeros(near.shape, bool)
    mask[np.arange(len(near)), near.argmax(1)] = True
    return mask


def build_index(codes: DataFrame, key: list[str], kind: str | None = None, vector: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """The index of all codes (V01, V02, V09): centroids come from a bounded sample, but every code with a usable vector is in a cell.

    ``kind`` names a column that searches may ask for. Codes without a vector, or with one of zeros, null or not finite
    components, are left out, as no cosine is defined. Vectors of several lengths are an error. The blocks are written in the shared folder.
    """
    rows = codes.where(usable(F.col(vector)))
    rows = rows.select(*key, (F.col(kind).cast("string") if kind else F.lit(None).cast("string")).alias("_kind"), F.col(vector).alias("_v"))
    centroids = fit_centroids(rows, key, "_v", cells, sample)
    if not len(centroids):
        empty = rows.select(*key, "_kind", F.lit(0).alias("cell"), F.lit(b"").alias("vec"))
        return VectorIndex(packed(empty, [*key, "_kind"], CODE_BLOCK), centroids, np.zeros(0), key)
    assigned = written(placed(rows, [*key, "_kind"], "_v", centroids, nearest_cell))
    reach = np.full(len(centroids), np.nan)
    for r in assigned.groupBy("cell").agg(F.min("near").alias("least")).collect():  # a row a cell
        reach[r.cell] = r.least
    return VectorIndex(written(packed(assigned.drop("near"), [*key, "_kind"], CODE_BLOCK)), centroids, reach, key)


def save_index(index: VectorIndex, path: str) -> None:
    """The index as two tables under ``path``; blocks lie in a folder for each cell, so a search reads the cells that are probed."""
    index.blocks.write.partitionBy("cell").mode("overwrite").parquet(f"{path}/blocks")
    cells = [(i, c.tolist(), float(r), index.key) for i, (c, r) in enumerate(zip(index.centroids, index.reach, strict=True))]
    spark = index.blocks.sparkSession
    spark.createDataFrame(cells, "cell int, centroid array<double>, reach double, key array<string>").write.mode("overwrite").parquet(f"{path}/cells")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)  # a row a cell
    blocks = spark.read.parquet(f"{path}/blocks")
    return VectorIndex(blocks, np.array([r.centroid for r in cells]), np.array([r.reach for r in cells]), list(cells[0].key) if cells else [])


def within_reach(reach: np.ndarray, minimum: float, probes: int | None):
    """Which cells a query meets: its ``probes`` nearest ones, or all that can hold a code with a cosine from ``minimum`` on.

    With a query at the angle a from a centroid, and no code of the cell further than r from it, no code is nearer to the query than a - r.
    """

    def choose(near: np.ndarray) -> np.ndarray:
        filled = ~np.isnan(reach)
        if probes is not None:
            order = np.argsort(np.where(filled, -near, np.inf), axis=1, kind="stable")[:, :probes]
            mask = np.zeros(near.shape, bool)
            np.put_along_axis(mask, order, True, axis=1)
            return mask & filled
        apart = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(np.where(filled, reach, 1), -1, 1))
        return filled & (np.cos(np.clip(apart - SLACK, 0, np.pi)) >= minimum - SLACK)

    return choose


def first_codes(queries: np.ndarray, codes: np.ndarray, allowed: np.ndarray, order: list[tuple], k: int, minimum: float) -> list[tuple[int, int, float]]:
    """(query, code, cosine) of each query's first ``k`` codes of a block; equal cosines go by ``order``.

    A product of matrices finds the candidates; as its last digits depend on its shape, theirs are computed one by one.
    """
    near = np.where(allowed, queries @ codes.T, -np.inf)
    out = []
    for i in np.flatnonzero((near >= minimum - SLACK).any(1)):
        found = np.flatnonzero(near[i] >= minimum - SLACK)
        if len(found) > k:
            found = found[near[i][found] >= np.partition(near[i][found], -k)[-k] - SLACK]
        exact = (codes[found] * queries[i]).sum(1)
        pairs = sorted((-s, order[j], j) for s, j in zip(exact.tolist(), found.tolist(), strict=True) if s >= minimum)[:k]
        out += [(int(i), j, -s) for s, _, j in pairs]
    return out


def probed_cells(index: VectorIndex, queries: DataFrame, minimum: float, vector: str = "embedding", probes: int | None = None) -> list[int]:
    """The cells that any of the queries meets: as many numbers as the index has cells at most."""
    asked = queries.where(usable(F.col(vector))).select(F.col(vector).alias("_v"))
    return [r.cell for r in placed(asked, [], "_v", index.centroids, within_reach(index.reach, minimum, probes)).select("cell").distinct().collect()]


def search_index(index: VectorIndex, queries: DataFrame, k: int, minimum: float, query: str = "query", kind: str | None = None, vector: str = "embedding",
    probes: int | None = None) -> DataFrame:
    """(query, *key, similarity, position): of each query the ``k`` codes with the greatest cosine from ``minimum`` on.

    Without ``probes`` the result is exact: a query meets every cell that can hold such a code, by the angle to its centroid. With it a query
    meets its ``probes`` nearest cells only. Where ``kind`` names a column of the queries, null asks for all kinds, else
    only codes of that kind count. Queries without a usable vector find nothing. Similarities are not rounded; ties go by key.

    Blocks of codes and of queries meet by an equi-join on the cell; a block gives at most ``k`` codes of each query.
    """
    spark, key = queries.sparkSession, index.key
    struct = T.StructType(index.blocks.schema["keys"].dataType.elementType)
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType)] + [struct[c] for c in key]).add("similarity", "double")
    if not len(index.centroids):
        return spark.createDataFrame([], T.StructType(schema.fields).add("position", "integer"))
    wanted = F.col(kind).cast("string") if kind else F.lit(None).cast("string")
    asked = queries.where(usable(F.col(vector))).select(query, wanted.alias("_wanted"), F.col(vector).alias("_v"))
    probed = placed(asked, [query, "_wanted"], "_v", index.centroids, within_reach(index.reach, minimum, probes))
    asked_blocks = packed(probed.drop("near"), [query, "_wanted"], QUERY_BLOCK).select("cell", F.struct("keys", "vecs").alias("q"))
    dims = index.centroids.shape[1]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                q_keys, c_keys = (batch.column(side).field("keys")[row].values for side in ("q", "c"))
                wanted, kinds = q_keys.field("_wanted").to_pylist(), c_keys.field("_kind").to_pylist()
                allowed = np.ones((len(wanted), len(kinds)), bool)
                if any(w is not None for w in wanted):
                    allowed = np.array([[w is None or w == c for c in kinds] for w in wanted])
                order = [tuple((x is not None, x) for x in r) for r in zip(*(c_keys.field(c).to_pylist() for c in key), strict=True)]
                vectors = (np.frombuffer(batch.column(side).field("vecs")[row].as_py(), np.float64).reshape(-1, dims) for side in ("q", "c"))
                hits = first_codes(*vectors, allowed, order, k, minimum)
                q, c = (pa.array([h[i] for h in hits], pa.int64()) for i in (0, 1))
                columns = [q_keys.field(query).take(q), *(c_keys.field(n).take(c) for n in key), pa.array([h[2] for h in hits], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[query, *key, "similarity"])

    pairs = index.blocks.select("cell", F.struct("keys", "vecs").alias("c")).join(asked_blocks, "cell").select("q", "c")
    order = Window.partitionBy(query).orderBy(F.desc("similarity"), *key)
    found = pairs.mapInArrow(meet, schema)
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
