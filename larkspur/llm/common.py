"""Shared helpers of the training-data operators: reading, cutting lineage, byte slices, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator, so that joins keep such rows; results show null again.
NULL_ID = -(2**63)
#: Bytes of text that a Python task holds as numpy arrays at a time.
SLICE_BYTES = 1 << 21
#: Spark's setting that removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, as ``doc_id`` and ``text``: null ids become NULL_ID, null texts ''."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def shown_id(name: str = "doc_id"):
    """The id as results show it: NULL_ID becomes null again."""
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: no lineage is left behind it.

    The shuffle files of what led to it go as soon as it is written, so that disk holds one phase's shuffles at a
    time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """From now on the shuffle files of a query go when it ends: for jobs that write each of their steps."""
    spark.conf.set(SHUFFLE_CLEANUP, "true")


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have about ``limit`` bytes; a longer text stands alone."""
    size = np.asarray(pc.binary_length(pc.fill_null(batch.column(text), "")), dtype=np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n+1 offsets of its rows in them; null is empty."""
    column = pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit words for hashing."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that links reach.

    Alternating large-star and small-star steps: each hangs the neighbours of a node on their smallest one, so
    the number of rounds grows with the logarithm of the longest chain. Rounds are cut in the shared folder;
    the driver sees one count a round. A hub's rows are pre-aggregated for the minimum, and the join back to
    them can be split by adaptive execution. Rounds go on until every node has one smaller neighbour and that
    one has none: while a node has two, their trees are not merged yet.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        chained = stars.select(F.col("v").alias("u")).join(stars, "u", "left_semi")
        forked = stars.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least <> most")
        if not chained.union(forked.select("u")).limit(1).count():
            break
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        drop_table(stars)
        stars = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
