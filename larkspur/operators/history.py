"""Pages over large histories: a layout in the order of the pages, and a count of rows by file, so that a page reads a few files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file.
FILE_ROWS = 1_000_000


class History(NamedTuple):
    """A table under ``path``: rows in the order of (owner, newest first, key), and what each file holds of each owner."""

    spark: SparkSession
    path: str
    owner: str
    time: str
    key: str

    @property
    def files(self) -> DataFrame:
        """(_owner, file, n, newest, first_key, oldest): rows of each owner in each file, with its first and last place."""
        return self.spark.read.parquet(f"{self.path}/files")


def write_history(rows: DataFrame, path: str, owner: str, time: str, key: str, file_rows: int = FILE_ROWS, parts: int | None = None) -> History:
    """Write ``rows`` for pages of an owner's rows, newest first, by ``key`` within a time and rows without a time last.

    Files hold ranges of that order, so an owner with many rows has many files, and small owners share one. The counts of rows by
    owner and file are a table of their own, by owner.
    """
    order = [F.col(owner), F.col(time).desc_nulls_last(), F.col(key)]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(f"{path}/rows")
    spark = rows.sparkSession
    stored = spark.read.parquet(f"{path}/rows").withColumn("file", F.input_file_name())
    last = F.struct(F.col(time).isNull().alias("_none"), (-F.unix_micros(F.col(time).cast("timestamp"))).alias("_age"), F.col(key).alias("_key"))
    counts = stored.groupBy(F.col(owner).alias("_owner"), "file").agg(F.count("*").alias("n"), F.min(last).alias("first"), F.max(last).alias("last"))
    counts.repartitionByRange("_owner").sortWithinPartitions("_owner", "first").write.mode("overwrite").parquet(f"{path}/files")
    return History(spark, path, owner, time, key)


def _rows(history: History, owner, files: list[str]) -> DataFrame:
    """An owner's rows in some of the files; without any, none."""
    rows = history.spark.read.parquet(*files) if files else history.spark.read.parquet(f"{history.path}/rows").limit(0)
    return rows.where(F.col(history.owner) == F.lit(owner))


def page_by_offset(history: History, owner, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the owner's rows with the number of all of them in ``total`` (L05, W10, N04): limit within 1 and 1000, offset from 0 on.

    The counts tell the total and which files the page lies in: only these are read, and of the rows before the page only those in the first of them.
    """
    limit, offset = min(1000, max(1, limit)), max(0, offset)
    order = Window.partitionBy("_owner").orderBy("first", "file")
    own = history.files.where(F.col("_owner") == F.lit(owner)).withColumn("upto", F.sum("n").over(order))
    own = own.withColumn("total", F.sum("n").over(Window.partitionBy("_owner")))
    needed = own.where((F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + limit)).orderBy("upto").collect()  # as many files as a page spans
    before = needed[0].upto - needed[0].n if needed else 0
    rows = _rows(history, owner, [r.file for r in needed])
    total = needed[0].total if needed else 0
    return (rows.orderBy(F.col(history.time).desc_nulls_last(), history.key).offset(offset - before if needed else 0).limit(limit)
        .withColumn("total", F.lit(total).cast("long")))


def page_after(history: History, owner, after: tuple | None, size: int) -> DataFrame:
    """The owner's next ``size`` rows after a cursor (time, key), with ``has_more`` (L06, W11). Files that end before the cursor are not read,
    nor those behind the ones that hold size + 1 rows after it."""
    own = history.files.where(F.col("_owner") == F.lit(owner))
    if after is not None:
        at = F.struct(F.lit(False).alias("_none"), (-F.unix_micros(F.lit(after[0]).cast("timestamp"))).alias("_age"), F.lit(after[1]).alias("_key"))
        own = own.where(F.col("last") > at).withColumn("part", F.col("first") <= at)
    else:
        own = own.withColumn("part", F.lit(False))
    order = Window.partitionBy("_owner").orderBy("first", "file")
    # a file that the cursor lies in may have no row left for the page
    sure = F.sum(F.when(F.col("part"), 0).otherwise(F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    needed = [r.file for r in own.withColumn("_sure", F.coalesce(sure, F.lit(0))).where(F.col("_sure") <= size).collect()]
    rows, time, key = _rows(history, owner, needed), F.col(history.time), F.col(history.key)
    if after is not None:
        at = F.lit(after[0]).cast("timestamp")
        rows = rows.where((time < at) | ((time == at) & (key > after[1])) | time.isNull())
    some = rows.orderBy(time.desc_nulls_last(), key).limit(size + 1)
    n = F.row_number().over(Window.orderBy(time.desc_nulls_last(), key))  # size + 1 rows
    seen = some.withColumn("_n", n).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return seen.where(F.col("_n") <= size).drop("_n")
