"""Structured Streaming forms: change feeds, watermarked counts, and limits kept as state of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_feed(spark: SparkSession, folder: str, schema, users: list[int]) -> DataFrame:
    """Changes of a folder of Parquet files for some users (T01, S16, S17): a file at a time, rows without a user left out.

    ``schema`` has user_id and may have op (INSERT, UPDATE, DELETE).
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).where(F.col("user_id").isin(users))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type in clock-aligned windows with a watermark; an extension, as the reference has no event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Events of each user in sessions that end with a gap (T12); an extension as well."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upserts_to`` keeps: the newest of its numbered folders."""
    return spark.read.parquet(f"{path}/batch={max(_numbers(spark, path))}")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The finished batches in a folder, by Spark's own file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
    return [int(p.getName().split("=")[1]) for p in found if p.getName().startswith("batch=") and fs.exists(hadoop.Path(p, "_SUCCESS"))]


def upserts_to(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps one row a key: the last by ``order`` of all batches so far.

    A batch is merged with the table of the batches before it and written as the next numbered folder, so a retried
    batch replaces its own folder and reads the one before it. Rows with op DELETE remove their key. Only the last two folders are needed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _numbers(spark, path) if n < number]
        rows = batch if not before else spark.read.parquet(f"{path}/batch={max(before)}").unionByName(batch, allowMissingColumns=True)
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        kept = last.where(~F.coalesce(F.col("op") == "DELETE", F.lit(False))) if "op" in last.columns else last
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def limited(events: DataFrame, key: str, seconds: str, limit: int, window: int, expire: bool = True) -> DataFrame:
    """(key, seconds, allowed) with the window's start and count kept as state.

    A batch's events of a key are taken in order of time; those that come later than a batch that has passed them fall into the window
    that is open. With ``expire`` the state of a key is dropped after an hour of processing time without events, as its window is long over;
    a query that is to end once its input is read (availableNow) must do without, as it would wait for the timeouts.
    """

    def step(k: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(seconds)
        out = []
        for t in rows[seconds]:
            if opened is None or t > opened + window:
                opened, count = t, 0
            out.append(count < limit)
            count += out[-1]
        state.update((float(opened), int(count)))
        if expire:
            state.setTimeoutDuration(max(3_600_000, 2000 * window))
        yield pd.DataFrame({key: k[0], seconds: rows[seconds], "allowed": out})

    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} long, {seconds} double, allowed boolean", "opened double, n long", "append", "ProcessingTimeTimeout" if expire else "NoTimeout"
    )
