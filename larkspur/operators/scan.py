"""Running values over keys of any size: each key's rows lie in ranges, and what a range ends with is carried to the next ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def spread(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` in ranges of (keys, order), written, with the number of their range in ``_part``: a key that holds much of the
    table lies in many ranges. Rows that are equal in all these columns share a range."""
    by = [F.col(c) for c in (*keys, *order)]
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return written(ranged.withColumn("_part", F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_of_{c}"]) for c in columns))


def carried(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(_of_part, _of_keys, _carry): the greatest value of a key in the ranges before, for each range that a key does not begin in.

    A key in several ranges is the first or last one of all but one of them, so the ranges' ends tell these keys, and the
    table has fewer rows than there are ranges.
    """
    key = F.struct(*keys)
    ends = rows.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends = ends.select("_part", F.explode(F.array_distinct(F.array("first", "last"))).alias("key"))
    several = ends.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(*(F.col("key")[c].alias(f"_of_{c}") for c in keys))
    held = rows.join(F.broadcast(several), _same(rows, several, keys), "left_semi")  # fewer rows than ranges
    tops = held.groupBy("_part", *keys).agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    found = tops.withColumn("_carry", F.max("_top").over(before)).where("_carry IS NOT NULL")
    return found.select(F.col("_part").alias("_of__part"), *(F.col(c).alias(f"_of_{c}") for c in keys), "_carry")


def running_max(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, inclusive: bool) -> DataFrame:
    """``rows`` of ``spread`` with the greatest ``value`` of the rows up to each one of its key, itself included or not; nulls are passed over.

    A window runs within (range, key); what came before the range is joined from ``carried``. So one key is not one task.
    """
    carry = carried(rows, keys, value)
    at = rows.join(F.broadcast(carry), _same(rows, carry, ["_part", *keys]), "left")  # fewer rows than ranges
    last = Window.currentRow if inclusive else -1
    window = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    return at.withColumn(name, F.greatest(F.max(value).over(window), "_carry")).select(*rows.columns, name)


def merged_ranges(rows: DataFrame, key: str | list[str], start: str, end: str, parts: int | None = None) -> DataFrame:
    """(*key, start, end): ranges of each key merged where one begins at most 1 after what is covered so far.

    Rows with the same start are one first. A range begins an island where the greatest end before it does not reach it; the island of any other
    one is the last beginning up to it, which is a running maximum as well. Both run over ranges of the table (see
    ``running_max``), so a key that holds most rows is spread over tasks. Rows without a start or an end are left out.
    """
    keys = [key] if isinstance(key, str) else key
    longest = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*keys, start).agg(F.max(end).alias(end))
    ranged = spread(longest, keys, [start], parts)
    covered = running_max(ranged, keys, [start], end, "_before", False)
    begins = covered.withColumn("_begin", F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before") + 1), F.col(start)))
    island = running_max(begins, keys, [start], "_begin", "_island", True)
    return island.groupBy(*keys, "_island").agg(F.max(end).alias(end)).select(*keys, F.col("_island").alias(start), end)


def gaps(rows: DataFrame, key: list[str], number: Column, parts: int | None = None) -> DataFrame:
    """Rows whose number does not follow the one before it within their key (W02); the first of a key, and rows without a number, are none.

    In the order of the numbers the one before is the greatest one before, so a key that holds most rows is spread over tasks.
    """
    told = written(rows.withColumn("_v", number).where("_v IS NOT NULL").withColumn("_id", F.monotonically_increasing_id()))
    order = ["_v", "_id"]
    seen = running_max(spread(told, key, order, parts), key, order, "_v", "_b", False)
    return seen.where(F.col("_v") != F.col("_b") + 1).select(*rows.columns)
