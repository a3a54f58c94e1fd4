"""Aggregations, unions and numberings with parameters. None is null-blind: what a null does is said where it matters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def conditional_counts(rows: DataFrame, key: list[str], conditions: dict[str, Column], total: str | None = "n") -> DataFrame:
    """Per key how many rows meet each condition, and how many there are (A02); a null condition counts as not met."""
    return rows.groupBy(*key).agg(*(F.count_if(c).alias(n) for n, c in conditions.items()), *([F.count("*").alias(total)] if total else []))


def distinct_where(rows: DataFrame, key: list[str], values: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per key how many different values of a column the rows that meet a condition have (A03, J03): one pass where separate joins would
    multiply rows; nulls are no values."""
    return rows.groupBy(*key).agg(*(F.count_distinct(F.when(c, v)).alias(n) for n, (v, c) in values.items()))


def distinct_list(rows: DataFrame, key: list[str], value: str, name: str, where: Column | None = None) -> DataFrame:
    """Per key the different values in order, as an array; empty where none meets the condition."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set(value if where is None else F.when(where, F.col(value)))).alias(name))


def ordered_list(rows: DataFrame, key: list[str], value: Column, order: list[str], name: str, where: Column | None = None) -> DataFrame:
    """Per key the values of the rows that meet a condition, in order, as an array; empty where none does."""
    item = F.struct(*order, value.alias("_v"))
    listed = F.array_sort(F.collect_list(item if where is None else F.when(where, item)))
    return rows.groupBy(*key).agg(F.transform(listed, lambda x: x["_v"]).alias(name))


def json_list(rows: DataFrame, key: list[str], fields: list[str], order: list[str], name: str, where: Column | None = None) -> DataFrame:
    """Per key a JSON list of objects with the fields, in order, ``[]`` where there is none."""
    return ordered_list(rows, key, F.struct(*fields), order, name, where).withColumn(name, F.to_json(name))


def distinct_concat(rows: DataFrame, key: list[str], value: str, name: str, separator: str = ", ") -> DataFrame:
    """Per key the different values in order as one string (A07); nulls are left out."""
    return rows.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias(name))


def frequent(rows: DataFrame, key: list[str], least: int, name: str = "n") -> DataFrame:
    """Keys with at least so many rows."""
    return rows.groupBy(*key).agg(F.count("*").alias(name)).where(F.col(name) >= least)


def overall(rows: DataFrame, measures: dict[str, Column], having: Column | None = None) -> DataFrame:
    """One row of measures over all rows, or none where they do not meet the condition."""
    one = rows.agg(*(c.alias(n) for n, c in measures.items()))
    return one if having is None else one.where(having)


def category_stats(rows: DataFrame, key: list[str], time: str, major: Column) -> DataFrame:
    """Per key: rows, first and last time, rows that are major (A10)."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"),
        F.count_if(major).alias("major"))


def volume_stats(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(source, total, active) of several tables."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("total"), F.count_if(active).alias("active")).select(F.lit(name).alias("source"),
        "total", "active") for name, (df, active) in tables.items()))


def dashboard(measures: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row with a measure of each of several tables (A12): rows of one are put side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), (df.agg(c.alias(n)) for n, (df, c) in measures.items()))  # a row each


def elapsed_ms(rows: DataFrame, key: list[str], first: str, last: str, name: str = "elapsed_ms") -> DataFrame:
    """Per key the milliseconds from the first to the last time (A13); null where there is none."""
    return rows.groupBy(*key).agg(F.timestamp_diff("MILLISECOND", F.min(first), F.max(last)).alias(name))


def mean_or(owners: DataFrame, rows: DataFrame, key: str, value: str, default: float, name: str, where: Column | None = None) -> DataFrame:
    """For each owner the mean of a value over its rows that meet a condition, a default where there is none (A15): rows are
    averaged before they meet the owners."""
    means = (rows if where is None else rows.where(where)).groupBy(key).agg(F.avg(value).alias(name))
    return owners.select(key).join(means, key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def histogram(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """How often each value occurs, null among them."""
    return rows.groupBy(key).agg(F.count("*").alias(name))


def any_true(rows: DataFrame, key: list[str], condition: Column, name: str) -> DataFrame:
    """Whether any row of a key meets a condition."""
    return rows.groupBy(*key).agg(F.bool_or(F.coalesce(condition, F.lit(False))).alias(name))


def quality_assessment(rows: DataFrame, a: str, b: str, complete: Column) -> DataFrame:
    """One row: the mean of a product, and the share of complete rows in percent; null without rows."""
    return rows.agg(F.round(F.avg(F.col(a) * F.col(b)), 6).alias("score"),
        F.round(F.try_divide(100.0 * F.count_if(complete), F.count("*")), 1).alias("complete"))


def latest_of_group(rows: DataFrame, key: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """Per key the value of its last row by several columns."""
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(name))


def left_chain(rows: DataFrame, *steps: tuple[DataFrame, Column, list[str]]) -> DataFrame:
    """Rows with columns of tables that hang on each other, null where one is missing (J02): (table, condition, columns to keep)."""
    for df, on, keep in steps:
        rows = rows.join(df, on, "left").select(*rows.columns, *keep)
    return rows


def with_match(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows that have a match among the others (J06): a semi join."""
    return rows.join(others.select(key), key, "left_semi")


def without_recent(rows: DataFrame, others: DataFrame, key: str, at: str, since: Column) -> DataFrame:
    """Rows without a match from a time on (J07): an anti join whose other side is filtered first."""
    return rows.join(others.where(F.col(at) > since).select(key), key, "left_anti")


def either_side(edges: DataFrame, left: str, right: str, nodes: list, others: list) -> DataFrame:
    """(left, right, side) of edges whose left end is among the nodes, or whose right end is among the others (J09): an edge that meets both
    is there twice, once a side."""
    return edges.where(F.col(left).isin(*nodes)).withColumn("side",
        F.lit("child")).unionByName(edges.where(F.col(right).isin(*others)).withColumn("side", F.lit("parent")))


def chunk_of(page: Column, size: int = 50) -> Column:
    """The chunk, from 1 on, of a page, from 1 on."""
    return (F.floor((page - 1) / size) + 1).cast("bigint")


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered from 1 on within each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def with_total(rows: DataFrame, key: list[str], name: str = "total") -> DataFrame:
    """Rows beside the number of rows of their key."""
    return rows.withColumn(name, F.count("*").over(Window.partitionBy(*key)))


def ranked(rows: DataFrame, rank: Column, then: list, most: int) -> DataFrame:
    """The first rows by a rank, then by other columns, with the rank."""
    return rows.withColumn("rank", rank).orderBy("rank", *then).limit(most)


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by other columns (U04): a numbering, as which row dropDuplicates keeps is not defined."""
    return numbered(rows, key, order, "_n").where("_n = 1").drop("_n")


def tagged_union(**parts: DataFrame) -> DataFrame:
    """Tables of one shape as one, with their name in ``kind``."""
    return reduce(DataFrame.unionByName, (df.withColumn("kind", F.lit(name)) for name, df in parts.items()))


def distinct_branches(*parts: DataFrame) -> DataFrame:
    """Different rows of each table; a row that two tables have is there twice."""
    return reduce(DataFrame.unionByName, (df.distinct() for df in parts))


def bucketed(v: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The name of the first limit that a value lies below, else the last name (P10); null has the last name, as no comparison holds."""
    out = F
    for limit, name in limits:
        out = out.when(v < limit, name)
    return out.otherwise(last)


def date_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """A row for each day."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(days).alias("day"))
