"""Views that are kept: aggregates of a table, refreshed whole or from what was inserted and deleted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """Groups by ``key`` with, by name, sums, counts of values, means, least and greatest values of columns. ``rows`` counts a group's rows.

    A stored view has partial values: for a sum or mean the sum (``name_sum``) and the number of values (``name_n``), so that deltas can be added.
    """

    key: list[str]
    sums: dict[str, str] = field(default_factory=dict)
    counts: dict[str, str] = field(default_factory=dict)
    means: dict[str, str] = field(default_factory=dict)
    least: dict[str, str] = field(default_factory=dict)
    greatest: dict[str, str] = field(default_factory=dict)

    @property
    def added(self) -> dict[str, str]:
        return self.sums | self.means


def full_refresh(view: View, base: DataFrame) -> DataFrame:
    """The stored view of a whole table."""
    aggregates = [F.count("*").alias("rows")]
    for name, c in view.added.items():
        aggregates += [F.coalesce(F.sum(c), F.lit(0)).alias(f"{name}_sum"), F.count(c).alias(f"{name}_n")]
    aggregates += [F.count(c).alias(n) for n, c in view.counts.items()]
    aggregates += [F.min(c).alias(n) for n, c in view.least.items()] + [F.max(c).alias(n) for n, c in view.greatest.items()]
    return base.groupBy(*view.key).agg(*aggregates)


def incremental_refresh(view: View, stored: DataFrame, base: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The stored view after rows were inserted and deleted (an update is both): the same rows as ``full_refresh`` of ``base``, the table
    as it is now, without reading all of it (D21).

    Sums and counts of the delta are added and subtracted. The least and greatest values of a group can grow by themselves; where a deleted
    value is at the end of its group, that group alone is read again from ``base``. Groups without rows go. Sums of doubles
    can differ from a full refresh in their last digits; those of decimals and whole numbers are exact.
    """
    plus, minus = full_refresh(view, inserted), full_refresh(view, deleted)
    ends = [*view.least, *view.greatest]
    numbers = ["rows", *(f"{n}_{p}" for n in view.added for p in ("sum", "n")), *view.counts]
    gone = lambda n: F.lit(None).cast(stored.schema[n].dataType)
    side = lambda df, sign: df.select(
        *view.key, *((F.col(n) * sign).alias(n) for n in numbers), *((F.col(n) if sign > 0 else gone(n)).alias(n) for n in ends),
        *((F.col(n) if sign < 0 else gone(n)).alias(f"_out_{n}") for n in ends),
    )
    every = side(stored, 1).unionByName(side(plus, 1)).unionByName(side(minus, -1))
    extreme = lambda n: F.min if n in view.least else F.max
    merged = every.groupBy(*view.key).agg(
        *(F.sum(n).cast(stored.schema[n].dataType).alias(n) for n in numbers),
        *(extreme(n)(c).alias(c) for n in ends for c in (n, f"_out_{n}")),
    )
    merged = merged.where("rows > 0")
    again: Column = F.lit(False)
    for n in ends:
        out = F.col(f"_out_{n}")
        again = again | F.coalesce(out <= F.col(n) if n in view.least else out >= F.col(n), F.lit(False))
    merged = merged.withColumn("_again", again)
    if not ends:
        return merged.select(stored.columns)
    whole = F.struct(*view.key)
    touched = merged.where("_again").select(whole.alias("_key"))
    anew = full_refresh(view, base.withColumn("_key", whole).join(touched, "_key", "left_semi"))
    return merged.where("NOT _again").select(stored.columns).unionByName(anew.select(stored.columns))


def shown(view: View, stored: DataFrame) -> DataFrame:
    """The view as it is read: key, rows and the values by their names; a sum or mean of no values is null."""
    value = lambda n, c: F.when(F.col(f"{n}_n") > 0, c).alias(n)
    return stored.select(
        *view.key, "rows", *(value(n, F.col(f"{n}_sum")) for n in view.sums), *(value(n, F.col(f"{n}_sum") / F.col(f"{n}_n")) for n in view.means),
        *view.counts, *view.least, *view.greatest,
    )
