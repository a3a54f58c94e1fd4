"""Dates as Column expressions; ``as_of`` stands where a clock would."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: date formats that a user may prefer
PREFERRED = {"DD/MM/YYYY": "dd/MM/yyyy", "MM/DD/YYYY": "MM/dd/yyyy", "YYYY-MM-DD": "yyyy-MM-dd", "DD-Mon-YYYY": "dd-MMM-yyyy"}


def days_ahead(date: Column, as_of: Column) -> Column:
    """Days, as a double, from as_of to a date or time."""
    seconds = lambda v: F.unix_micros(v.cast("timestamp_ntz").cast("timestamp")) / 1e6
    return (seconds(date) - seconds(as_of)) / 86400


def corrected_year(date: Column, as_of: Column) -> Column:
    """A date more than five years ahead with the year of as_of instead."""
    d = date.cast("date")
    moved = F.add_months(d, 12 * (F.year(as_of) - F.year(d)))
    return F.when(F.year(d) > F.year(as_of) + 5, moved).otherwise(d)


def preferred_date(date: Column, style: Column) -> Column:
    """A date in the format its reader prefers, day first where none is known."""
    out = F
    for name, pattern in PREFERRED.items():
        out = out.when(style == name, F.date_format(date, pattern))
    return out.otherwise(F.date_format(date, "dd/MM/yyyy"))


def date_forms(date: Column) -> list[Column]:
    """The columns of a date dictionary."""
    d = date.cast("date")
    return [
        d.alias("date"), F.date_format(d, "yyyy-MM-dd").alias("iso"), F.date_format(d, "dd/MM/yyyy").alias("day_first"),
            F.date_format(d, "MM/dd/yyyy").alias("month_first"),
        F.date_format(d, "dd-MMM-yyyy").alias("short"), F.date_format(d, "d MMMM yyyy").alias("long"),
            F.upper(F.date_format(d, "EEEE")).alias("weekday"),
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
    ]


def days_to_expiry(until: Column, as_of: Column) -> Column:
    """Whole days until a date, never less than 0; null without one."""
    return F.when(until.isNotNull(), F.greatest(F.lit(0), F.datediff(until, as_of)))


def month_bounds(date: Column) -> Column:
    """struct<first, last> day of the month."""
    return F.struct(F.trunc(date, "month").alias("first"), F.last_day(date).alias("last"))


def quarter_partition(table: str, date: Column) -> Column:
    """struct<name, first, until> of the quarter that a date falls into."""
    first = F.trunc(date, "quarter")
    name = F.concat(F.lit(f"{table}_"), F.year(date).cast("string"), F.lit("_q"), F.quarter(date).cast("string"))
    return F.struct(name.alias("name"), first.alias("first"), F.add_months(first, 3).alias("until"))


def visit_dates(real: Column, start: Column, end: Column, source: Column, file_date: Column, today: Column) -> Column:
    """struct<start, end, source>: a visit keeps what was read; else what was read, the file's date or today, as one day."""
    other = F.coalesce(start, file_date, today)
    told = F.when(start.isNotNull(), "ai_extracted").when(file_date.isNotNull(), "file_metadata").otherwise("upload_date")
    return F.when(real, F.struct(start.alias("start"), end.alias("end"), source.alias("source"))).otherwise(F.struct(other.alias("start"),
        other.alias("end"), told.alias("source")))
