"""Scalar functions as Column expressions; all of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_identifier(v: Column) -> Column:
    """Lower case without white space, hyphens and underscores."""
    return F.lower(F.regexp_replace(v, r"[\s\-_]", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1.0 when both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def mask_identifier(v: Column) -> Column:
    """***<six hex digits of the SHA-256>:<last six>; blank becomes [REDACTED]."""
    shown = F.concat(F.lit("***"), F.left(F.sha2(v, 256), F.lit(6)), F.lit(":"), F.right(v, F.lit(6)))
    return F.when(F.trim(F.coalesce(v, F.lit(""))) == "", "[REDACTED]").otherwise(shown)


def truncated(v: Column, n: int) -> Column:
    """The first n characters and how many are missing."""
    cut = F.concat(F.left(v, F.lit(n)), F.lit("... [truncated "), (F.length(v) - n).cast("string"), F.lit(" chars]"))
    return F.when(F.length(v) > n, cut).otherwise(v)


def sanitized(v: Column, n: int = 500) -> Column:
    """Trimmed, white space squeezed, cut to n."""
    return F.left(F.trim(F.regexp_replace(v, r"\s+", " ")), F.lit(n))


def embeddable(v: Column) -> Column:
    """Whether a text is worth an embedding: two characters at least, 8000 at most, two of them no digits or signs."""
    told = F.length(F.trim(F.regexp_replace(v, r"\s+", " "))) >= 2
    meant = F.length(F.regexp_replace(v, r"[\s\d\-./]", "")) >= 2
    return F.coalesce(told & (F.length(v) <= 8000) & meant, F.lit(False))


def name_similarity(a: Column, b: Column) -> Column:
    """``similarity`` regardless of case."""
    return similarity(F.lower(a), F.lower(b))


def backoff_ms(attempt: Column, base: int, cap: int) -> Column:
    """Exponential backoff without its jitter."""
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempt - 1))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """A vector over its norm, as array<double>; null where that is 0."""
    norm = F.sqrt(_dot(v, v))
    return F.when(norm > 0, F.element_at(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1))


def unit_dot(a: Column, b: Column) -> Column:
    """The cosine of two unit vectors; an error where their lengths differ."""
    wrong = F.raise_error(F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"),
        F.lit(" dimensions"))).cast("double")
    return F.when(F.size(a) != F.size(b), wrong).otherwise(_dot(a, b))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two equally long arrays; null where a norm is 0, an error where lengths differ."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return unit_dot(unit(a), unit(b))


def age_years(birth: Column, as_of: Column) -> Column:
    """Whole years between two dates."""
    before = F.date_format(as_of, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(as_of) - F.year(birth) - before.cast("int")


def normalized_date(raw: Column, max_year: int, birth: bool = False) -> Column:
    """struct<iso, ambiguous, method, confidence, error> of a free-form date.

    ISO first, then the text forms ``d MMM yyyy``, ``d MMMM yyyy`` and ``MMM d, yyyy``, then d/m/y numbers: a first
    part over 12 is a day, a second part over 12 makes the first a month, else day first and ambiguous. Two-digit
    years pivot at 50. Dates of birth must lie in 1900..max_year.
    """
    t = F.trim(raw)
    iso = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})", 1),
        F.lit("yyyy-M-d")).cast("date"))
    text = F.coalesce(*(F.when(t.rlike("[A-Za-z]"), F.try_to_timestamp(t, F.lit(f)).cast("date")) for f in ("d MMM yyyy", "d MMMM yyyy",
        "MMM d, yyyy", "MMMM d, yyyy")))
    part = lambda i: F.regexp_extract(t, r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2}|\d{4})$", i).try_cast("int")
    a, b, y = part(1), part(2), part(3)
    year = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    month_first = (b > 12) & (a <= 12)
    day, month = F.when(month_first, b).otherwise(a), F.when(month_first, a).otherwise(b)
    numeric = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    unsure = a.isNotNull() & (a <= 12) & (b <= 12)
    date = F.coalesce(iso, text, numeric)
    sane = ~F.lit(birth) | F.year(date).between(1900, max_year)
    method = (
        F.when(F.coalesce(t, F.lit("")) == "", "empty").when(date.isNotNull() & ~sane, "failed_sanity_check").when(iso.isNotNull(),
            "iso").when(text.isNotNull(), "text")
        .when(numeric.isNotNull() & unsure, "ambiguous_default").when(numeric.isNotNull() & month_first, "mm_dd").when(numeric.isNotNull(),
            "dd_mm").otherwise("unparseable")
    )
    error = F.when(date.isNotNull() & ~sane, "year_out_of_range").when(date.isNull() & a.isNotNull(), "date_rollover")
    sure = F.when(F.coalesce(date.isNotNull() & sane, F.lit(False)) & ~F.coalesce(unsure, F.lit(False)), "high").otherwise("low")
    return F.struct(
        F.when(sane, F.date_format(date, "yyyy-MM-dd")).alias("iso"), F.coalesce(unsure, F.lit(False)).alias("ambiguous"),
        method.alias("method"), sure.alias("confidence"), error.alias("error"),
    )
