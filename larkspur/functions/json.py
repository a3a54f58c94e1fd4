"""JSON fields and maps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: fields that no event may carry
PRIVATE = ["email", "phone", "ssn", "medical_record_number", "name", "address"]


def config_number(v: Column, default: int) -> Column:
    """A number in a JSON scalar, bare or quoted, else the default."""
    return F.coalesce(F.regexp_replace(F.trim(v), '^"|"$', "").try_cast("int"), F.lit(default))


def contains_field(payload: Column, key: str, value: Column) -> Column:
    """Whether a JSON object holds a field with a value."""
    return F.coalesce(F.get_json_object(payload, f"$.{key}") == value.cast("string"), F.lit(False))


def number_pairs(v: Column) -> Column:
    """A JSON list of pairs as array<array<int>>."""
    return F.from_json(v, "array<array<int>>")


def merged(a: Column, b: Column) -> Column:
    """Two JSON objects of scalars as one; fields of the second win."""
    old, new = (F.coalesce(F.from_json(x, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")) for x in (a, b))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new))


def object_of(**fields: Column) -> Column:
    """A JSON object with its fields in the given order; nulls are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def sanitized_fields(v: Column, most: int = 200) -> Column:
    """A map of fields without private ones, long texts cut."""
    kept = F.map_filter(v, lambda k, _: ~k.isin(*PRIVATE))
    return F.transform_values(kept, lambda _, x: F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("...[truncated]"))).otherwise(x))


def cultural_context(v: Column, language: str = "en", country: str = "AU") -> Column:
    """The cultural context that a profile has, else a default one."""
    return F.coalesce(F.nullif(F.nullif(v, F.lit("")), F.lit("{}")),
        F.to_json(F.struct(F.lit(language).alias("language"), F.lit(country).alias("country"))))


def source_system(v: Column, suffix: str) -> Column:
    """Whether a source system's name ends like ``_suffix`` by LIKE, where the underscore stands for any character."""
    return v.like(f"%_{suffix}")
