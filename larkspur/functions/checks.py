"""Checks of single values, and names in their normal form, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mask_identifier, truncated
from .text import squeezed

# fixed values: words of dosage forms and of frequencies
FORMS = "tablet|capsule|injection|syrup|cream|ointment|oral liquid|suppository|pessary|powder|solution|suspension"
AMOUNT = r"\d+(?:\.\d+)?\s*(?:mg|g|ml|mcg|micrograms?|milligrams?)"
FREQUENCIES = ["daily", "once.*day", "twice.*day", "three.*times.*day", "every.*hours?", "bid", "tid", "qid", r"q\d+h", "weekly", "monthly",
    "as.*needed", "prn"]
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def medication_name(v: Column) -> Column:
    """A medicine's name without forms and units."""
    return F.trim(F.regexp_replace(squeezed(F.lower(v)), r"\b(tablet|capsule|mg|mcg|ml|units?)\b", ""))


def plain_name(v: Column) -> Column:
    """An allergen's, a condition's or a test's name: lower case, squeezed."""
    return squeezed(F.lower(v))


def provider_name(v: Column) -> Column:
    """A provider's name without titles."""
    return squeezed(F.regexp_replace(F.lower(v), r"\b(dr\.?|doctor|md|do|np|pa)\b", ""))


def ingredient(v: Column) -> Column:
    """What a medicine is made of: its name without amounts, forms, salts and brands (F16)."""
    out = F.regexp_replace(F.lower(v), rf"{AMOUNT}(?:\s*-\s*{AMOUNT})?", "")
    for pattern in (rf"\b({FORMS})\b", r"\b(containing|with)\b", r"\([^)]+\)"):
        out = F.regexp_replace(out, pattern, "")
    return squeezed(out)


def procedure_core(v: Column) -> Column:
    """A procedure without durations and settings (F16)."""
    out = F.regexp_replace(F.lower(v), r"\b(not more than|less than|at least)\s+\d+\s+(minutes?|hours?)\b", "")
    return squeezed(F.regexp_replace(out, r"\b(professional attendance|at consulting rooms|in hospital|by a|of a)\b", ""))


def valid_dosage(v: Column) -> Column:
    """An amount with a unit, or a fraction of a tablet."""
    return v.rlike(r"(?i)^\d+(\.\d+)?\s*(mg|mcg|g|ml|tablet|capsule|unit|iu|tsp|tbsp)") | v.rlike(r"(?i)^\d+/\d+\s*(tablet|capsule)")


def valid_frequency(v: Column) -> Column:
    """Words that tell how often."""
    return v.rlike(f"(?i){'|'.join(FREQUENCIES)}")


def valid_blood_pressure(v: Column) -> Column:
    return v.rlike(r"(?i)^\d{2,3}/\d{2,3}(\s*(mmhg|mm hg))?$")


def valid_heart_rate(v: Column) -> Column:
    return v.rlike(r"(?i)^\d{2,3}(\s*(bpm|beats.*min))?$")


def valid_lab_value(v: Column) -> Column:
    return v.rlike(r"\d")


def valid_date(v: Column, year: int) -> Column:
    """An ISO date behind 1900 and up to the next year."""
    return F.coalesce(v.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.year(F.try_to_timestamp(v, F.lit("yyyy-MM-dd"))).between(1901, year + 1), F.lit(False))


def matches_any(v: Column, pattern: str) -> Column:
    """A regular expression in any case; null matches nothing."""
    return F.coalesce(v.rlike(f"(?i){pattern}"), F.lit(False))


def content_hash(v: Column) -> Column:
    """SHA-256 of a text or of bytes."""
    return F.sha2(v, 256)


def redacted_file(v: Column) -> Column:
    """How many bytes a base64 text stands for."""
    return F.when(F.coalesce(v, F.lit("")) == "", "[NO_DATA]").otherwise(F.concat(F.lit("[BASE64_REDACTED:"), F.length(F.unbase64(v)).cast("string"),
        F.lit("_bytes]")))


def redacted_log(patient: Column, ocr: Column, prompt: Column, data: Column, most: int = 200) -> Column:
    """struct of what a log may show of a request (F27): parts that are missing are null."""
    has = lambda v, shown: F.when(F.coalesce(v, F.lit("")) != "", shown)
    return F.struct(
        has(patient, mask_identifier(patient)).alias("patient_id_masked"), has(ocr, truncated(ocr, most)).alias("ocr_text_preview"),
        has(prompt, truncated(prompt, most)).alias("prompt_preview"), has(data, redacted_file(data)).alias("file_data"),
    )


def record_ids(v: Column, fallback: Column) -> Column:
    """struct<record_id, record_id_text>: an id that is a UUID, else a fallback beside the text."""
    is_uuid = F.coalesce(v.rlike(UUID), F.lit(False))
    return F.struct(F.when(is_uuid, v).otherwise(fallback).alias("record_id"), F.when(~is_uuid, v).alias("record_id_text"))


def within_size(v: Column, most: int) -> Column:
    """Whether a request's body is short enough to be looked at."""
    return F.octet_length(F.coalesce(v, F.lit(""))) <= most
