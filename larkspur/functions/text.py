"""Text normalisers and identifier rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normalize_identifier

# fixed values: words and phrases that name no medicine
SALTS = [
    "hydrochloride", "arginine", "berbumine", "tosylate", "succinate", "maleate", "fumarate", "tartrate", "phosphate", "sulfate",
    "sulphate", "acetate", "citrate", "lactate", "oxalate", "benzoate", "trihydrate", "dihydrate", "monohydrate", "anhydrous",
]
RELEASES = ["tablet (extended release)", "tablet (modified release)", "tablet (enteric coated)", "capsule (extended release)",
    "capsule (modified release)"]
# fixed values: entity types that share a rule
MEDICATION, PROCEDURE = ("medication", "immunization"), ("procedure",)
DIAGNOSIS, MEASURED = ("diagnosis", "allergy", "symptom"), ("vital_sign", "lab_result", "physical_finding")
# fixed values: patterns of identifier types, tried in order; only the first alternative of each is anchored
IDENTIFIER_TYPES = [
    ("MRN", r"^MRN|MEDICAL.?RECORD|PATIENT.?ID|HOSPITAL.?ID"), ("MEDICARE", r"^MEDICARE|MCARE|MC"),
    ("INSURANCE", r"^INSURANCE|HEALTH.?FUND|PRIVATE.?HEALTH|PHI"), ("IHI", r"^IHI|INDIVIDUAL.?HEALTH"), ("DVA", r"^DVA|VETERAN"),
    ("PENSION_CARD", r"^PENSION|CONCESSION"), ("HEALTHCARE_CARD", r"^HEALTHCARE.?CARD|HCC"),
]


def squeezed(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def plain_number(v: Column) -> Column:
    """A double without needless digits: 500, 0.5."""
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.10f", v), "0+$", ""))


def in_milligrams(v: Column, unit: str, factor: float) -> Column:
    """Each amount in ``unit`` as milligrams: what stands between the matches is joined with the amounts in turn."""
    pattern = rf"(?i)(\d+\.?\d*)\s*{unit}\b"
    amounts = F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(1)),
        lambda n: F.concat(plain_number(n.cast("double") * factor), F.lit(" mg")))
    return F.array_join(F.transform(F.split(v, pattern, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(amounts, i), F.lit("")))), "")


def medication_text(name: Column, search: Column) -> Column:
    """A medicine's name without salts, with plain release forms and milligrams, and the brand that follows it."""
    low, sought = F.lower(F.trim(name)), F.lower(F.trim(search))
    v = F.regexp_replace(F.regexp_replace(low, r"\(as [^)]+\)", ""), r"\(containing [^)]+\)", "")
    v = F.regexp_replace(v, rf"\b(?:{'|'.join([*SALTS, 'containing'])})\b", "")
    for form in RELEASES:
        v = F.replace(v, F.lit(form), F.lit(form.replace("(", "").replace(")", "")))
    v = in_milligrams(in_milligrams(v, "g", 1000.0), "mcg", 0.001)
    brand = F.when(F.startswith(sought, low) & (F.length(sought) > F.length(low)), F.trim(F.substring(sought, F.length(low) + 1, F.length(sought))))
    return squeezed(F.when(F.length(brand).between(1, 49) & ~F.contains(v, brand), F.concat(v, F.lit(" "), brand)).otherwise(v))


def procedure_text(name: Column) -> Column:
    """A procedure's name without schedule codes and phrases of the schedule."""
    return squeezed(F.regexp_replace(F.lower(F.trim(name)), r"\bmbs\s+\d+\b|\bt\d+\b|initiation of management of|including but not limited to", ""))


def code_text(kind: Column, name: Column, search: Column) -> Column:
    """The normaliser of an entity type; lower case for types without one."""
    return F.when(kind == "medication", medication_text(name, search)).when(kind == "procedure",
        procedure_text(name)).otherwise(F.lower(F.trim(name)))


def embedding_text(kind: Column, text: Column, meaning: Column, context: Column) -> Column:
    """The text to embed: a longer interpretation of diagnoses and procedures, measurements with their context."""
    told = F.length(F.coalesce(meaning, F.lit(""))) > F.length(text)
    return (
        F.when(kind.isin(*DIAGNOSIS, *PROCEDURE) & told, meaning)
        .when(kind.isin(*MEASURED), F.trim(F.concat_ws(" ", text, F.when(context != "", context))))
        .otherwise(text)
    )


def identifier_type(told: Column, value: Column) -> Column:
    """The type of an identifier by what it is called, else by ten digits, else its name in capitals."""
    name = F.upper(F.trim(told))
    out = F
    for kind, pattern in IDENTIFIER_TYPES:
        out = out.when(name.rlike(pattern), kind)
    ten = normalize_identifier(value).rlike(r"^\d{10}$")
    return out.when(ten, "MEDICARE").otherwise(F.regexp_replace(name, r"\s+", "_"))


def identifier_warning(kind: Column, value: Column) -> Column:
    """What is wrong with the format of a normalised identifier; null where nothing is."""
    n = F.length(value)
    said = lambda text, end="": F.concat(F.lit(text), n.cast("string"), F.lit(end))
    return (
        F.when(kind == "MEDICARE", F.when(~value.rlike(r"^\d{10,11}$"), said("Medicare number should be 10-11 digits, got ")))
        .when(kind == "IHI", F.when(~value.rlike(r"^\d{16}$"), said("IHI should be 16 digits, got ")))
        .when(kind == "MRN", F.when(~n.between(2, 20), said("MRN length unusual: ", " characters")))
        .when(kind == "INSURANCE", F.when(~n.between(3, 30), said("Insurance ID length unusual: ", " characters")))
        .when(kind == "DVA", F.when(~n.between(3, 15), said("DVA number length unusual: ", " characters")))
        .otherwise(F.when(n == 0, "Identifier value is empty after normalization"))
    )


def cleaned_marker(v: Column) -> Column:
    """A marker without quotes, white space squeezed."""
    return squeezed(F.regexp_replace(v, "[\"'`]", ""))


def shared_words(a: Column, b: Column) -> Column:
    """Words of a that hold, or are held by, a word of b, over the greater number of words."""
    words = lambda v: F.split(F.lower(F.trim(v)), r"\s+")
    met = F.filter(words(a), lambda w: F.exists(words(b), lambda v: F.contains(w, v) | F.contains(v, w)))
    return F.size(met) / F.greatest(F.size(words(a)), F.size(words(b)))


def first_number(v: Column) -> Column:
    """The first number in a string."""
    return F.regexp_extract(v, r"(\d+\.?\d*)", 1).try_cast("double")


def blood_pressure(v: Column) -> Column:
    """struct<systolic, diastolic> of n/n."""
    part = lambda i: F.regexp_extract(v, r"(\d+)\s*/\s*(\d+)", i).try_cast("int")
    return F.struct(part(1).alias("systolic"), part(2).alias("diastolic"))


def synonyms(v: Column) -> Column:
    """Parts between semicolons, trimmed, of 1 to 199 characters, each once in their order."""
    return F.array_distinct(F.filter(F.transform(F.split(v, ";"), lambda s: F.trim(s)), lambda s: F.length(s).between(1, 199)))


def search_text(name: Column, component: Column, system: Column, other: Column) -> Column:
    """Name, component, system and up to ten synonyms that are longer than two characters or well known."""
    told = F.slice(F.filter(other, lambda s: (F.length(s) > 2) | F.upper(s).isin("BP", "HR", "A1C")), 1, 10)
    return F.concat_ws(" ", *(F.when(F.trim(c) != "", c) for c in (name, component, system)), told)


def valid_phone(v: Column) -> Column:
    """Digits, spaces, hyphens and brackets, ten at least, a plus before them at most (F32)."""
    return v.rlike(r"^\+?[\d\s\-\(\)]{10,}$")


def formatted_phone(v: Column) -> Column:
    """(ddd) ddd-dddd for ten digits, else as it is (F32)."""
    d = F.regexp_replace(v, r"\D", "")
    return F.when(F.length(d) == 10, F.concat(F.lit("("), F.left(d, F.lit(3)), F.lit(") "), F.substring(d, 4, 3), F.lit("-"),
        F.substring(d, 7, 4))).otherwise(v)


def title(*parts: Column) -> Column:
    """Capitalised words of the parts; null where one is null."""
    return F.initcap(F.concat(*(p if i == 0 else F.concat(F.lit(" "), p) for i, p in enumerate(parts))))


def rollout(identity: Column, percent: int) -> Column:
    """Whether an identity falls into a rollout of so many percent, by its hash."""
    return F.pmod(F.xxhash64(identity), F.lit(100)) < percent


def cascade_id(*parts: Column) -> Column:
    """cascade_<eight hex digits> of the parts."""
    return F.concat(F.lit("cascade_"), F.left(F.md5(F.concat_ws("_", *(p.cast("string") for p in parts))), F.lit(8)))


def pending_id(session: Column, chunk: Column, number: Column) -> Column:
    """pending_<session>_<chunk, three digits>_<number, three digits>."""
    return F.concat_ws("_", F.lit("pending"), session.cast("string"), F.lpad(chunk.cast("string"), 3, "0"), F.lpad(number.cast("string"), 3, "0"))


def json_object_of(v: Column) -> Column:
    """The JSON object in a model's answer: a fenced block, else from the first to the last brace, else null."""
    fenced = F.regexp_extract(v, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(v, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")))


def words_of(text: Column, separator: str) -> Column:
    """The parts of a text between separators, empty ones too (F93); a null text has no parts, an empty one none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\Q" + separator.replace(r"\E", "") + r"\E"))


def words_joined(parts: Column, separator: str) -> Column:
    """Parts as one text, without those that are null or empty."""
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), separator)
