"""What models answer: JSON, entities, zones, errors, costs and checks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: entity types and what else they are called
TYPES = ["medication", "condition", "procedure", "lab_result", "vital_sign", "allergy", "physical_finding", "observation", "immunisation"]
CALLED = {
    "medication": ["med", "drug", "prescription", "rx"], "condition": ["diagnosis", "disease", "problem", "dx"],
    "procedure": ["surgery", "operation", "treatment"], "lab_result": ["lab", "labs", "test", "test_result", "laboratory"],
    "vital_sign": ["vital", "vitals"], "allergy": ["allergies", "sensitivity"], "physical_finding": ["finding", "exam_finding", "physical"],
    "observation": ["note", "clinical_note"], "immunisation": ["immunization", "immunizations", "immunisations", "vaccine", "vaccination"],
}
# fixed values: what an error's message says, in the order in which it is looked for: all words of one of the lists
MESSAGES = [
    ("RATE_LIMIT", [["rate_limit"], ["rate limit"], ["429"]]), ("API_TIMEOUT", [["timeout"], ["timed out"], ["etimedout"]]),
    ("CONTEXT_TOO_LARGE", [["context_length"], ["context length"], ["maximum context"], ["too many tokens"]]),
    ("API_AUTH", [["authentication"], ["unauthorized"], ["invalid api key"], ["invalid_api_key"]]),
    ("API_5XX", [["econnreset"], ["econnrefused"], ["enotfound"], ["socket hang up"], ["network"], ["connection"]]),
    ("PARSE_JSON", [["json", "parse"], ["json", "syntax"], ["json", "unexpected token"], ["json", "invalid"]]),
    ("PARSE_SCHEMA", [["schema"], ["validation"], ["missing required"], ["invalid type"]]),
        ("EMPTY_RESPONSE", [["empty", "response"], ["empty", "content"]]),
    ("DB_ERROR", [["database"], ["supabase"], ["postgres"], ["constraint"], ["foreign key"], ["duplicate key"]]),
    ("ENCOUNTER_NOT_FOUND", [["encounter", "not found"]]), ("OCR_QUALITY_LOW", [["ocr", "quality"], ["ocr", "confidence"]]),
]
RETRYABLE = ["RATE_LIMIT", "API_TIMEOUT", "API_5XX", "PARSE_JSON", "PARSE_SCHEMA", "EMPTY_RESPONSE", "DB_ERROR"]


def answer_json(v: Column) -> Column:
    """struct<json, error> of a model's answer (F33): a fenced block, else from the first to the last brace, else a list, else an error."""
    t = F.trim(v)
    fenced, braces = F.regexp_extract(t, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1), F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    found = F.coalesce(F.nullif(F.trim(fenced), F.lit("")), F.nullif(braces, F.lit("")), F.when(t.startswith("{") | t.startswith("["), t))
    error = F.when(F.coalesce(t, F.lit("")) == "", "EMPTY_RESPONSE").when(found.isNull(), "PARSE_JSON")
    return F.struct(F.when(error.isNull(), found).alias("json"), error.alias("error"))


def entity_type(v: Column) -> Column:
    """The entity type that a word means, null where it means none."""
    names = {c: t for t, called in CALLED.items() for c in [t, *called]}
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.lower(F.trim(v)))


ENTITY = "struct<id:string,original_text:string,entity_type:string,page_number:string,y_coordinate:string,aliases:array<string>>"
ZONE = "struct<schema_type:string,page_number:string,y_start:string,y_end:string,entity_count:string>"


def whole(v: Column) -> Column:
    """The whole number that a text begins with."""
    return F.regexp_extract(F.trim(v), r"^(-?\d+)", 1).try_cast("int")


def entities(answers: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """(entities, errors) of the array ``entities`` of each answer (F95, L09): defaults for page and id, up to three aliases; an
    entity without text or with an unknown type is an error."""
    rows = answers.select(key, F.posexplode(F.from_json(F.get_json_object(json, "$.entities"), f"array<{ENTITY}>")).alias("index", "e"))
    kind, text = entity_type(F.col("e.entity_type")), F.trim("e.original_text")
    error = (
        F.when(F.coalesce(text, F.lit("")) == "", "missing original_text").when(F.coalesce(F.col("e.entity_type"), F.lit("")) == "",
            "missing entity_type")
        .when(kind.isNull(), F.concat(F.lit("invalid entity_type: "), F.col("e.entity_type")))
    )
    rows = rows.withColumn("error", error)
    aliases = F.slice(F.filter(F.transform("e.aliases", lambda a: F.trim(a)), lambda a: a != ""), 1, 3)
    good = rows.where("error IS NULL").select(
        key, "index", F.coalesce("e.id", F.concat(F.lit("e"), (F.col("index") + 1).cast("string"))).alias("id"), text.alias("original_text"),
            kind.alias("entity_type"),
        F.coalesce(whole(F.col("e.page_number")), F.lit(1)).alias("page_number"), whole(F.col("e.y_coordinate")).alias("y_coordinate"),
        F.coalesce(aliases, F.array().cast("array<string>")).alias("aliases"),
    )
    return good, rows.where("error IS NOT NULL").select(key, "index", "error")


def zones(answers: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """(zones, errors) of the array ``zones`` of each answer (F96): bounds in order, a zone of no height gets one."""
    rows = answers.select(key, F.posexplode(F.from_json(F.get_json_object(json, "$.zones"), f"array<{ZONE}>")).alias("index", "z"))
    a, b = whole(F.col("z.y_start")), whole(F.col("z.y_end"))
    error = F.when(F.coalesce(F.trim("z.schema_type"), F.lit("")) == "", "missing schema_type").when(a.isNull(), "missing y_start").when(b.isNull(),
        "missing y_end")
    rows = rows.withColumn("error", error)
    low = F.least(a, b)
    good = rows.where("error IS NULL").select(
        key, "index", F.lower(F.trim("z.schema_type")).alias("schema_type"), F.coalesce(whole(F.col("z.page_number")), F.lit(1)).alias("page_number"),
        low.alias("y_start"), F.greatest(a, b, low + 1).alias("y_end"), whole(F.col("z.entity_count")).alias("entity_count"),
    )
    return good, rows.where("error IS NOT NULL").select(key, "index", "error")


def error_code(message: Column, status: Column) -> Column:
    """The kind of an error (F35): by its status, else by the first rule whose words its message has."""
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(status == 429, "RATE_LIMIT").when(status.isin(401, 403), "API_AUTH").when(status.between(500, 599),
        "API_5XX").when(status.between(400, 499), "API_4XX")
    for code, lists in MESSAGES:
        some = None
        for words in lists:
            every = None
            for w in words:
                every = F.contains(m, F.lit(w)) if every is None else every & F.contains(m, F.lit(w))
            some = every if some is None else some | every
        out = out.when(some, code)
    return out.otherwise("INTERNAL_ERROR")


def retryable(code: Column) -> Column:
    return code.isin(*RETRYABLE)


def estimated_tokens(text: Column, overhead: int = 0) -> Column:
    """A token for four characters, begun ones counted, and an overhead."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4) + overhead


def with_cost(calls: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Adds cost: tokens in and out by the model's price per million, by default prices where it has none.

    The prices, a row a model, go to all tasks: a shuffle by model would put all calls into as many tasks as there are models.
    """
    rows = calls.join(F.broadcast(prices.select("model", "price_in", "price_out")), "model", "left")
    price = lambda c, d: F.coalesce(c, F.lit(d))
    cost = (F.coalesce("tokens_in", F.lit(0)) * price("price_in", default[0]) + F.coalesce("tokens_out", F.lit(0)) * price("price_out",
        default[1])) / 1e6
    return rows.withColumn("cost", F.round(cost, 9)).drop("price_in", "price_out")


def output_quality(critical: Column, warnings: Column, confidence: Column, completeness: Column) -> Column:
    """100 less 25 a critical and 5 a lesser problem, 20 times what confidence lacks of 0.9, half of what completeness lacks of 50; within
    0 and 100 (F78)."""
    score = 100 - 25 * critical - 5 * warnings - F.greatest(F.lit(0.0), 0.9 - confidence) * 20 - F.greatest(F.lit(0.0), 50 - completeness) * 0.5
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def checked_output(rows: DataFrame) -> DataFrame:
    """Adds issues, score and valid to model outputs (Q14): rows have confidence, completeness, medication, dosage, ocr_text, patient_name."""
    words = F.filter(F.split(F.lower(F.coalesce("patient_name", F.lit(""))), r"\s+"), lambda w: F.length(w) > 2)
    seen = lambda w: F.contains(F.lower("ocr_text"), w)
    c = F.col("confidence")
    critical = [("low_confidence", c < 0.8), ("name_not_in_text", (F.size(words) > 0) & ~F.exists(words, seen))]
    lesser = [
        ("moderate_confidence", (c >= 0.8) & (c < 0.9)), ("bad_dosage",
            F.col("dosage").isNotNull() & ~F.col("dosage").rlike(r"(?i)^\d+(\.\d+)?\s*(mg|g|mcg|ml|units?)$")),
        ("medication_not_in_text", F.col("medication").isNotNull() & ~seen(F.left(F.lower("medication"), F.lit(6)))),
    ]
    named = lambda pairs: F.filter(F.array(*(F.when(F.coalesce(w, F.lit(False)), F.lit(n)) for n, w in pairs)), lambda x: x.isNotNull())
    rows = rows.withColumn("critical", named(critical)).withColumn("warnings", named(lesser))
    rows = rows.withColumn("score", F.round(output_quality(F.size("critical"), F.size("warnings"), c, F.col("completeness")), 4))
    return rows.withColumn("valid", (F.size("critical") == 0) & (F.col("score") >= 80))
