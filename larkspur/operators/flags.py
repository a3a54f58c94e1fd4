"""Quality rules over extracted records: raised flags, the confidence gate, and their order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import age_years, name_similarity
from ..functions.dates import corrected_year, days_ahead
from ..functions.text import first_number, formatted_phone, shared_words, valid_phone

# fixed values: the confidence from which on a raised flag of a problem is kept
THRESHOLDS = {
    "future_date_check": 0.8, "ancient_date_check": 0.7, "appointment_weekend_check": 0.6, "birth_date_consistency": 0.9,
    "name_similarity_check": 0.8, "age_consistency_check": 0.7, "contact_format_check": 0.6, "age_appropriate_condition": 0.7,
    "gender_specific_condition": 0.8, "species_appropriate_condition": 0.9, "impossible_vital_ranges": 0.8, "profile_demographic_mismatch": 0.8,
    "provider_specialty_mismatch": 0.6, "low_ocr_confidence": 0.5, "incomplete_extraction": 0.6, "conflicting_data_points": 0.7,
}
# fixed values: words that tell of an age, a species or a kind of profile
CHILDREN_ONLY, ADULTS_ONLY, ELDERLY = ["colic", "cradle cap", "infant reflux"], ["copd", "alzheimer", "osteoporosis", "menopause"], ["dementia",
    "parkinson", "heart failure"]
NOT_FOR_PETS = ["aspirin", "ibuprofen", "acetaminophen"]
RANGES = {
    "blood pressure systolic": (60.0, 250.0, "mmHg"), "blood pressure diastolic": (30.0, 150.0, "mmHg"), "heart rate": (20.0, 200.0, "bpm"),
    "temperature": (90.0, 110.0, "F"), "weight": (2.0, 800.0, "lbs"), "height": (10.0, 96.0, "inches"),
}
PET_WEIGHT = (0.5, 200.0, "lbs")
SECTIONS = {"patient_info": 2.0, "appointments": 1.5, "medications": 1.0, "lab_results": 1.0, "diagnoses": 1.5, "vitals": 1.0}


@dataclass
class Rule:
    """A problem of a row: when it holds, how grave and sure it is, and what the value might be instead."""

    code: str
    when: Column
    severity: Column | str
    confidence: Column | float
    field: str
    raw: Column
    suggestion: Column | None = None
    fixable: Column | bool = False

    def flag(self) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        none = F.lit(None).cast("string")
        return F.when(F.coalesce(self.when, F.lit(False)), F.struct(
            F.lit(self.code).alias("problem_code"), lit(self.severity).alias("severity"), lit(self.confidence).cast("double").alias("confidence"),
                F.lit(self.field).alias("field"),
            self.raw.cast("string").alias("raw_value"),
                none.alias("suggestion") if self.suggestion is None else self.suggestion.cast("string").alias("suggestion"),
                lit(self.fixable).alias("auto_resolvable")))


def any_word(v: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(v), F.lit(w)) for w in words))


def raised(rows: DataFrame, table: str, rules: list[Rule], keep: tuple[str, ...] = ("document_id", "profile_id")) -> DataFrame:
    """A row for each rule that a row of ``rows`` breaks: one projection, no shuffle."""
    found = F.filter(F.array(*(r.flag() for r in rules)), lambda f: f.isNotNull())
    return rows.select(*keep, F.lit(table).alias("record_table"), F.inline(found))


def surviving(flags: DataFrame) -> DataFrame:
    """Flags whose confidence reaches the threshold of their problem, with severity_rank for ordering."""
    limit = F.create_map(*(F.lit(x) for kv in THRESHOLDS.items() for x in kv))
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return flags.where(F.col("confidence") >= F.element_at(limit, F.col("problem_code"))).withColumn("severity_rank", rank)


def appointment_rules(as_of: Column) -> list[Rule]:
    """More than twelve months of thirty days ahead (Q01); before birth (Q02). Rows have date and date_of_birth."""
    date = F.col("date")
    return [
        Rule("future_date_check", days_ahead(date, as_of) / 30 > 12, "warning", 0.85, "date", date, corrected_year(date, as_of)),
        Rule("birth_date_consistency", date < F.col("date_of_birth"), "critical", 0.95, "date", date),
    ]


def lab_rules(as_of: Column) -> list[Rule]:
    """Results from the future (Q03): a warning beyond 30 days, resolvable up to 7."""
    date, ahead = F.col("date"), F.ceil(days_ahead(F.col("date"), as_of))
    return [Rule("future_date_check", ahead > 0, F.when(ahead > 30, "warning").otherwise("info"), 0.8, "date", date, corrected_year(date, as_of),
        ahead <= 7)]


def identity_rules(as_of: Column) -> list[Rule]:
    """Name (Q04), age (Q05) and phone (Q06) against the profile: display_name, profile_birth."""
    like = name_similarity(F.col("name"), F.col("display_name"))
    told = (F.col("name") != "") & (F.col("display_name") != "")
    ages = F.abs(age_years(F.col("date_of_birth"), as_of) - age_years(F.col("profile_birth"), as_of))
    return [
        Rule("name_similarity_check", told & (like < 0.6), "critical", 1 - like, "name", F.col("name"), F.col("display_name")),
        Rule("age_consistency_check", ages > 1, "warning", 0.8, "date_of_birth", F.col("date_of_birth"), F.col("profile_birth")),
        Rule("contact_format_check", (F.col("phone") != "") & ~valid_phone(F.col("phone")), "info", 0.7, "phone", F.col("phone"),
            formatted_phone(F.col("phone")), True),
    ]


def condition_rules(as_of: Column) -> list[Rule]:
    """Conditions that do not fit the age (Q07): the first of three cases that holds."""
    age, c = age_years(F.col("date_of_birth"), as_of), F.col("condition")
    case = F.when((age < 18) & any_word(c, ADULTS_ONLY), 1).when((age > 18) & any_word(c, CHILDREN_ONLY), 2).when((age < 65) & any_word(c, ELDERLY),
        3)
    return [Rule("age_appropriate_condition", case.isNotNull(), F.when(case == 3, "info").otherwise("warning"),
        F.when(case == 1, 0.8).when(case == 2, 0.7).otherwise(0.6), "condition", c)]


def vital_rules() -> list[Rule]:
    """Measurements outside the range of the first kind that their type names and they break (Q08)."""
    kind, value = F.lower("type"), F.regexp_extract(F.trim("value"), r"^(-?\d+\.?\d*)", 1).try_cast("double")
    pet = F.col("profile_type") == "pet"
    broken = F
    for name, (low, high, unit) in RANGES.items():
        least, most = F.lit(low), F.lit(high)
        said = F.lit(f"{low:g}-{high:g} {unit}")
        if name == "weight":
            least, most = F.when(pet, PET_WEIGHT[0]).otherwise(least), F.when(pet, PET_WEIGHT[1]).otherwise(most)
            said = F.when(pet, f"{PET_WEIGHT[0]:g}-{PET_WEIGHT[1]:g} lbs").otherwise(said)
        broken = broken.when(F.contains(kind, F.lit(name)) & ((value < least) | (value > most)), said)
    return [Rule("impossible_vital_ranges", broken.isNotNull(), "warning", 0.8, "value", F.col("value"), broken)]


def pet_rules() -> list[Rule]:
    """Medicines that are not for animals, on a pet's profile (Q09)."""
    pet = (F.col("profile_type") == "pet") & F.col("species").isNotNull()
    return [Rule("species_appropriate_condition", pet & any_word(F.col("name"), NOT_FOR_PETS), "critical", 0.9, "name", F.col("name"))]


def suggested_profile(appointments: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """(document_id, suggested): the kind of profile that a document's providers and conditions vote for (Q10)."""
    p, c = F.coalesce("provider", F.lit("")), F.col("condition")
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    votes = appointments.select("document_id", points(any_word(p, ["vet"]), 2).alias("pet"), points(any_word(p, ["pediatric"]), 2).alias("child"),
        points(any_word(p, ["obgyn", "cardiologist"]), 1).alias("human")).unionByName(
        diagnoses.select("document_id", points(any_word(c, ["heartworm", "flea", "rabies vaccine"]), 2).alias("pet"),
            points(any_word(c, ["colic", "developmental"]), 1).alias("child"), F.lit(0).alias("human"))
    )
    n = votes.groupBy("document_id").agg(*(F.sum(k).alias(k) for k in ("pet", "child", "human")))
    kind = F.expr("CASE WHEN pet > human + child THEN 'pet' WHEN child > human AND child > 0 THEN 'child' WHEN human > 0 THEN 'self' END")
    return n.select("document_id", kind.alias("suggested"))


def profile_rules() -> list[Rule]:
    """A document that looks like another kind of profile than its own (Q10): grave between people and pets."""
    own, other = F.col("profile_type"), F.col("suggested")
    grave = ((own == "pet") & other.isin("self", "child")) | (own.isin("self", "child") & (other == "pet"))
    return [Rule("profile_demographic_mismatch", other != own, F.when(grave, "critical").otherwise("warning"), F.when(grave, 0.9).otherwise(0.7),
        "profile_assignment", own, other)]


def completeness(filled: dict[str, Column]) -> Column:
    """The weighted share of sections that hold something."""
    got = sum((F.when(F.coalesce(c, F.lit(False)), SECTIONS[k]).otherwise(0.0) for k, c in filled.items()), F.lit(0.0))
    return got / sum(SECTIONS.values())


def completeness_rules() -> list[Rule]:
    """Less than half of the sections' weight is there (Q11); rows have completeness."""
    return [Rule("incomplete_extraction", F.col("completeness") < 0.5, "warning", 0.8, "extraction_completeness", F.round("completeness", 4))]


#: fixed values: weights of the parts of a document in the earlier check
LEGACY_SECTIONS = {"patient_info": 2.0, "medical_data": 1.5, "dates": 1.0, "provider": 1.0}


def legacy_completeness(filled: dict[str, Column]) -> Column:
    """The weight of the parts that have any value over that of all (Q15)."""
    held = sum((F.when(F.coalesce(filled[n], F.lit(False)), w).otherwise(0.0) for n, w in LEGACY_SECTIONS.items()), F.lit(0.0))
    return held / sum(LEGACY_SECTIONS.values())


def legacy_rules(as_of: Column) -> list[Rule]:
    """The earlier checks of a document (Q15): a date of more than a month of thirty days ahead, with today as the suggestion; a name that
    shares few words with the profile's, as sure as it differs; less than four tenths of the parts filled.

    Rows have document_date, name, display_name and completeness (see ``legacy_completeness``). A check whose value is missing says nothing.
    """
    date, alike = F.col("document_date"), shared_words(F.col("name"), F.col("display_name"))
    named = (F.col("name") != "") & (F.col("display_name") != "")
    return [
        Rule("future_date_check", days_ahead(date, as_of) / 30 > 1, "warning", 0.85, "document_date", date, F.date_format(as_of, "yyyy-MM-dd")),
        Rule("name_similarity_check", named & (alike < 0.6), "critical", 1 - alike, "patient_name", F.col("name"), F.col("display_name")),
        Rule("incomplete_extraction", F.col("completeness") < 0.4, "warning", 0.8, "extraction_completeness", F.col("completeness")),
    ]


def same_day(appointments: DataFrame) -> DataFrame:
    """(document_id, dates): documents with several appointments on one day."""
    days = appointments.where("date IS NOT NULL").groupBy("document_id", "date").count().where("count > 1")
    dates = F.flatten(F.array_sort(F.collect_list(F.array_repeat(F.col("date").cast("string"), F.col("count").cast("int")))))
    return days.groupBy("document_id").agg(F.array_join(dates, ",").alias("dates"))


def conflict_rules() -> list[Rule]:
    return [Rule("conflicting_data_points", F.lit(True), "warning", 0.75, "date", F.col("dates"))]


def resolved(flags: DataFrame, decisions: DataFrame, key: str = "flag_id") -> DataFrame:
    """Flags with the status of their last decision, open where there is none (Q17): decisions have key, status, at, by."""
    last = decisions.groupBy(key).agg(F.max_by(F.struct("status", "at", "by"), F.struct("at", "status", "by")).alias("d"))
    return flags.join(last, key, "left").select(*flags.columns, F.coalesce(F.col("d.status"), F.lit("open")).alias("status"),
        F.col("d.at").alias("resolved_at"), F.col("d.by").alias("resolved_by"))


def flag_statistics(flags: DataFrame) -> DataFrame:
    """One row: totals by status and severity, resolution rate and mean hours to resolve."""
    done = F.col("status").isin("resolved", "ignored")
    hours = F.timestamp_diff("SECOND", F.col("created_at"), F.col("resolved_at")) / 3600
    return flags.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(done).alias("resolved"),
        *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")),
        F.round(F.coalesce(F.try_divide(100.0 * F.count_if(done), F.count("*")), F.lit(0.0)), 2).alias("resolution_rate"),
        F.round(F.avg(F.when(done, hours)), 4).alias("mean_hours"),
    )


def review_reasons(chunks: DataFrame, confidence: str = "confidence", limit: float = 0.7) -> DataFrame:
    """Chunks that were read with little confidence, and the reason for a review (Q18)."""
    said = F.concat(F.lit("Low confidence in chunk "), F.col("chunk").cast("string"), F.lit(": "), F.round(confidence, 2).cast("string"))
    return chunks.where(F.col(confidence) < limit).withColumn("reason", said)
