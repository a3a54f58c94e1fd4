"""Look-ups and lists over records of a patient, and what happens to tasks and grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .access import unexpired
from .graph import components
from .similar import edit_pairs

# fixed values: ranks of priorities, and events that are never left out
PRIORITIES = ["highest", "high", "medium", "low"]
REVIEWS = ["critical", "urgent", "high", "normal", "low"]


def rank_of(v: Column, names: list[str]) -> Column:
    """The place of a name in a list, behind all for another."""
    place = F.array_position(F.array(*map(F.lit, names)), v)
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(names) + 1).otherwise(place)


def is_critical(category: Column, action: Column, critical: list[str]) -> Column:
    """Whether category.action is on the list of critical events."""
    return F.concat_ws(".", category, action).isin(*critical)


def second_pass(entities: DataFrame, session: int | str | None = None, category: str | None = None, most: int = 100) -> DataFrame:
    """Entities that await a second pass, by priority, then by age (P20); parts of a document's structure are none."""
    rows = entities.where((F.col("status") == "pending") & (F.col("category") != "document_structure"))
    for column, value in (("session_id", session), ("category", category)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(rank_of(F.col("priority"), PRIORITIES), "created_at", "entity_id").limit(most)


def pending_reviews(reviews: DataFrame, patient: int | str) -> DataFrame:
    """A patient's open reviews by priority, then by age."""
    return reviews.where((F.col("patient_id") == patient) & (F.col("status") == "pending")).orderBy(rank_of(F.col("priority"), REVIEWS), "created_at",
        "review_id")


def active_records(rows: DataFrame, patient: int | str, date: str, active_only: bool = True) -> DataFrame:
    """A patient's records that are active and not archived, newest first."""
    some = rows.where((F.col("patient_id") == patient) & F.col("archived_at").isNull())
    return (some.where("status = 'active'") if active_only else some).orderBy(F.col(date).desc_nulls_last(), "id")


def sure_narratives(rows: DataFrame, minimum: float = 0.7) -> DataFrame:
    """Current narratives with no confidence or enough of it, the surest first and those without one last."""
    c = F.col("confidence")
    return rows.where(F.col("is_current") & (c.isNull() | (c >= minimum))).orderBy(c.desc_nulls_last(), "id")


def viewed_as(rows: DataFrame, kind: str, columns: dict[str, str], **constants: str) -> DataFrame:
    """Rows of one system that are not archived, under other names and with constants."""
    return rows.where((F.col("system") == kind) & F.col("archived_at").isNull()).select(*(F.col(c).alias(n) for n, c in columns.items()),
        *(F.lit(v).alias(n) for n, v in constants.items()))


def search_providers(providers: DataFrame, term: str | None = None, country: str | None = None, specialty: str | None = None,
    verified_only: bool = True) -> DataFrame:
    """Providers whose names or id hold a text, with the other conditions that are given, by family name."""
    rows = providers
    if term is not None:
        hit = F.lit(False)
        for c in ("given_names", "family_name", "public_id"):
            hit = hit | F.ilike(F.coalesce(F.col(c), F.lit("")), F.lit(f"%{term}%"))
        rows = rows.where(hit)
    if country is not None:
        rows = rows.where(F.col("country") == country)
    if specialty is not None:
        rows = rows.where(F.array_contains("specialties", specialty))
    if verified_only:
        rows = rows.where("verified")
    return rows.select("provider_id", F.concat_ws(" ", "given_names", "family_name").alias("full_name"), "country").orderBy("full_name",
        "provider_id")


def provider_records(rows: DataFrame, grants: DataFrame, provider: int | str, scope: str, as_of: Column) -> DataFrame:
    """Records of the patients who let a provider see them (N05): active grants that are not over and hold the scope."""
    mine = grants.where((F.col("provider_id") == provider) & (F.col("status") == "active") & unexpired(F.col("expires_at"),
        as_of) & F.array_contains("scope", scope))
    return rows.where(~F.coalesce("archived", F.lit(False))).join(mine.select("patient_id"), "patient_id", "left_semi")


def granted_access(grants: DataFrame, fresh: DataFrame, providers: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(grants after new ones come in, refused ones with the reason) (N11): only verified providers get one, an active grant of the same
    provider and patient is revoked."""
    checked = fresh.join(providers.select("provider_id", "verified"), "provider_id", "left")
    fine = checked.where("verified").drop("verified")
    reason = F.when(F.col("verified").isNull(), "provider_not_found").otherwise("provider_not_verified")
    refused = checked.where(~F.coalesce("verified", F.lit(False))).select("provider_id", "patient_id", reason.alias("reason"))
    hit = fine.select("provider_id", "patient_id").distinct().withColumn("_hit", F.lit(True))
    old = grants.join(hit, ["provider_id", "patient_id"], "left")
    over = F.col("_hit").isNotNull() & (F.col("status") == "active")
    old = old.withColumn("revoked_at", F.when(over, as_of).otherwise(F.col("revoked_at"))).withColumn("status",
        F.when(over, "revoked").otherwise(F.col("status"))).drop("_hit")
    new = fine.select("grant_id", "provider_id", "patient_id", F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("revoked_at"))
    return old.select(*new.columns).unionByName(new), refused


def answered_items(items: DataFrame, answers: DataFrame, permissions: DataFrame, as_of: Column) -> DataFrame:
    """Action items after their answers (item_id, provider_id, status, response) (N12): an answer counts if the provider may act for the patient; it is
    resolved at as_of only if it is completed or declined."""
    allowed = answers.join(items.select("item_id", "patient_id"), "item_id").join(permissions.select("provider_id", "patient_id").distinct(),
        ["provider_id", "patient_id"], "left_semi")
    last = allowed.groupBy("item_id").agg(F.max_by(F.struct("status", "response", "provider_id"), F.struct("status", "provider_id")).alias("a"))
    done = F.col("a.status").isin("completed", "declined")
    return items.join(last, "item_id", "left").select(
        "item_id", "patient_id", F.coalesce("a.status", "status").alias("status"), F.col("a.response").alias("response"),
            F.when(done, as_of).alias("resolved_at")
    )


def study_context(reports: DataFrame, visits: DataFrame) -> DataFrame:
    """(report_id, study, visit, follow_up) with the first two as JSON (N02, J16): follow_up lists the recommendations of a report's impression, whose text
    comes behind words that tell of one."""
    said = F.regexp_extract("impression", r"(?i)(?:recommend(?:ed|ation)?s?|follow[- ]?up)[:\s]+(.*)", 1)
    parts = F.filter(F.transform(F.split(said, r"[;.]"), lambda s: F.trim(s)), lambda s: s != "")
    rows = reports.join(visits.select("visit_id", "provider_name", "facility_name"), "visit_id", "left")
    study = F.to_json(F.struct("imaging_type", "body_region", F.date_format("study_date", "yyyy-MM-dd").alias("study_date")))
    return rows.select("report_id", study.alias("study"), F.to_json(F.struct("provider_name", "facility_name")).alias("visit"),
        parts.alias("follow_up"))


def expected_next(kind: Column) -> Column:
    """What is expected to follow a visit of a type (F36): the first rule whose word the type has."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    has = lambda *words: F.greatest(*(F.contains(k, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(k, F.lit(words[0]))
    return (
        F.when(has("admission", "inpatient"), "discharge_summary").when(has("surgery", "procedure"), "post_operative_notes").when(has("emergency"),
            "disposition_or_admission")
        .when(has("consultation"), "recommendations").when(has("diagnostic", "imaging"), "results_or_report").otherwise("continuation")
    )


def false_positive_rate(flags: DataFrame, rule: str = "rule", at: str = "at", ignored: str = "ignored") -> DataFrame:
    """(rule, rate, n) after each flag in order (A39): the mean of what was ignored, by the running form r + (x - r) / n.

    The running form and the mean agree, so a sum and a count do, whatever the number of flags of a rule.
    """
    return flags.groupBy(rule).agg((F.sum(F.when(F.col(ignored), 1.0).otherwise(0.0)) / F.count("*")).alias("rate"), F.count("*").alias("n"))


def health_checks(metrics: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """(metric, value, status) with OK, WARNING and CRITICAL by two limits each (A32, P10); rows have metric and value."""
    bounds = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in limits.items() for x in (k, float(v[i])))), F.col("metric"))
    status = F.when(F.col("value") >= bounds(1), "CRITICAL").when(F.col("value") >= bounds(0), "WARNING").otherwise("OK")
    return metrics.select("metric", "value", status.alias("status"))


def system_alerts(checks: DataFrame) -> DataFrame:
    """Checks that are not OK, the graver first."""
    return checks.where("status <> 'OK'").orderBy(F.when(F.col("status") == "CRITICAL", 0).otherwise(1), "metric")


def normalisation_stats(rows: DataFrame) -> DataFrame:
    """One row: documents in all, normalised, failed, waiting, and the rate in percent."""
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(
        F.count("*").alias("total"), n("normalized").alias("normalized"), n("failed").alias("failed"), n("pending").alias("pending"),
        F.round(F.coalesce(F.try_divide(100.0 * n("normalized"), F.count("*")), F.lit(0.0)), 2).alias("rate"),
    )


def performance_metrics(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row: mean confidence and duration of the last days, profiles active on the last one."""
    since = lambda n: F.col("at") >= F.timestamp_add("DAY", F.lit(-n), as_of)
    return runs.agg(
        F.round(F.avg(F.when(since(days), F.col("confidence"))), 6).alias("confidence"),
            F.round(F.avg(F.when(since(days), F.col("seconds"))), 6).alias("seconds"),
        F.count_distinct(F.when(since(1), F.col("profile_id"))).alias("active_profiles"),
    )


def merged_by_name(known: DataFrame, fresh: DataFrame, key: str = "patient_id") -> DataFrame:
    """Known records and new ones as one for each name of a patient (D05, U05): names are compared squeezed and in lower case; new values win where they are
    not null, sources are joined."""
    norm = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    both = known.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1))).withColumn("name_key", norm)
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", c))).alias(c)
    return both.groupBy(key, "name_key").agg(pick("value"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        (F.max("_new") == 1).alias("touched"))


def merged_by_similar_name(known: DataFrame, fresh: DataFrame, key: str = "patient_id", threshold: float = 0.8) -> DataFrame:
    """Known records and new ones as one for each group of nearly equal names of a patient (D05, J19, U05): names are squeezed and in lower case;
    those with an edit similarity from ``threshold`` on, and those that others link so, are one group.

    (key, name_key, names, value, sources, touched): the group's name is that of the least known one, or the least new one; new
    values win where they are not null, sources are joined. Rows with a null patient, or a null name, go by equality alone.
    """
    norm = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    both = known.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1))).withColumn("_name", norm)
    both = both.withColumn("_id", F.struct(key, "_name"))
    names = both.select(key, "_name").distinct()
    alike = edit_pairs(names, names, threshold, [key], "_name", "_name").where("left_text < right_text")
    pair = lambda text: F.struct(F.col(key), F.col(text).alias("_name"))
    groups = components(written(alike.select(pair("left_text").alias("a"), pair("right_text").alias("b"))))
    rows = both.join(groups.select(F.col("node").alias("_id"), "root"), "_id", "left")
    rows = rows.withColumn("_group", F.coalesce(F.col("root._name"), F.col("_name")))
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", c))).alias(c)
    merged = rows.groupBy(key, "_group").agg(
        F.min(F.struct("_new", "_name"))["_name"].alias("name_key"), F.array_sort(F.collect_set("_name")).alias("names"), pick("value"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), (F.max("_new") == 1).alias("touched"),
    )
    return merged.drop("_group")
