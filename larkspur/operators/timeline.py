"""Timelines: what becomes an event, pages of events, journeys, summaries and alerts; ``as_of`` stands where a clock would."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fulltext

# fixed values: how visits and purposes of events are shown: (category, icon, priority)
VISITS = {
    "outpatient": ("routine_visit", "building-hospital", 60), "emergency": ("emergency_visit", "emergency", 20),
        "specialist": ("specialist_consult", "user-doctor", 40),
    "telehealth": ("telehealth", "video", 70), "diagnostic": ("diagnostic_visit", "microscope", 50),
}
OBSERVATIONS = [("screening", "screening", "clipboard-check", 80, "preventive"), ("diagnostic", "test_result", "flask", 60, "diagnostic"),
    ("monitoring", "test_result", "chart-line", 70, "monitoring")]
INTERVENTIONS = [("therapeutic", "treatment", "medical-bag", 40, "treatment"), ("preventive", "vaccination", "syringe", 90, "preventive")]
#: What a question is about, by the first words that it has.
INTENTS = [("temporal", ["when", "date"]), ("medication", ["medication", "drug"]), ("test_results", ["test", "result"]),
    ("encounters", ["doctor", "visit"]), ("conditions", ["condition", "diagnosis"])]
PERIODS = [("1 month", "last month"), ("1 year", "last year"), ("current_year", "this year"), ("march", "march")]
MONTH_DAYS = 30.44


def has(v: Column, word: str) -> Column:
    return F.contains(F.lower(v), F.lit(word))


def timeline_filter(
    events: DataFrame, categories: Iterable[str] | None = None, since: str | None = None, until: str | None = None,
    min_value: float | None = None, search: str | None = None,
) -> DataFrame:
    """Events that meet every parameter which is given (P01, P02, P03, P06); the search text is literal, any case."""
    tests: list[Column] = []
    if categories is not None:
        tests.append(F.col("event_type").isin(*categories))
    if since is not None:
        tests.append(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        tests.append(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    if min_value is not None:
        tests.append(F.col("value") >= min_value)
    if search is not None:
        tests.append(F.lower("props").contains(search.lower()))
    return events.where(reduce(and_, tests)) if tests else events


def patient_timeline(
    events: DataFrame, patient: int | str, categories: list[str] | None = None, subcategories: list[str] | None = None, since: str | None = None,
        until: str | None = None,
    major_only: bool = False, search: str | None = None, tags: list[str] | None = None,
) -> DataFrame:
    """A patient's events that are not archived and meet every given parameter, newest first, then by priority (P02, P04, P05p, P07, N01).

    ``search`` goes by ILIKE: percent signs and underscores in it are wildcards (P06). ``tags`` wants one of them.
    """
    rows = events.where((F.col("patient_id") == patient) & ~F.coalesce("archived", F.lit(False)))
    for column, wanted in (("category", categories), ("subcategory", subcategories)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(*wanted))
    if since is not None:
        rows = rows.where(F.col("event_date") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.where(F.col("event_date") <= F.lit(until).cast("timestamp_ntz"))
    if major_only:
        rows = rows.where("is_major")
    if search is not None:
        rows = rows.where(F.ilike("searchable", F.lit(f"%{search}%")))
    if tags is not None:
        rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return rows.orderBy(F.desc("event_date"), "priority", "event_id")


def sort_column(name: str, direction: str, allowed: dict[str, str], default: str) -> Column:
    """The ordering that a caller asks for, of those on the list; else the default, newest first."""
    column = F.col(allowed.get(name, allowed[default]))
    return column.asc_nulls_last() if direction.lower() == "asc" else column.desc_nulls_last()


def offset_page(rows: DataFrame, owner: str, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page with the owner's number of rows in ``total`` (L05, W10, N04): limit within 1 and 1000, offset from 0 on."""
    total = F.count("*").over(Window.partitionBy(owner))
    return rows.withColumn("total", total).orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def keyset_page(rows: DataFrame, time: str, key: str, after: tuple[str, int] | None, size: int) -> DataFrame:
    """One page, newest first and by key within a time, after a cursor, with has_more.

    The scan keeps size + 1 rows a task, so paging costs the same on every page.
    """
    if after is not None:
        at = F.lit(after[0]).cast("timestamp_ntz")
        rows = rows.where((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) > after[1])))
    some = rows.orderBy(F.col(time).desc_nulls_last(), key).limit(size + 1)
    n = F.row_number().over(Window.orderBy(F.col(time).desc_nulls_last(), key))  # size + 1 rows
    seen = some.withColumn("n", n).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return seen.where(F.col("n") <= size).drop("n")


def by_day(events: DataFrame, most: int, newest_first: bool = True) -> DataFrame:
    """(day, events): the first ``most`` events in the wanted order, a row a day with their ids in that order."""
    order = [F.desc("ts") if newest_first else F.asc("ts"), F.asc("event_id")]
    some = events.orderBy(*order).limit(most)
    place = F.row_number().over(Window.orderBy(*order))  # ``most`` rows
    rows = some.withColumn("_n", place).groupBy(F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("_n",
        "event_id"))).alias("_e"))
    return rows.select("day", F.transform("_e", lambda e: e["event_id"]).alias("events"))


def first_case(*cases: tuple[Column, object]) -> Column:
    out = F
    for when, value in cases:
        out = out.when(when, value)
    return out if out is not F else F.lit(None)


def event_of_clinical(rows: DataFrame) -> DataFrame:
    """A timeline event for each clinical event (D16): rows have event_id, patient_id, activity_type, purposes (array), event_name, method,
    performed_by, body_site, event_date. Activities and purposes without a rule have no category."""
    seen, done = F.col("activity_type") == "observation", F.col("activity_type") == "intervention"
    rules = [(seen & F.array_contains("purposes", p), r) for p, *r in OBSERVATIONS] + [(done & F.array_contains("purposes", p), r) for p,
        *r in INTERVENTIONS]
    pick = lambda i: first_case(*((w, F.lit(r[i])) for w, r in rules))
    sub = first_case((seen & (pick(3) == "monitoring"), "monitoring"), (done & (pick(0) == "vaccination"), "preventive_care"),
        (pick(0).isNotNull(), F.col("method")))
    n, by, site = F.col("event_name"), F.col("performed_by"), F.col("body_site")
    blank = lambda c: F.coalesce(c, F.lit(""))
    summary = F.coalesce(F.concat(n, blank(F.concat(F.lit(" performed by "), by))),
        F.concat(F.lit("Clinical event on "), F.to_date("event_date").cast("string")))
    sought = F.concat(n, F.lit(" "), blank(by), F.lit(" "), blank(site), F.lit(" "), F.array_join("purposes", " "), F.lit(" "),
        F.col("activity_type"))
    return rows.select(
        "event_id", "patient_id", pick(0).alias("category"), sub.alias("subcategory"), F.coalesce(site, "method").alias("tertiary"),
        first_case((seen, F.concat(n, F.lit(" Result"))), (done, n)).alias("title"), summary.alias("summary"), pick(1).alias("icon"), "event_date",
        F.coalesce(pick(0) == "treatment", F.lit(False)).alias("is_major"), F.coalesce(pick(2), F.lit(100)).alias("priority"),
            sought.alias("searchable"),
        F.filter(F.array(pick(3)), lambda t: t.isNotNull()).alias("tags"),
    )


def event_of_visit(rows: DataFrame) -> DataFrame:
    """A timeline event for each visit (D16): rows have visit_id, patient_id, encounter_type, specialty, provider_name, facility_name, complaint,
    summary, visit_date."""
    kind = F.col("encounter_type")
    pick = lambda i, other: F.coalesce(first_case(*((kind == k, F.lit(v[i])) for k, v in VISITS.items())), F.lit(other))
    blank = lambda c: F.coalesce(c, F.lit(""))
    title = F.coalesce(F.concat("specialty", F.lit(" Visit")), F.concat(F.initcap(kind), F.lit(" Visit")))
    told = F.coalesce(F.concat(F.lit("Visit with "), "provider_name"), F.concat(F.lit("Healthcare visit at "), "facility_name"),
        F.concat(F.initcap(kind), F.lit(" healthcare encounter")))
    summary = F.when(F.col("complaint").isNotNull(), F.concat(told, F.lit(" - "), "complaint")).otherwise(told)
    routine = kind.isin("outpatient", "telehealth") & (blank(has(F.col("complaint"),
        "annual").cast("string")).eqNullSafe("true") | has(F.col("complaint"), "check") | has(F.col("summary"), "routine"))
    tags = F.filter(F.array(F.when(kind == "emergency", "urgent"), F.when(F.coalesce(routine, F.lit(False)), "routine")), lambda t: t.isNotNull())
    sought = F.concat_ws(" ", blank(F.col("provider_name")), blank(F.col("facility_name")), blank(F.col("specialty")), blank(F.col("complaint")),
        blank(F.col("summary")), kind)
    return rows.select(
        "visit_id", "patient_id", F.lit("visit").alias("category"), pick(0, "healthcare_visit").alias("subcategory"), title.alias("title"),
            summary.alias("summary"),
        pick(1, "hospital").alias("icon"), F.col("visit_date").alias("event_date"), F.lit(True).alias("is_major"), pick(2, 50).alias("priority"),
            sought.alias("searchable"), tags.alias("tags"),
    )


def identity_key(table: str) -> Column:
    """What tells a clinical fact from others (D01): codes first, then names; a fact of another table is its own."""
    c, text = F.col, lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    day = lambda d: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("unknown_date"))
    known = lambda *columns: reduce(and_, (c(x).isNotNull() for x in columns))
    if table == "medications":
        composite = text("composite:", F.lower("name"), ":", c("strength"), ":", F.coalesce(F.lower("form"), F.lit("unknown")))
        return first_case(*((known(f"{s}_code"), text(f"{s}:", c(f"{s}_code"))) for s in ("rxnorm", "pbs", "atc")),
            (known("name", "strength"), composite)).otherwise(text("fallback:", c("id").cast("string")))
    if table == "conditions":
        return F.when(known("code"), text(c("system"), ":", c("code"))).otherwise(text("normalized:", F.lower(F.trim("name"))))
    if table == "allergies":
        return F.when(known("code"), text("allergen_code:", c("code"))).otherwise(text("substance:", F.lower(F.trim("name"))))
    if table == "vitals":
        return text("vital:", c("type"), ":", day("date"))
    if table == "immunizations":
        return first_case((known("snomed_code"), text("snomed_vaccine:", c("snomed_code"), ":", day("date"))),
            (known("cvx_code"), text("cvx:", c("cvx_code"), ":", day("date")))).otherwise(text("vaccine:", F.lower("name"), ":", day("date")))
    return text("generic:", c("id").cast("string"))


def condition_journeys(events: DataFrame, visits: DataFrame) -> DataFrame:
    """(patient_id, condition_id, section, section_order, events): diagnosis, treatments and monitoring of each condition as JSON lists,
    the first from the oldest on, the others from the newest on; sections without events are left out (A37, A05, J02).

    An event that is a treatment and tagged for monitoring is in both lists.
    """
    rows = events.where(~F.coalesce("archived", F.lit(False)) & F.col("condition_id").isNotNull())
    rows = rows.join(visits.select("visit_id", "provider_name", "facility_name"), "visit_id", "left")
    monitored = F.coalesce(F.array_contains("tags", "monitoring"), F.lit(False)) | (F.col("category") == "test_result")
    sections = F.filter(F.array(F.when(F.col("category") == "diagnosis", F.lit(1)), F.when(F.col("category") == "treatment", F.lit(2)),
        F.when(monitored, F.lit(3))), lambda x: x.isNotNull())
    rows = rows.withColumn("section_order", F.explode(sections))
    days = F.unix_micros(F.col("event_date").cast("timestamp_ntz").cast("timestamp"))
    key = F.struct(F.when(F.col("section_order") == 1, days).otherwise(-days).alias("k"), F.col("event_id").alias("i"),
        F.to_json(F.struct("event_id", "title", F.date_format("event_date", "yyyy-MM-dd").alias("date"), "provider_name")).alias("j"))
    lists = rows.groupBy("patient_id", "condition_id", "section_order").agg(F.array_sort(F.collect_list(key)).alias("e"))
    name = F.element_at(F.array(F.lit("diagnosis"), F.lit("treatments"), F.lit("monitoring")), F.col("section_order"))
    return lists.select("patient_id", "condition_id", name.alias("section"), "section_order",
        F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["j"]), ","), F.lit("]")).alias("events"))


def journey_summary(events: DataFrame) -> DataFrame:
    """Per patient and condition: events of each kind, first and last date, kinds in order (A38, J03, A10): one join-free pass instead of
    joins that multiply each other's rows."""
    kind = lambda k: F.count_if(F.col("category") == k).alias(f"{k}s")
    rows = events.where(~F.coalesce("archived", F.lit(False)) & F.col("condition_id").isNotNull())
    return rows.groupBy("patient_id", "condition_id").agg(
        F.count("*").alias("events"), kind("diagnosis"), kind("treatment"), kind("test_result"), F.count_if("is_major").alias("major"),
        F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), F.array_sort(F.collect_set("category")).alias("categories"),
    )


def question_intent(v: Column) -> Column:
    """struct<intent, period> of a question (F30): the first words of a list that it has."""
    any_of = lambda words: reduce(lambda a, b: a | b, (has(v, w) for w in words))
    return F.struct(first_case(*((any_of(w), F.lit(i)) for i, w in INTENTS)).otherwise("general").alias("intent"),
        first_case(*((has(v, w), F.lit(p)) for p, w in PERIODS)).alias("period"))


def answers(questions: DataFrame, events: DataFrame, as_of: Column, most: int = 10) -> DataFrame:
    """(question_id, response_type, events, confidence): what a patient's timeline says to each question.

    Questions on tests and visits list such events, of the last month where they ask for it, newest first; of another period none. All others
    search the texts of the patient's events for all their words, without those that say nothing; the first ``most`` by rank (F29, see
    ``fulltext.search``), of equal ones the newest.
    """
    q = questions.withColumn("i", question_intent(F.col("text"))).select("question_id", "patient_id", F.lower("text").alias("text"), "i.*")
    live = events.where(~F.coalesce("archived", F.lit(False)))
    joined = q.join(live, "patient_id")
    listed = F.col("intent").isin("test_results", "encounters")
    wanted = F.when(F.col("intent") == "test_results", F.col("category") == "test_result").otherwise(F.col("category") == "visit")
    timely = F.col("period").isNull() | ((F.col("period") == "1 month") & (F.col("event_date") >= F.add_months(as_of, -1)))
    index = fulltext.build_index(live, "event_id", {"searchable": "D"}, ["patient_id"], fulltext.STOP_WORDS)
    ranks = fulltext.search(index, q.where(~listed), "question_id", stop=fulltext.STOP_WORDS)
    found = ranks.join(live, "event_id").join(q, ["question_id", "patient_id"]).withColumnRenamed("rank", "_score")
    rows = joined.where(listed & wanted & timely).withColumn("_score", F.lit(0.0)).unionByName(found.select(*joined.columns, "_score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("_score"), F.desc("event_date"), "event_id")
    ranked = rows.withColumn("_n", F.row_number().over(order)).where(listed | (F.col("_n") <= most))
    kind = F.when(F.col("intent") == "test_results", "recent_tests").when(F.col("intent") == "encounters",
        "recent_visits").otherwise("general_search")
    sure = F.when(F.col("intent") == "test_results", 0.80).when(F.col("intent") == "encounters", 0.85).otherwise(0.70)
    found = ranked.groupBy("question_id", "intent").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "event_id"))),
        lambda e: e["event_id"]).alias("events"))
    return found.select("question_id", kind.alias("response_type"), "events", sure.alias("confidence"))


def with_context(reports: DataFrame, events: DataFrame) -> DataFrame:
    """Reports beside the event of the same patient and day that shows them (J04): requires_attention and tags, null without one."""
    shown = events.where((F.col("category") == "test_result") & (F.col("subcategory") == "imaging") & ~F.coalesce("archived", F.lit(False)))
    return reports.join(shown.select("patient_id", F.col("event_date").alias("study_date"), "requires_attention", "tags"),
        ["patient_id", "study_date"], "left")


def imaging_summary(reports: DataFrame) -> DataFrame:
    """Per patient, kind and region: studies, their dates, how many need attention or are abnormal, and the latest as JSON."""
    tagged = lambda t: F.count_if(F.array_contains("tags", t)).alias(t)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    latest = F.max(F.struct("study_date", "report_id", blank("indication"), blank("impression")))
    rows = reports.groupBy("patient_id", "imaging_type", "body_region").agg(
        F.count("*").alias("studies"), F.min("study_date").alias("first_study"), F.max("study_date").alias("last_study"),
            F.count_if("requires_attention").alias("attention"),
        tagged("abnormal"), tagged("screening"), latest.alias("_l"),
    )
    said = F.to_json(F.struct(F.date_format("_l.study_date", "yyyy-MM-dd").alias("study_date"), F.col("_l.indication").alias("indication"),
        F.col("_l.impression").alias("impression")))
    return rows.withColumn("latest", said).drop("_l")


def months_between_days(first: Column, last: Column) -> Column:
    return F.round(F.timestamp_diff("SECOND", first, last) / (MONTH_DAYS * 86400)).cast("long")


def imaging_patterns(reports: DataFrame) -> DataFrame:
    """(patient_id, pattern, body_region, studies, months) of all patients (A31, A09): three studies or more of a kind and region; screening
    followed by diagnostic studies of a region; two or more that need attention. ``months`` are of 30.44 days."""
    frequent = reports.groupBy("patient_id", "imaging_type", "body_region").agg(F.count("*").alias("studies"),
        months_between_days(F.min("study_date"), F.max("study_date")).alias("months")).where("studies >= 3")
    tag = lambda t: F.array_contains("tags", t)
    began, went_on = F.min(F.when(tag("screening"), F.col("study_date"))), F.max(F.when(tag("diagnostic"), F.col("study_date")))
    led = reports.groupBy("patient_id", "body_region").agg((F.count_if(tag("screening")) + F.count_if(tag("diagnostic"))).alias("studies"),
        months_between_days(began, went_on).alias("months")).where("months IS NOT NULL")
    cluster = reports.where("requires_attention").groupBy("patient_id").agg(F.count("*").alias("studies"),
        months_between_days(F.min("study_date"), F.max("study_date")).alias("months")).where("studies >= 2")
    shape = lambda df, name, region: df.select("patient_id", F.lit(name).alias("pattern"), region.alias("body_region"), "studies", "months")
    return (
        shape(frequent, "frequent_imaging", F.concat_ws("/", "imaging_type", "body_region")).unionByName(shape(led, "screening_to_diagnostic",
            F.col("body_region")))
        .unionByName(shape(cluster, "attention_cluster", F.lit(None).cast("string")))
    )


def alerts(medications: DataFrame, patients: DataFrame, labs: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """(patient_id, action_type, subject, priority, risk) of new alerts.

    Five active medicines or more, ten are a high risk; mammography from 50 to 74 and colorectal screening from 50 to 75; abnormal results of
    the last 30 days. An alert is not raised while one like it is open: of the last 30 days, six months, or a year; at any time for a result.
    ``items`` has patient_id, action_type, subject, status, created_at.
    """
    open_items = items.where(F.col("status").isin("pending", "assigned"))
    since = lambda df, days: df.where(F.col("created_at") > F.timestamp_add("DAY", F.lit(-days), as_of))
    many = medications.where(~F.coalesce("archived",
        F.lit(False)) & (F.col("status") == "active")).groupBy("patient_id").agg(F.count("*").alias("n")).where("n >= 5")
    many = many.select("patient_id", F.lit("polypharmacy_check").alias("action_type"), F.lit(None).cast("string").alias("subject"),
        F.lit("moderate").alias("priority"), F.when(F.col("n") >= 10, "high").otherwise("moderate").alias("risk"))
    many = many.join(since(open_items.where("action_type = 'polypharmacy_check'"), 30), "patient_id", "left_anti")
    out = many
    age = F.year(as_of) - F.year("birth_date") - (F.date_format(as_of, "MMdd") < F.date_format("birth_date", "MMdd")).cast("int")
    for subject, oldest, days in (("mammography", 74, 182), ("colorectal", 75, 365)):
        due = patients.where(age.between(50, oldest)).select("patient_id", F.lit("screening_due").alias("action_type"),
            F.lit(subject).alias("subject"), F.lit("routine").alias("priority"), F.lit(None).cast("string").alias("risk"))
        out = out.unionByName(due.join(since(open_items.where((F.col("action_type") == "screening_due") & (F.col("subject") == subject)), days),
            "patient_id", "left_anti"))
    odd = labs.where(F.col("flag").isin("high", "low", "critical_high", "critical_low") & ~F.coalesce("archived",
        F.lit(False)) & (F.col("test_date") > F.timestamp_add("DAY", F.lit(-30), as_of)))
    odd = odd.select("patient_id", F.lit("lab_abnormal").alias("action_type"), F.col("lab_id").cast("string").alias("subject"),
        F.when(F.col("flag").startswith("critical"), "critical").otherwise("moderate").alias("priority"), F.lit(None).cast("string").alias("risk"))
    return out.unionByName(odd.join(open_items.where("action_type = 'lab_abnormal'"), ["patient_id", "action_type", "subject"], "left_anti"))


def retained(events: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days."""
    return events.where(F.col(at) >= F.timestamp_add("DAY", F.lit(-days), as_of))


def current_state(sources: dict[str, DataFrame], patient: int | str | None = None) -> DataFrame:
    """(patient_id, kind, id, name, date) of several tables with these columns, in the order of kind and date."""
    parts = [df.select("patient_id", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name", "date") for kind,
        df in sources.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows if patient is None else rows.where(F.col("patient_id") == patient).orderBy("kind", F.desc("date"), "id")


def neighbours(edges: DataFrame, node: int | str) -> DataFrame:
    """(node, strength, side) of the parents and children of a node, strongest first (G03, J09): a search for each side."""
    up = edges.where(F.col("child") == node).select(F.col("parent").alias("node"), "strength", F.lit("parent").alias("side"))
    down = edges.where(F.col("parent") == node).select(F.col("child").alias("node"), "strength", F.lit("child").alias("side"))
    return up.unionByName(down).orderBy("side", F.desc("strength"), "node")
