"""Records of a processing run: manifests, visits that go on, plausibility, audits and backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import expected_next
from .timeline import first_case, has

# fixed values: how kinds of images are shown: (icon, priority)
IMAGES = {"x_ray": ("x-ray", 60), "ct_scan": ("scan", 40), "mri": ("brain", 30), "ultrasound": ("waveform", 70), "mammogram": ("scan", 45),
    "pet_scan": ("atom", 25)}
CONCERN, ROUTINE, URGENT = ["abnormal", "concerning", "suspicious", "follow", "recommend"], ["screening", "routine", "annual"], ["emergency",
    "urgent", "stat"]


def any_of(v: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(has(v, w), F.lit(False))
    return out


def manifests(files: DataFrame, visits: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, visits, manifest) with the manifest as a JSON object: a file's visits by start and id, its pages by number; empty lists where it has
    none (A06, J08, N21). Both sides are put together a file before they meet the files."""
    v = F.struct("start_date", "visit_id", F.struct(F.col("visit_id").alias("encounterId"), F.col("kind").alias("encounterType"),
        F.struct(F.col("start_date").alias("start"), F.col("end_date").alias("end")).alias("dateRange"), "provider").alias("j"))
    by_file = visits.groupBy("file_id").agg(F.count("*").alias("visits"), F.transform(F.array_sort(F.collect_list(v)), lambda x: x["j"]).alias("_v"))
    assigned = pages.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page", F.col("visit_id").alias("encounter_id")))).alias("_p"))
    rows = files.join(by_file, "file_id", "left").join(assigned, "file_id", "left")
    body = F.to_json(F.struct(F.col("file_id").alias("shellFileId"), F.col("pages").alias("totalPages"),
        F.coalesce("_v", F.array().cast(by_file.schema["_v"].dataType)).alias("encounters"),
        F.coalesce("_p", F.array().cast(assigned.schema["_p"].dataType)).alias("page_assignments")))
    return rows.select("file_id", F.coalesce("visits", F.lit(0)).alias("visits"), body.alias("manifest"))


def continued_visits(visits: DataFrame, chunk: int, chunks: int, chunk_end: int) -> DataFrame:
    """Adds status, temp_id and expected_continuation to the visits of a chunk (D09): complete in the only or the last chunk; continuing if a visit
    reaches the chunk's end, expects more, has no end date without being completed, or is told to go on; a visit without pages keeps its status.

    ``visits`` has visit_id, kind, last_page, told_status, told_temp_id, told_next, end_date, timeframe.
    """
    if chunk >= chunks:
        return visits.withColumns({"status": F.lit("complete"), "temp_id": F.lit(None).cast("string"),
            "expected_continuation": F.lit(None).cast("string")})
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    goes_on = (F.col("last_page") == chunk_end) | filled("told_next") | (~filled("end_date") & (F.coalesce("timeframe",
        F.lit("")) != "completed")) | F.coalesce(F.col("told_status") == "continuing", F.lit(False))
    status = F.when(F.col("last_page").isNull(), F.coalesce("told_status", F.lit("complete"))).when(goes_on, "continuing").otherwise("complete")
    temp = F.coalesce("told_temp_id", F.concat(F.lit(f"encounter_temp_chunk{chunk}_"), F.col("visit_id").cast("string")))
    paged = F.col("last_page").isNotNull() & goes_on
    return visits.withColumns({"status": status, "temp_id": F.when(paged, temp),
        "expected_continuation": F.when(paged, F.when(filled("told_next"), F.col("told_next")).otherwise(expected_next(F.col("kind"))))})


def handed_over(pending: DataFrame) -> DataFrame:
    """Pending visits with a valid temp id and an expectation (N41): a missing id, or one with 'undefined' in it, becomes one made from the visit's."""
    bad = F.col("temp_id").isNull() | F.contains("temp_id", F.lit("undefined"))
    made = F.concat(F.lit("encounter_temp_generated_"), F.left(F.md5(F.col("visit_id").cast("string")), F.lit(9)))
    return pending.withColumn("temp_id", F.when(bad, made).otherwise(F.col("temp_id"))).withColumn("expected_continuation",
        F.coalesce(F.nullif("expected_continuation", F.lit("")), expected_next(F.col("kind"))))


def event_of_report(reports: DataFrame) -> DataFrame:
    """A timeline event for each imaging report (D17): rows have report_id, patient_id, imaging_type, body_region, indication, impression,
    radiologist_name, facility_name, study_date."""
    kind = F.col("imaging_type")
    known = kind.isin(*IMAGES)
    base = F.coalesce(first_case(*((kind == k, F.lit(p)) for k, (_, p) in IMAGES.items())), F.lit(50))
    words = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    title = F.coalesce(F.concat(words(kind), F.lit(" - "), words(F.col("body_region"))), F.concat(words(kind), F.lit(" Study")))
    behind = lambda lead, c: F.coalesce(F.concat(F.lit(lead), F.col(c)), F.lit(""))
    summary = F.concat(F.coalesce("indication", F.lit("Imaging study")), behind(" - Report by ", "radiologist_name"), behind(" at ", "facility_name"))
    odd, routine, urgent = any_of(F.col("impression"), CONCERN), any_of(F.col("indication"), ROUTINE), any_of(F.col("indication"), URGENT)
    priority = F.when(urgent, 20).otherwise(base - F.when(odd, 10).otherwise(0))
    tags = F.filter(F.array(F.when(kind == "mammogram", "screening"), F.when(odd, "abnormal"), F.when(routine, "preventive"),
        F.when(urgent, "urgent")), lambda t: t.isNotNull())
    icon = F.coalesce(first_case(*((kind == k, F.lit(i)) for k, (i, _) in IMAGES.items())), F.lit("camera"))
    return reports.select(
        "report_id", "patient_id", F.lit("test_result").alias("category"), F.lit("imaging").alias("subcategory"),
            F.when(known, kind).otherwise("imaging_study").alias("tertiary"), title.alias("title"),
        summary.alias("summary"), icon.alias("icon"), F.col("study_date").alias("event_date"), (priority <= 40).alias("is_major"),
            priority.alias("priority"), tags.alias("tags"), odd.alias("requires_attention"),
    )


def plausibility(entities: DataFrame) -> DataFrame:
    """(document_id, issues) of detected events that do not fit the age, and of words of the other gender (Q16): rows have document_id, category, text,
    age, gender. 'female' holds 'male', so it tells against either."""
    t, age = F.col("text"), F.col("age")
    event = F.col("category") == "clinical_event"
    cases = {
        "Colonoscopy screening typically inappropriate for age < 18": event & (age < 18) & has(t, "colonoscopy"),
            "Pap smear screening typically starts at age 21": event & (age < 21) & has(t, "pap smear"),
        "Sports physical unusual for age > 80": event & (age > 80) & has(t, "sports physical"),
    }
    g = F.lower("gender")
    opposite = ((g == "male") & (has(t, "she/her") | has(t, "female"))) | ((g == "female") & (has(t, "he/him") | has(t, "male")))
    issues = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n,
        c in {**cases, "Potential gender mismatch detected": opposite}.items())), lambda i: i.isNotNull())
    rows = entities.select("document_id", F.explode(issues).alias("issue")).distinct()
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list("issue")).alias("issues"))


def audited(events: DataFrame, record: str, fallback: Column) -> DataFrame:
    """Audit rows with an id that is a UUID, or a fallback and the text."""
    from ..functions.checks import record_ids

    return events.withColumn("_r", record_ids(F.col(record).cast("string"), fallback)).select(*events.columns,
        F.col("_r.record_id").alias("audit_record_id"), F.col("_r.record_id_text").alias("record_id_text"))


def cascade_counts(fragments: DataFrame) -> DataFrame:
    """(cascade_id, fragments, first_chunk, last_chunk) of cascades (N19): counted from the fragments, where a counter would be raised."""
    return fragments.where(F.col("cascade_id").isNotNull()).groupBy("cascade_id").agg(F.count("*").alias("fragments"),
        F.min("chunk_number").alias("first_chunk"), F.max("chunk_number").alias("last_chunk"))


def completion_errors(cascades: DataFrame, counts: DataFrame) -> DataFrame:
    """Completed cascades that report fewer fragments than there are, or end before they began (N35): rows have cascade_id, reported, origin_chunk, last_chunk."""
    rows = cascades.join(counts.select("cascade_id", "fragments"), "cascade_id", "left")
    errors = F.filter(F.array(F.when(F.col("reported") < F.coalesce("fragments", F.lit(0)), "fewer fragments reported than tracked"),
        F.when(F.col("last_chunk") < F.col("origin_chunk"), "last chunk before origin")), lambda e: e.isNotNull())
    return rows.select("cascade_id", errors.alias("errors")).where(F.size("errors") > 0)


def session_statuses(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions after their changes (session_id, event, at) (N15): complete ends one, error fails it and adds a retry; the last change decides."""
    n = changes.groupBy("session_id").agg(F.max_by("event", F.struct("at", "event")).alias("_last"),
        F.count_if(F.col("event") == "error").alias("_errors"), F.max(F.when(F.col("event") == "complete", F.col("at"))).alias("_end"))
    status = F.when(F.col("_last") == "complete", "completed").when(F.col("_last") == "error", "failed").otherwise(F.col("status"))
    return sessions.join(n, "session_id", "left").select("session_id", status.alias("status"),
        (F.col("retries") + F.coalesce("_errors", F.lit(0))).alias("retries"),
        F.when(F.col("_last") == "complete", F.col("_end")).alias("completed_at"))


def backlog(codes: DataFrame, page: int, size: int = 1000) -> DataFrame:
    """A page of the codes that have a normalised text and no vector, by id."""
    return codes.where(F.col("normalized_text").isNotNull() & F.col("embedding").isNull()).orderBy("id").offset(page * size).limit(size)


def batch_outcomes(asked: DataFrame, results: DataFrame, key: str = "id", most: int = 50) -> DataFrame:
    """(key, outcome, error) of a batch of up to ``most`` ids (D19): ids beyond are refused, ids without a record are not found."""
    # the first of all ids by value: a sort with a limit, not a window over all of them
    first = asked.select(key).distinct().orderBy(key).limit(most).withColumn("_in", F.lit(True))
    rows = asked.select(key).distinct().join(first, key, "left").join(results.select(key, "error", F.lit(True).alias("_there")), key, "left")
    outcome = F.when(F.col("_in").isNull(), "refused").when(F.col("_there").isNull(), "not_found").when(F.col("error").isNotNull(),
        "failed").otherwise("done")
    return rows.select(key, outcome.alias("outcome"), F.when(outcome == "failed", F.col("error")).alias("error"))


def candidate_summary(entities: DataFrame, found: DataFrame, query: str = "query") -> DataFrame:
    """One row: entities in all, without a candidate, and candidates an entity."""
    n = entities.select(query).distinct().join(found.groupBy(query).agg(F.count("*").alias("n")), query, "left")
    return n.agg(F.count("*").alias("entities"), F.count_if(F.col("n").isNull()).alias("failed"),
        F.round(F.coalesce(F.avg(F.coalesce("n", F.lit(0))), F.lit(0.0)), 6).alias("mean_candidates"))


def to_normalise(documents: DataFrame, most: int) -> DataFrame:
    """The newest completed documents that are not normalised yet."""
    return documents.where((F.col("status") == "completed") & F.col("normalized_at").isNull()).orderBy(F.desc("created_at"),
        "document_id").limit(most)


def joined_batches(batches: DataFrame, key: str, index: str, items: str) -> DataFrame:
    """(key, items): the lists of a visit's batches as one, in the order of the batches (U06, W09): structs get ids e1 to en.

    ``index`` may be a struct, whose fields then order the batches one after the other.
    """
    rows = batches.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(index, items))), lambda b: b[items])).alias(items))
    return rows.withColumn(items, F.transform(items, lambda e, i: e.withField("id", F.concat(F.lit("e"), (i + 1).cast("string")))))


def contraindicated(medications: DataFrame, allergies: DataFrame) -> DataFrame:
    """(patient_id, medication, substance): medicines whose name an allergy's substance of the same patient holds, any case.

    The patient is an equal key, so the text is compared within a patient only.
    """
    joined = medications.select("patient_id", F.col("name").alias("medication")).join(allergies.select("patient_id", "substance"), "patient_id")
    return joined.where(F.contains(F.lower("substance"), F.lower("medication")))


def narrative_timeline(narratives: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """(narrative_id, event_id, position) of the events that narratives link to, in the order of the links."""
    return narratives.where("is_current").select("narrative_id").join(links, "narrative_id").join(events.select("event_id"),
        "event_id").select("narrative_id", "event_id", "position")


def pages_for_vision(pages: DataFrame, share: float = 0.2, confidence: float = 0.6) -> DataFrame:
    """Pages with much that is no text, or that were read with little confidence."""
    return pages.where((F.col("visual_share") > share) | (F.coalesce("confidence", F.lit(0.0)) < confidence))


def policy_audit(policies: DataFrame) -> DataFrame:
    """(table_name, covered) of tables: whether each of the four commands has a policy."""
    c = lambda n: F.bool_or(F.col("command").isin(n, "ALL"))
    return policies.groupBy("table_name").agg((c("SELECT") & c("INSERT") & c("UPDATE") & c("DELETE")).alias("covered"))


def holds_role(roles: Column, wanted: list[str]) -> Column:
    """Whether a caller holds one of the roles; an admin holds all."""
    return F.coalesce(F.arrays_overlap(roles, F.array(*map(F.lit, ["admin", *wanted]))), F.lit(False))
