"""Queries of value checks and of records of a processing run, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..operators import processing, timeline
from ..registry import query
from ..sources import table
from .stand_ins import over, stand_in


@query("f14_f16_plain_names", """
SELECT p_partkey, lower(p_name) AS medication, lower(p_name) || ' ' || lower(p_type) AS ingredient, lower(p_name) AS provider, lower(p_name) AS core
FROM part""")
def f14(spark, d):
    n, t, lit = F.col("p_name"), F.col("p_type"), F.lit
    return table(spark, d, "part").select(
        "p_partkey", C.medication_name(F.concat(lit("  "), F.upper(n), lit("   Tablet "))).alias("medication"),
            C.ingredient(F.concat(n, lit(" 2.5 mg - 5 mg Capsule with "), t, lit(" (as Calcium)(Brand)"))).alias("ingredient"),
        C.provider_name(F.concat(lit("Dr "), n, lit(" MD"))).alias("provider"),
            C.procedure_core(F.concat(n, lit(" not more than 20 minutes in hospital"))).alias("core"),
    )


@query("f31_p11_valid_values", """
SELECT o_orderkey, o_orderkey % 4 <> 3 AS dosage, o_orderkey % 3 <> 2 AS frequency, o_orderkey % 2 = 0 AS pressure, o_orderkey % 2 = 0 AS rate,
year(o_orderdate) <= 1998 AS date, o_orderpriority ILIKE '%urgent%' AS urgent FROM orders""")
def f31(spark, d):
    n = F.col("o_orderkey")
    pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (n % k + 1).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey", C.valid_dosage(pick(4, "2.5 MG", "1/2 tablet", "5iu", "some")).alias("dosage"),
            C.valid_frequency(pick(3, "Twice a day", "q6h", "never")).alias("frequency"),
            C.valid_blood_pressure(pick(2, "120/80 mmHg", "1200/8")).alias("pressure"),
        C.valid_heart_rate(pick(2, "72 beats per min", "72 x")).alias("rate"),
            C.valid_date(F.date_format("o_orderdate", "yyyy-MM-dd"), 1997).alias("date"),
            C.matches_any(F.col("o_orderpriority"), "URGENT").alias("urgent"),
    )


@query("f27_f82_redacted", """
SELECT c_custkey, '***' || sha256(c_name)[1:6] || ':' || right(c_name, 6) AS patient, CASE WHEN c_custkey % 2 = 0 THEN '[BASE64_REDACTED:' ||
length(c_name) || '_bytes]' END AS file, sha256(c_name) AS sum FROM customer""")
def f27(spark, d):
    data = F.when(F.col("c_custkey") % 2 == 0, F.base64(F.col("c_name").cast("binary"))).otherwise("")
    shown = C.redacted_log(F.col("c_name"), F.lit(None).cast("string"), F.lit("p"), data)
    return table(spark, d, "customer").select("c_custkey", shown["patient_id_masked"].alias("patient"), shown["file_data"].alias("file"),
        C.content_hash(F.col("c_name")).alias("sum"))


@query("n28_n49_audit_ids", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS record_id_text, length(c_name) <= 18 AS small FROM customer""")
def n28(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name",
        F.when(F.col("c_custkey") % 2 == 0, "123e4567-e89b-12d3-a456-426614174000").otherwise(F.col("c_name")).alias("r"))
    return processing.audited(rows, "r", F.lit("none")).select("c_custkey", "record_id_text", C.within_size(F.col("c_name"), 18).alias("small"))


@query("a06_j08_manifests", """
SELECT c_custkey AS file_id, count(o_orderkey) AS visits, CASE WHEN count(o_orderkey) = 0 THEN NULL ELSE arg_min(o_orderkey, (o_orderdate,
o_orderkey)) END AS first, count(o_orderkey) AS pages FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def a06(spark, d):
    o = table(spark, d, "orders")
    visits = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("visit_id"), F.col("o_orderstatus").alias("kind"),
        F.col("o_orderdate").alias("start_date"), F.col("o_orderdate").alias("end_date"), F.lit("Dr Who").alias("provider"))
    pages = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("page"), F.col("o_orderkey").alias("visit_id"))
    rows = processing.manifests(table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.lit(3).alias("pages")), visits, pages)
    listed = F.from_json(F.get_json_object("manifest", "$.page_assignments"), "array<struct<page:bigint>>")
    return rows.select("file_id", "visits", F.get_json_object("manifest", "$.encounters[0].encounterId").cast("long").alias("first"),
        F.size(listed).cast("long").alias("pages"))


@query("d09_continued_visits", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 5 = 0 THEN 'told' WHEN l_quantity = 50 OR l_linenumber % 3 = 0 THEN 'continuing'
ELSE 'complete' END AS status, CASE WHEN l_linenumber % 5 <> 0 AND (l_quantity = 50 OR l_linenumber % 3 = 0) THEN 'post_operative_notes' END AS
expected_continuation FROM lineitem""")
def d09(spark, d):
    n, none = F.col("l_linenumber"), F.lit(None).cast("string")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("visit_id"),
        F.lit("Surgery").alias("kind"), F.when(n % 5 != 0, F.col("l_quantity").cast("int")).alias("last_page"),
        F.when(n % 5 == 0, "told").alias("told_status"), none.alias("told_temp_id"), none.alias("told_next"), none.alias("end_date"),
        F.when(n % 3 == 0, "ongoing").otherwise("completed").alias("timeframe"))
    return processing.continued_visits(rows, 1, 3, 50).select("l_orderkey", "l_linenumber", "l_partkey", "status", "expected_continuation")


@query("d17_report_events", """
WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'mri' WHEN 1 THEN 'mammogram' WHEN 2 THEN 'x_ray' ELSE 'dexa' END AS kind, CASE WHEN
event_id % 3 = 0 THEN NULL ELSE 'left_knee' END AS region, CASE event_id % 5 WHEN 0 THEN 'Annual visit' WHEN 1 THEN 'urgent' END AS why, CASE event_id
% 2 WHEN 0 THEN 'Suspicious mass' ELSE 'normal' END AS said FROM events)
SELECT event_id AS report_id, CASE kind WHEN 'dexa' THEN 'imaging_study' ELSE kind END AS tertiary, CASE kind WHEN 'x_ray' THEN 'X Ray' ELSE
upper(kind[1]) || kind[2:] END || CASE WHEN region IS NULL THEN ' Study' ELSE ' - Left Knee' END AS title, coalesce(why, 'Imaging study') ||
' - Report by Dr Who' AS summary,
CASE WHEN why = 'urgent' THEN 20 ELSE CASE kind WHEN 'mri' THEN 30 WHEN 'mammogram' THEN 45 WHEN 'x_ray' THEN 60 ELSE 50 END - CASE said WHEN 'normal'
THEN 0 ELSE 10 END END AS priority,
array_to_string(list_filter([CASE WHEN kind = 'mammogram' THEN 'screening' END, CASE WHEN said <> 'normal' THEN 'abnormal' END, CASE WHEN why LIKE
'Annual%' THEN 'preventive' END, CASE WHEN why = 'urgent' THEN 'urgent' END], lambda v: v IS NOT NULL), ',') AS tags FROM x""")
def d17(spark, d):
    n, none = F.col("event_id"), F.lit(None).cast("string")
    kind = F.when(n % 4 == 0, "mri").when(n % 4 == 1, "mammogram").when(n % 4 == 2, "x_ray").otherwise("dexa")
    rows = table(spark, d, "events").select(n.alias("report_id"), F.col("user_id").alias("patient_id"), kind.alias("imaging_type"),
        F.when(n % 3 != 0, "left_knee").alias("body_region"), F.when(n % 5 == 0, "Annual visit").when(n % 5 == 1, "urgent").alias("indication"),
        F.when(n % 2 == 0, "Suspicious mass").otherwise("normal").alias("impression"), F.lit("Dr Who").alias("radiologist_name"),
        none.alias("facility_name"), F.col("ts").alias("study_date"))
    return processing.event_of_report(rows).select("report_id", "tertiary", "title", "summary", "priority", F.array_join("tags", ",").alias("tags"))


@query("q16_plausibility", """
SELECT o_orderkey AS document_id, array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 100 < 18 THEN
'Colonoscopy screening typically inappropriate for age < 18' END, CASE WHEN o_orderkey % 2 = 0 THEN 'Potential gender mismatch detected' END], lambda
v: v IS NOT NULL)), ';') AS issues FROM orders WHERE o_orderkey % 100 < 18 OR o_orderkey % 2 = 0""")
def q16(spark, d):
    n = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(n.alias("document_id"), F.lit("clinical_event").alias("category"),
        F.when(n % 2 == 0, "Colonoscopy of a FEMALE").otherwise("Colonoscopy").alias("text"), (n % 100).alias("age"), F.lit("Male").alias("gender"))
    return processing.plausibility(rows).select("document_id", F.array_join("issues", ";").alias("issues"))


@query("n19_n35_cascades", over("fragments", """
SELECT cascade_id, count(*) AS fragments, min(chunk_number) AS first_chunk, max(chunk_number) AS last_chunk, CASE WHEN count(*) > 2 THEN
'fewer fragments reported than tracked' ELSE '' END AS errors FROM fragments WHERE cascade_id IS NOT NULL GROUP BY cascade_id"""))
def n19(spark, d):
    counts = processing.cascade_counts(stand_in(spark, d, "fragments"))
    told = counts.select("cascade_id", F.lit(2).alias("reported"), F.lit(0).alias("origin_chunk"), "last_chunk")
    errors = processing.completion_errors(told, counts).select("cascade_id", F.array_join("errors", ";").alias("errors"))
    return counts.join(errors, "cascade_id", "left").withColumn("errors", F.coalesce("errors", F.lit("")))


@query("n15_session_statuses", """
SELECT o_custkey AS session_id, CASE WHEN arg_max(o_orderkey % 2, (o_orderdate, CASE o_orderkey % 2 WHEN 0 THEN 'complete' ELSE 'error' END)) = 0 THEN
'completed' ELSE 'failed' END AS status, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS retries FROM orders GROUP BY o_custkey""")
def n15(spark, d):
    o = table(spark, d, "orders")
    changes = o.select(F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderkey") % 2 == 0, "complete").otherwise("error").alias("event"),
        F.col("o_orderdate").alias("at"))
    sessions = o.select(F.col("o_custkey").alias("session_id"), F.lit("running").alias("status"), F.lit(0).alias("retries")).distinct()
    return processing.session_statuses(sessions, changes).select("session_id", "status", "retries")


@query("j01_j12_contraindicated", """
SELECT o_custkey AS patient_id, 'm' || o_orderkey % 3 AS medication, 'the M' || c_custkey % 3 || ' family' AS substance FROM orders JOIN customer ON
c_custkey = o_custkey WHERE o_orderkey % 3 = c_custkey % 3""")
def j12(spark, d):
    meds = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("name"))
    told = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"),
        F.concat(F.lit("the M"), (F.col("c_custkey") % 3).cast("string"), F.lit(" family")).alias("substance"))
    return processing.contraindicated(meds, told)


@query("u06_w09_joined_batches", """
SELECT l_orderkey, list_aggregate(list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey), 'string_agg', ',') AS parts, 'e' || count(*) AS last_id
FROM lineitem GROUP BY l_orderkey""")
def u06(spark, d):
    item = F.array(F.struct(F.col("l_partkey").alias("part"), F.lit("x").alias("id")))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("n"), item.alias("items"))
    done = processing.joined_batches(rows, "l_orderkey", "n", "items")
    return done.select("l_orderkey", F.array_join(F.transform("items", lambda e: e["part"].cast("string")), ",").alias("parts"),
        F.element_at("items", -1)["id"].alias("last_id"))


@query("n43_backlog", "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0 ORDER BY p_partkey LIMIT 20 OFFSET 20")
def n43(spark, d):
    n = F.col("p_partkey")
    rows = table(spark, d, "part").select(n.alias("id"), F.when(n % 3 == 0, F.col("p_name")).alias("normalized_text"),
        F.when(n % 4 == 0, F.array(F.lit(1.0))).alias("embedding"))
    return processing.backlog(rows, 1, 20).select("id")


@query("d19_batch_outcomes", """
SELECT c_custkey AS id, CASE WHEN c_custkey > (SELECT max(c_custkey) FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50) t) THEN
'refused' WHEN c_custkey % 5 = 0 THEN 'not_found' WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'done' END AS outcome FROM customer""")
def d19(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    results = asked.where("id % 5 <> 0").withColumn("error", F.when(F.col("id") % 3 == 0, "bad"))
    return processing.batch_outcomes(asked, results).select("id", "outcome")


@query("n23_to_normalise",
    "SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def n23(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("normalized_at"), F.col("o_orderdate").alias("created_at"))
    return processing.to_normalise(rows, 30).select("document_id")


@query("n44_candidate_summary", """
SELECT count(*) AS entities, count(*) FILTER (WHERE n = 0) AS failed, round(avg(n), 6) AS mean_candidates FROM (SELECT c_custkey, count(o_orderkey) AS
n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) t""")
def n44(spark, d):
    return processing.candidate_summary(table(spark, d, "customer").select(F.col("c_custkey").alias("query")),
        table(spark, d, "orders").select(F.col("o_custkey").alias("query")))


@query("n25_narrative_timeline",
    "SELECT l_orderkey AS narrative_id, l_partkey AS event_id, l_linenumber AS position FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'O'")
def n25(spark, d):
    narratives = table(spark, d, "orders").select(F.col("o_orderkey").alias("narrative_id"), (F.col("o_orderstatus") == "O").alias("is_current"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("narrative_id"), F.col("l_partkey").alias("event_id"),
        F.col("l_linenumber").alias("position"))
    return processing.narrative_timeline(narratives, links, table(spark, d, "part").select(F.col("p_partkey").alias("event_id")))


@query("n26_n33_roles_and_policies",
    "SELECT n_regionkey::VARCHAR AS table_name, count(DISTINCT n_nationkey % 4) = 4 AS covered FROM nation GROUP BY n_regionkey")
def n33(spark, d):
    command = F.element_at(F.array(*map(F.lit, ("SELECT", "INSERT", "UPDATE", "DELETE"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return processing.policy_audit(table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("table_name"),
        command.alias("command")))


@query("j04_n01_reports_in_context", over("reports timeline", """
WITH t AS (SELECT patient_id, event_date, tag FROM timeline WHERE category = 'test_result' AND subcategory = 'click' AND archived IS NOT TRUE)
SELECT r.report_id, t.tag IS NOT NULL AS shown FROM reports r LEFT JOIN t ON t.patient_id = r.patient_id AND t.event_date = r.study_date"""))
def j04(spark, d):
    events = stand_in(spark, d, "timeline").withColumn("subcategory",
        F.when(F.col("subcategory") == "click", "imaging").otherwise("x")).withColumn("tags", F.array("tag")).withColumn("requires_attention",
        F.col("is_major"))
    return timeline.with_context(stand_in(spark, d, "reports").drop("requires_attention", "tag"), events).select("report_id",
        F.col("tags").isNotNull().alias("shown"))
