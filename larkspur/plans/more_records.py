"""Queries of code lists, JSON fields and record look-ups, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..operators import layout, model_output, queues, reconcile, records, timeline
from ..registry import query
from ..sources import lists, split_valid, table
from .stand_ins import over, stand_in


@query("s01_f19_f20_f21_laboratory_codes", """
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 7 = 0 THEN 'x' || p_partkey ELSE p_partkey || '-' || p_size END AS
num, CASE p_partkey % 5 WHEN 0 THEN 'CHEM' WHEN 1 THEN 'BP.atom' WHEN 2 THEN 'Panel.chem' WHEN 3 THEN 'H&P.hx' END AS class FROM part)
SELECT p.p_partkey, r.num AS code_value, p_name AS display_name, CASE p.p_partkey % 5 WHEN 0 THEN 'lab_result' WHEN 1 THEN 'vital_sign' WHEN 3 THEN
'physical_finding' ELSE 'observation' END AS entity_type, p_name || ' ' || p_brand || ' ' || p_type || ' BP' AS search_text FROM part p JOIN r ON
r.p_partkey = p.p_partkey
WHERE p.p_partkey % 11 <> 0 AND p.p_partkey % 7 <> 0 AND p.p_partkey % 5 <> 2""")
def s01(spark, d):
    n, none = F.col("p_partkey"), F.lit(None).cast("string")
    number = F.when(n % 11 == 0, " ").when(n % 7 == 0, F.concat(F.lit("x"), n.cast("string"))).otherwise(F.concat_ws("-", n.cast("string"),
        F.col("p_size").cast("string")))
    kind = F.when(n % 5 == 0, "CHEM").when(n % 5 == 1, "BP.atom").when(n % 5 == 2, "Panel.chem").when(n % 5 == 3, "H&P.hx")
    rows = table(spark, d, "part").select("p_partkey", number.alias("LOINC_NUM"), F.concat(F.lit(" "), "p_name").alias("LONG_COMMON_NAME"),
        none.alias("SHORTNAME"), F.col("p_brand").alias("COMPONENT"), F.col("p_type").alias("SYSTEM"), F.lit("BP; ab;;BP").alias("RELATEDNAMES2"),
        kind.alias("CLASS"))
    good, _ = split_valid(lists.laboratory_codes(rows, "v2025Q4", ["p_partkey"]), lists.code_errors("loinc"))
    return good.select("p_partkey", "code_value", "display_name", "entity_type", "search_text")


@query("s02_f22_medicine_codes", """
SELECT p_partkey, p_partkey::VARCHAR AS code_value, p_brand AS grouping_code, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN
p_type ELSE p_name END AS display_name, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_type ELSE p_name END || CASE p_partkey %
2 WHEN 0 THEN ' Brand' ELSE '' END AS search_text
FROM part WHERE p_partkey % 13 <> 0""")
def s02(spark, d):
    n = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", n.cast("string").alias("li_item_id"),
        F.when(n % 13 == 0, " ").otherwise(F.col("p_brand")).alias("pbs_code"), F.when(n % 3 != 1, F.col("p_name")).alias("drug_name"),
        F.when(n % 3 == 0, F.col("p_type")).otherwise("").alias("li_form"), F.when(n % 3 == 1, F.col("p_type")).alias("schedule_form"),
        F.when(n % 2 == 0, "Brand").alias("brand_name"))
    return lists.medicine_codes(rows, "v2025Q4", ["p_partkey"]).select("p_partkey", "code_value", "grouping_code", "display_name", "search_text")


@query("s04_f23_procedure_codes", """
SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN p_partkey || '_1' ELSE p_partkey::VARCHAR END AS code_value, CASE p_partkey % 3 WHEN 0 THEN 'c1' ELSE
'g1' END AS grouping_code, p_name || ' of ' || p_type AS display_name, trim('MBS ' || p_partkey || ' ' || CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'g1'
END || ' ' || p_name || ' of ' || p_type) AS search_text
FROM part WHERE p_partkey % 5 <> 0 AND length(p_name || '  of  ' || p_type) >= 10""")
def s04(spark, d):
    n = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", n.cast("string").alias("ItemNum"), F.when(n % 2 == 0, "1").alias("SubItemNum"),
        F.concat(F.col("p_name"), F.lit("  of\n "), F.col("p_type")).alias("Description"), F.when(n % 3 != 0, "g1").alias("Group"),
        F.lit("c1").alias("Category"), F.when(n % 5 == 0, "01.07.2020").when(n % 5 == 1, "01.07.2031").alias("ItemEndDate"))
    return lists.procedure_codes(rows, "v2025Q4", 2025, ["p_partkey"]).select("p_partkey", "code_value", "grouping_code", "display_name",
        "search_text")


@query("s23_f91_json_fields", """
SELECT event_id, (props->>'$.k')::INT AS k, coalesce(CASE WHEN event_id % 2 = 0 THEN (props->>'$.k')::INT END, 300) AS config, (props->>'$.k') = '3'
AS is_three, event_id AS merged FROM events""")
def s23(spark, d):
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    both = J.merged(F.col("props"), F.to_json(F.struct(n.alias("id"), F.lit("x").alias("k"))))
    scalar = F.when(n % 2 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise("none")
    return table(spark, d, "events").select("event_id", k.cast("int").alias("k"), J.config_number(scalar, 300).alias("config"),
        J.contains_field(F.col("props"), "k", F.lit(3)).alias("is_three"), F.get_json_object(both, "$.id").cast("long").alias("merged"))


@query("f26_sanitized_fields", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...[truncated]' ELSE text END AS note, lang AS lang, 2 + (doc_id % 7 = 3)::INTEGER AS n FROM documents""")
def f26(spark, d):
    n = F.col("doc_id")
    private = F.element_at(F.array(*map(F.lit, ("email", "phone", "ssn", "medical_record_number", "name", "address"))), (n % 6 + 1).cast("int"))
    more = F.when(n % 7 == 3, "named").otherwise(F.element_at(F.array(F.lit("phone"), F.lit("ssn")), (n % 2 + 1).cast("int")))
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    held = F.array(pair(F.lit("note"), F.col("text")), pair(F.lit("lang"), F.col("lang")), pair(private, F.lit("x")), pair(more, F.lit("x")))
    fields = F.map_from_entries(F.array_distinct(held))
    kept = J.sanitized_fields(fields)
    return table(spark, d, "documents").select("doc_id", kept["note"].alias("note"), kept["lang"].alias("lang"), F.size(kept).alias("n"))


@query("p20_l02_second_pass", """
SELECT o_orderkey AS entity_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 <> 0 ORDER BY CASE o_orderpriority[1] WHEN '1' THEN 1 WHEN '2'
THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 4 ELSE 5 END, o_orderdate, o_orderkey LIMIT 100""")
def p20(spark, d):
    rank = F.element_at(F.array(*map(F.lit, ("highest", "high", "medium", "low", "none"))), F.left("o_orderpriority", F.lit(1)).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, "document_structure").otherwise("x").alias("category"), rank.alias("priority"),
        F.col("o_orderdate").alias("created_at"))
    return records.second_pass(rows).select("entity_id")


@query("p22_l07_active_records", """
SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' AND o_orderkey % 3 <> 0""")
def p22(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("over").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("archived_at"), "o_orderdate")
    return records.active_records(rows, 7, "o_orderdate").select("id")


@query("p23_l01_sure_narratives", """
SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_linestatus = 'O' AND (l_tax = 0 OR l_tax * 10 >= 0.5)""")
def p23(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("l_linestatus") == "O").alias("is_current"), F.when(F.col("l_tax") != 0, F.col("l_tax") * 10).alias("confidence"))
    return records.sure_narratives(rows, 0.5).select("id")


@query("p26_p25_search_providers", """
SELECT s_suppkey AS provider_id, s_name || ' Who' AS full_name FROM supplier WHERE (s_name ILIKE '%1%' OR ('G-' || s_suppkey) ILIKE '%1%') AND
s_nationkey = 3 AND s_acctbal > 0""")
def p26(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("given_names"),
        F.lit("Who").alias("family_name"), F.concat(F.lit("G-"), F.col("s_suppkey").cast("string")).alias("public_id"),
        F.col("s_nationkey").cast("string").alias("country"), F.array(F.lit("gp")).alias("specialties"), (F.col("s_acctbal") > 0).alias("verified"))
    return records.search_providers(rows, "1", "3", "gp").select("provider_id", "full_name")


@query("n05_provider_records", over("provider_grants", """
SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0 AND o_custkey IN (SELECT patient_id FROM provider_grants WHERE provider_id = 3 AND status =
'active' AND scope_name = 'labs' AND (expires_at IS NULL OR expires_at > TIMESTAMP '1997-06-15'))"""))
def n05(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("patient_id"),
        F.when(F.col("o_orderkey") % 6 == 0, True).alias("archived"))
    return records.provider_records(rows, stand_in(spark, d, "provider_grants").withColumn("scope", F.array("scope_name")), 3, "labs",
        F.lit("1997-06-15").cast("timestamp_ntz")).select("o_orderkey")


@query("n02_study_context", """
SELECT event_id AS report_id, 'Dr ' || (event_id % 9) AS provider, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN event_id % 2 = 0 THEN
'MRI in 6 weeks' END AS first FROM events""")
def n02(spark, d):
    said = F.when(F.col("event_id") % 2 == 0, "No mass. Recommend: MRI in 6 weeks; call back.").otherwise("Normal.")
    rows = table(spark, d, "events").select(F.col("event_id").alias("report_id"), (F.col("event_id") % 9).alias("visit_id"),
        F.lit("mri").alias("imaging_type"), F.lit("knee").alias("body_region"), F.col("ts").alias("study_date"), said.alias("impression"))
    visits = spark.range(9).select(F.col("id").alias("visit_id"), F.concat(F.lit("Dr "), F.col("id").cast("string")).alias("provider_name"),
        F.lit("Clinic").alias("facility_name"))
    return records.study_context(rows, visits).select("report_id", F.get_json_object("visit", "$.provider_name").alias("provider"),
        F.size("follow_up").alias("n"), F.get("follow_up", 0).alias("first"))


@query("f36_expected_next", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'discharge_summary' WHEN 1 THEN 'post_operative_notes' WHEN 2 THEN 'disposition_or_admission' WHEN 3
THEN 'results_or_report' ELSE 'continuation' END AS v FROM events""")
def f36(spark, d):
    n = F.col("event_id") % 6
    kind = F.when(n == 0, "Hospital Inpatient surgery").when(n == 1, "Day procedure").when(n == 2, "EMERGENCY visit").when(n == 3,
        "imaging").when(n == 4, "checkup")
    return table(spark, d, "events").select("event_id", records.expected_next(kind).alias("v"))


@query("a32_a36_system_alerts", """
WITH m AS (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY event_type) SELECT metric, CASE WHEN value >= 60 THEN 'CRITICAL' ELSE
'WARNING' END AS status FROM m WHERE value >= 40""")
def a32(spark, d):
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return records.system_alerts(records.health_checks(m, {k: (40, 60) for k in ("signup", "purchase", "error", "view", "click")})).select("metric",
        "status")


@query("a33_performance_metrics", """
SELECT round(avg(CASE WHEN ts >= TIMESTAMP '2024-01-13' THEN value / 100 END), 6) AS confidence, round(avg(CASE WHEN ts >= TIMESTAMP '2024-01-13' THEN
event_id END), 6) AS seconds, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-19' THEN user_id END) AS active_profiles FROM events""")
def a33(spark, d):
    runs = table(spark, d, "events").select(F.col("ts").alias("at"), (F.col("value") / 100).alias("confidence"), F.col("event_id").alias("seconds"),
        F.col("user_id").alias("profile_id"))
    return records.performance_metrics(runs, F.lit("2024-01-20").cast("timestamp_ntz"))


@query("a35_normalisation_stats", """
SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS normalized, count(*) FILTER (WHERE toxic = 1) AS failed, count(*)
FILTER (WHERE quality = 0 AND toxic = 0) AS pending, round(100.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 0) / count(*), 2) AS rate FROM
labels""")
def a35(spark, d):
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "normalized").otherwise("pending")
    return records.normalisation_stats(table(spark, d, "labels").select(status.alias("status")))


@query("a39_false_positives",
    "SELECT event_type AS rule, round(avg(CASE WHEN value > 30 THEN 1.0 ELSE 0 END), 6) AS rate, count(*) AS n FROM events GROUP BY event_type")
def a39(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("rule"), F.col("ts").alias("at"), (F.col("value") > 30).alias("ignored"))
    return records.false_positive_rate(rows).withColumn("rate", F.round("rate", 6))


@query("d05_u05_merged_by_name", """
WITH b AS (SELECT o_custkey AS patient_id, lower(o_orderpriority) AS name_key, o_orderkey % 7 AS s, 0 AS fresh FROM orders UNION ALL SELECT o_custkey,
lower(o_orderpriority), 100, 1 FROM orders WHERE o_orderkey % 4 = 0)
SELECT patient_id, name_key, count(DISTINCT s) AS sources, max(fresh) = 1 AS touched FROM b GROUP BY patient_id, name_key""")
def d05(spark, d):
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    known = o.select(F.col("o_custkey").alias("patient_id"), F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("name"),
        n.cast("string").alias("value"), F.array((n % 7).cast("string")).alias("sources"))
    fresh = o.where(n % 4 == 0).select(F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("name"),
        n.cast("string").alias("value"), F.array(F.lit("100")).alias("sources"))
    return records.merged_by_name(known, fresh).select("patient_id", "name_key", F.size("sources").cast("long").alias("sources"), "touched")


@query("d12_soft_delete", """
SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS archived FROM orders""")
def d12(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("archived_at"))
    after, _ = reconcile.soft_deleted(o, o.where("o_orderkey % 3 = 0"), "o_orderkey", F.lit("2024-01-01").cast("timestamp_ntz"), "me")
    return after.select("o_orderkey", F.col("archived_at").isNotNull().alias("archived"))


@query("d04_narrative_versions", """
SELECT c_custkey AS id, c_custkey % 4 <> 0 AS is_current, 1 AS version, NULL::BIGINT AS supersedes_id FROM customer UNION ALL SELECT c_custkey +
1000000, true, 2, c_custkey FROM customer WHERE c_custkey % 4 = 0""")
def d04(spark, d):
    c = table(spark, d, "customer")
    current = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("k"), F.col("c_name").alias("content"), F.lit(1).alias("version"),
        F.lit(True).alias("is_current"), F.lit(None).cast("long").alias("supersedes_id"))
    fresh = c.where("c_custkey % 4 = 0").select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_custkey").alias("k"),
        F.lit("new").alias("content"))
    return reconcile.narrative_version(current, fresh, "k").select("id", "is_current", "version", "supersedes_id")


@query("g04_chain_heads", """
SELECT o_orderkey, last_value(o_orderkey) OVER w AS current, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER
BY o_orderdate, o_orderkey) AS steps FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING
AND UNBOUNDED FOLLOWING)""")
def g04(spark, d):
    return reconcile.chain_heads(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "current", "steps")


@query("a21_split_summary", """
SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS inter, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS intra,
round(avg(l_discount), 6) AS confidence, round(max(l_quantity) / count(*), 6) AS pages_per_split FROM lineitem GROUP BY l_orderkey""")
def a21(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0,
        "inter_page").otherwise("intra_page").alias("split_type"), F.col("l_discount").alias("confidence"), F.col("l_quantity").alias("pages"))
    return reconcile.split_summary(rows, "l_orderkey", "pages")


@query("j11_expanded_pages", "SELECT l_orderkey, l_linenumber, unnest(range(l_linenumber, l_linenumber + 3))::INT AS page FROM lineitem")
def j11(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") + 2).alias("until"))
    return reconcile.expanded_pages(rows, ["l_orderkey", "l_linenumber"], "l_linenumber", "until")


@query("t09_j14_carried_context", """
SELECT conv_id, turn, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'none') AS context FROM conversations""")
def t09(spark, d):
    return queues.carried_context(table(spark, d, "conversations"), "conv_id", "turn", "role", "none").select("conv_id", "turn", "context")


@query("t10_ready_sessions", """
SELECT conv_id, count(*) AS completed FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE turn % 5 = 4) = 0""")
def t10(spark, d):
    t = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 5 == 4, "failed").otherwise("completed").alias("status"))
    sizes = t.groupBy("conv_id").agg(F.count("*").alias("total_chunks"))
    return reconcile.ready_sessions(t.join(sizes, "conv_id"), "conv_id").select("conv_id", "completed")


@query("s22_uploads", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS k, ts FROM events)
SELECT event_id AS request_id, CASE WHEN k IS NULL THEN event_id WHEN k % 3 = 0 THEN -k ELSE first_value(event_id) OVER (PARTITION BY k ORDER BY ts,
event_id) END AS file_id, k IS NULL OR (k % 3 <> 0 AND first_value(event_id) OVER (PARTITION BY k ORDER BY ts, event_id) = event_id) AS is_new FROM
r""")
def s22(spark, d):
    e = table(spark, d, "events")
    asked = e.select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 6 != 0, F.col("user_id")).alias("idempotency_key"),
        F.col("ts").alias("at"))
    known = e.where("user_id % 3 = 0").select(F.col("user_id").alias("idempotency_key"), (-F.col("user_id")).alias("file_id")).distinct()
    return queues.uploads(asked, known)


@query("t07_n16_transitions", """
WITH u AS (SELECT o_custkey, max(o_orderdate) AS at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY o_custkey)
SELECT c_custkey AS job_id, CASE WHEN u.at IS NULL THEN 'pending' ELSE 'completed' END AS status, u.at AS completed_at FROM customer LEFT JOIN u ON
u.o_custkey = c_custkey""")
def t07(spark, d):
    none = F.lit(None)
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.lit("pending").alias("status"),
        none.cast("timestamp_ntz").alias("started_at"), none.cast("timestamp_ntz").alias("completed_at"), none.cast("string").alias("error"))
    updates = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.lit("completed").alias("new_status"),
        F.col("o_orderdate").alias("at"), none.cast("string").alias("error"))
    return queues.transitions(jobs, updates).select("job_id", "status", "completed_at")


@query("p16_n38_sliced_text", """
SELECT o_orderkey, '--- PAGE 2 START ---' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '[Y:340] a' || chr(10) END || '[Y:350] b' || chr(10)
|| 'plain' || chr(10) || '--- PAGE 2 END ---' AS text FROM orders""")
def p16(spark, d):
    text = "--- PAGE 1 START ---\n[Y:1] x\n--- PAGE 1 END ---\n--- PAGE 2 START ---\n[Y:340] a\n[Y:350] b\nplain\n--- PAGE 2 END ---\n--- PAGE 3 START ---\ny\n--- PAGE 3 END ---"
    rows = table(spark, d, "orders").select("o_orderkey", F.lit(text).alias("t"), F.lit(2).alias("a"), F.lit(2).alias("b"),
        F.when(F.col("o_orderkey") % 2 == 0, "intra_page").otherwise("page_start").alias("ak"), F.lit("page_end").alias("bk"), F.lit(500).alias("ay"),
        F.lit(None).cast("int").alias("by"))
    return layout.sliced_text(rows, "o_orderkey", "t", "a", "b", "ak", "bk", "ay", "by")


@query("w04_reading_order", "SELECT c_custkey, '2,1,3' AS ids FROM customer")
def w04(spark, d):
    block = lambda i, y, h, x: F.struct(F.lit(i).alias("id"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(h).alias("h"))
    ids = layout.reading_order(F.array(block(1, 0, 20, 50), block(2, 5, 20, 0), block(3, 30, 10, 0)))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))


@query("v11_marker_matches", over("words", """
SELECT page * 1000000 + seq AS marker_id, text, y FROM (SELECT *, row_number() OVER (PARTITION BY page, text ORDER BY seq) AS n FROM words) t WHERE n
= 1"""))
def v11(spark, d):
    words = stand_in(spark, d, "words")
    first = words.groupBy("page", "text").agg(F.min("seq").alias("seq"))
    marker = F.struct("page", "seq").alias("marker_id")
    markers = first.select(marker, "page",
        F.concat(F.lit('"'), F.upper("text"), F.lit('"')).alias("marker"), F.lit(None).cast("string").alias("context"),
        F.lit(None).cast("string").alias("region"), F.lit(3300).alias("page_height"))
    found = layout.marker_matches(words, markers)
    at = words.join(first, ["page", "text", "seq"], "left_semi").select(marker, F.col("y").alias("own"))
    number = F.col("marker_id.page") * 1000000 + F.col("marker_id.seq")
    return found.join(at, "marker_id").select(number.alias("marker_id"), "text", F.col("y").cast("int").alias("y"))


@query("f70_visual_share", """
SELECT p_size AS page, round(sum(CASE WHEN p_partkey % 3 = 0 THEN p_size * 10.0 ELSE 0 END) / sum(p_size * 10.0), 6) AS visual_share FROM part GROUP
BY p_size""")
def f70(spark, d):
    rows = table(spark, d, "part").select(F.col("p_size").alias("page"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(10).alias("x1"),
        F.col("p_size").alias("y1"), F.when(F.col("p_partkey") % 3 == 0, "picture").otherwise("text").alias("kind"))
    return layout.visual_share(rows).select("page", "visual_share")


@query("q14_checked_output", """
SELECT o_orderkey, o_orderkey % 3 <> 0 AS named, CASE WHEN o_orderkey % 10 < 8 OR o_orderkey % 3 = 0 THEN false ELSE true END AS valid FROM orders""")
def q14(spark, d):
    n = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", ((n % 10) / 10.0 + 0.05).alias("confidence"), F.lit(80.0).alias("completeness"),
        F.lit("Metformin").alias("medication"), F.lit("500 mg").alias("dosage"),
        F.when(n % 3 == 0, "of metformin").otherwise("Ann Lee takes METFORMIN").alias("ocr_text"), F.lit("Ann Lee").alias("patient_name"))
    out = model_output.checked_output(rows)
    return out.select("o_orderkey", (~F.array_contains("critical", "name_not_in_text")).alias("named"), "valid")


@query("l10_by_day", """
SELECT ts::DATE AS day, string_agg(event_id::VARCHAR, ',' ORDER BY ts DESC, event_id) AS events FROM (SELECT * FROM events ORDER BY ts DESC, event_id
LIMIT 200) t GROUP BY ts::DATE""")
def l10(spark, d):
    return timeline.by_day(table(spark, d, "events"), 200).select("day",
        F.array_join(F.transform("events", lambda e: e.cast("string")), ",").alias("events"))


@query("d13_retained", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY")
def d13(spark, d):
    return timeline.retained(table(spark, d, "events"), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 20).select("event_id")


@query("n07_u01_current_state", """
SELECT 'order' AS kind, o_orderkey::VARCHAR AS id, o_orderstatus AS name FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'event', event_id::VARCHAR,
event_type FROM events WHERE user_id = 7""")
def n07(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("name"), F.col("o_orderdate").alias("date"))
    events = table(spark, d, "events").select(F.col("user_id").alias("patient_id"), F.col("event_id").alias("id"), F.col("event_type").alias("name"),
        F.col("ts").alias("date"))
    return timeline.current_state({"order": orders, "event": events}, 7).select("kind", "id", "name")
