"""Queries of record operators and functions that no other query runs; each oracle says the same in its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..operators import access, flags, layout, model_output, processing, queues, reconcile, records
from ..registry import query
from ..sources import table

NOW = "TIMESTAMP '1997-06-15 00:00:00'"


def now():
    return F.lit("1997-06-15").cast("timestamp_ntz")


def braces(text: str):
    """A JSON text with ' for \" as a literal."""
    return F.lit(text.replace("'", '"'))


@query("p15_d08_split_points", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS page, l_partkey % 2 = 0 AS between, min(l_partkey % 40) OVER w AS low, max(l_suppkey % 40) OVER w AS high FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, count(*) FILTER (WHERE CASE WHEN between THEN page + 1 ELSE page END BETWEEN low AND high) AS kept, any_value(low % 3 < 2 AND (low % 5 = 0 OR high = 39)) AS goes_on FROM l GROUP BY l_orderkey""")
def p15(spark, d):
    n, page = F.col("l_partkey"), (F.col("l_partkey") % 40).cast("int")
    split = F.struct(F.when(n % 2 == 0, "inter_page").otherwise("intra_page").alias("split_type"), F.when(n % 2 == 0, F.array(page + 1, page + 2)).alias("between_pages"), F.when(n % 2 != 0, page).alias("page"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(split).alias("splits"), F.min(page).alias("low"), F.max((F.col("l_suppkey") % 40).cast("int")).alias("high"))
    goes_on = reconcile.cascades_on(F.col("low") % 3, F.lit(2), F.when(F.col("low") % 5 == 0, True), F.col("high"), F.lit(39))
    return rows.select("l_orderkey", F.size(reconcile.splits_within(F.col("splits"), F.col("low"), F.col("high"))).cast("long").alias("kept"), goes_on.alias("goes_on"))


@query("p18_n24_critical_events", """
SELECT event_id, event_type || '.' || (event_id % 3) IN ('click.0', 'purchase.2', 'view.1') AS critical, CASE event_id % 4 WHEN 0 THEN 'sys_primary' WHEN 1 THEN 'xprimary' WHEN 2 THEN 'primary' END LIKE '%_primary' AS ends FROM events""")
def p18(spark, d):
    n = F.col("event_id")
    critical = records.is_critical(F.col("event_type"), (n % 3).cast("string"), ["click.0", "purchase.2", "view.1"])
    system = F.when(n % 4 == 0, "sys_primary").when(n % 4 == 1, "xprimary").when(n % 4 == 2, "primary")
    return table(spark, d, "events").select("event_id", critical.alias("critical"), J.source_system(system, "primary").alias("ends"))


@query("p21_pending_reviews", """
SELECT event_id AS review_id, CASE event_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'urgent' WHEN 2 THEN 'critical' WHEN 3 THEN 'other' ELSE 'high' END AS priority, row_number() OVER (ORDER BY CASE event_id % 5 WHEN 2 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 3 WHEN 0 THEN 5 ELSE 6 END, ts, event_id)::INTEGER AS place
FROM events WHERE user_id = 4 AND event_id % 2 = 0""")
def p21(spark, d):
    n = F.col("event_id")
    priority = F.when(n % 5 == 0, "low").when(n % 5 == 1, "urgent").when(n % 5 == 2, "critical").when(n % 5 == 3, "other").otherwise("high")
    rows = table(spark, d, "events").select(n.alias("review_id"), F.col("user_id").alias("patient_id"), priority.alias("priority"), F.col("ts").alias("created_at"),
        F.when(n % 2 == 0, "pending").otherwise("done").alias("status"))
    ordered = records.pending_reviews(rows, 4).agg(F.collect_list(F.struct("review_id", "priority")).alias("r"))  # one patient's open reviews
    return ordered.select(F.posexplode("r").alias("i", "r")).select("r.*", (F.col("i") + 1).alias("place"))


@query("p24_n31_viewed_as", """
SELECT p_partkey AS code, p_name AS label, 'au' AS region FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 4 <> 0""")
def p24(spark, d):
    n = F.col("p_partkey")
    rows = table(spark, d, "part").withColumn("system", F.when(n % 3 == 1, "mbs").otherwise("pbs")).withColumn("archived_at", F.when(n % 4 == 0, now()))
    return records.viewed_as(rows, "mbs", {"code": "p_partkey", "label": "p_name"}, region="au")


@query("f38_block_text", """
SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag || l_linestatus || ' ' || l_partkey END, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS text FROM lineitem GROUP BY l_orderkey HAVING text IS NOT NULL""")
def f38(spark, d):
    word = lambda *letters: F.struct(F.array(*(F.struct(c.alias("text")) for c in letters)).alias("symbols"))
    empty = F.array().cast("array<struct<symbols:array<struct<text:string>>>>")
    words = F.when(F.col("l_returnflag") == "R", empty).otherwise(F.array(word(F.col("l_returnflag"), F.col("l_linestatus")), word(F.lit("")), word(F.col("l_partkey").cast("string"))))
    block = F.struct("l_linenumber", "l_partkey", F.array(F.struct(words.alias("words"))).alias("paragraphs"))
    blocks = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(block)).alias("b"))
    return blocks.select("l_orderkey", layout.block_text(F.col("b")).alias("text")).where("text <> ''")


@query("f54_f94_objects", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '{"language":"fr"}' ELSE '{"language":"en","country":"AU"}' END AS culture,
  '{"id":' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"segment":"' || c_mktsegment || '"' END || '}' AS object FROM customer""")
def f54(spark, d):
    n = F.col("c_custkey")
    culture = F.when(n % 4 == 0, braces("{'language':'fr'}")).when(n % 4 == 1, F.lit("{}")).when(n % 4 == 2, F.lit(""))
    made = J.object_of(id=n, segment=F.when(n % 3 != 0, F.col("c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", J.cultural_context(culture).alias("culture"), made.alias("object"))


@query("f73_text_height", """
WITH w AS (SELECT p_size AS page, p_partkey AS seq, p_brand AS text, p_partkey % 40 * 7 AS y, 8 + p_partkey % 5 AS height FROM part),
a AS (SELECT p_partkey AS ask_id, p_size AS page, 'see ' || p_brand AS marker, p_partkey % 40 * 7 + p_partkey % 13 AS y FROM part)
SELECT a.ask_id, arg_min(w.height, (CASE WHEN abs(w.y - a.y) <= 5 AND contains(lower(a.marker), lower(w.text)) THEN 0 ELSE 1 END, w.seq)) AS height FROM a LEFT JOIN w ON w.page = a.page AND abs(w.y - a.y) <= 10 GROUP BY a.ask_id""")
def f73(spark, d):
    n, part = F.col("p_partkey"), table(spark, d, "part")
    words = part.select(F.col("p_size").alias("page"), n.alias("seq"), F.col("p_brand").alias("text"), (n % 40 * 7).alias("y"), (8 + n % 5).alias("height"))
    asked = part.select(n.alias("ask_id"), F.col("p_size").alias("page"), F.concat(F.lit("see "), "p_brand").alias("marker"), (n % 40 * 7 + n % 13).alias("y"))
    return layout.text_height(words, asked)


@query("f15_f33_f75_f81_texts", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey / 4.0 END AS number, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS systolic, (length(o_orderpriority) + 3) // 4 + 50 AS tokens,
  CASE o_orderkey % 4 WHEN 0 THEN '{"a": ' || o_orderkey || '}' WHEN 1 THEN '{"b": {}}' END AS json, 'cascade_' || md5(o_orderkey || '_' || o_orderpriority)[1:8] AS cascade,
  'pending_' || o_custkey || '_' || lpad((o_orderkey % 7)::VARCHAR, 3, '0') || '_' || lpad((o_orderkey % 50)::VARCHAR, 3, '0') AS pending FROM orders""")
def f15(spark, d):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.when(n % 3 == 0, "none").otherwise(F.concat(F.lit("about "), (c / 4).cast("string"), F.lit(" units or 7")))
    pressure = F.when(n % 3 == 1, F.concat(F.lit("BP "), c.cast("string"), F.lit(" / 80"))).otherwise("no reading")
    text = n.cast("string")
    answer = (F.when(n % 4 == 0, F.concat(F.lit('so:\n```json\n{"a": '), text, F.lit("}\n``` done"))).when(n % 4 == 1, F.lit('well {"b": {}} ok')).when(n % 4 == 2, "no json"))
    return table(spark, d, "orders").select(
        "o_orderkey", T.first_number(said).alias("number"), T.blood_pressure(pressure)["systolic"].cast("long").alias("systolic"),
        model_output.estimated_tokens(F.col("o_orderpriority"), 50).alias("tokens"), T.json_object_of(answer).alias("json"),
        T.cascade_id(n, F.col("o_orderpriority")).alias("cascade"), T.pending_id(c, n % 7, n % 50).alias("pending"),
    )


@query("f90_f96_zones", """
WITH z AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 50 AS a, l_suppkey % 50 AS b, l_returnflag AS t FROM lineitem)
SELECT k, count(*) FILTER (WHERE t <> 'R') AS good, count(*) FILTER (WHERE t = 'R') AS bad, sum(greatest(a, b, least(a, b) + 1) - least(a, b)) FILTER (WHERE t <> 'R') AS high, sum(a + b) AS pairs FROM z GROUP BY k""")
def f96(spark, d):
    a, b = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    zone = F.struct(F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag")).alias("schema_type"), a.alias("y_start"), b.cast("string").alias("y_end"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.to_json(F.struct(F.collect_list(zone).alias("zones"))).alias("j"), F.to_json(F.collect_list(F.array(a, b))).alias("p"))
    good, bad = model_output.zones(rows, "k", "j")
    counts = good.groupBy("k").agg(F.count("*").alias("good"), F.sum(F.col("y_end") - F.col("y_start")).alias("high"))
    wrong = bad.groupBy("k").agg(F.count("*").alias("bad"))
    pairs = rows.select("k", F.aggregate(F.flatten(J.number_pairs(F.col("p"))), F.lit(0).cast("long"), lambda s, x: s + x).alias("pairs"))
    return pairs.join(counts, "k", "left").join(wrong, "k", "left").select("k", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"), "high", "pairs")


@query("d14_expired_access", f"""
SELECT CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 AND o_orderdate < {NOW} THEN 'expired' WHEN o_orderkey % 4 = 0 THEN 'revoked' ELSE 'active' END AS status, count(*) AS n,
  (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 AND o_orderdate < {NOW}) AS told FROM orders GROUP BY status""")
def d14(spark, d):
    n = F.col("o_orderkey")
    grants = table(spark, d, "orders").select(n.alias("grant_id"), F.when(n % 4 == 0, "revoked").otherwise("active").alias("status"), F.when(n % 3 != 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("expires_at"))
    after, counted = access.expired_access(grants, now())
    return after.groupBy("status").agg(F.count("*").alias("n")).crossJoin(F.broadcast(counted.select(F.col("expired").alias("told"))))  # one row


@query("q17_q18_resolved_flags", """
WITH f AS (SELECT doc_id FROM labels), e AS (SELECT user_id AS doc_id, arg_max(event_type, (ts, event_type, event_id % 7)) AS status, max(ts) AS at FROM events GROUP BY user_id)
SELECT f.doc_id, coalesce(e.status, 'open') AS status, e.at AS resolved_at, CASE WHEN f.doc_id % 100 / 100.0 < 0.7 THEN 'Low confidence in chunk ' || f.doc_id || ': ' || round(f.doc_id % 100 / 100.0, 2)::DOUBLE END AS reason FROM f LEFT JOIN e ON e.doc_id = f.doc_id""")
def q17(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("flag_id"))
    decisions = table(spark, d, "events").select(F.col("user_id").alias("flag_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), (F.col("event_id") % 7).alias("by"))
    found = flags.resolved(rows, decisions)
    chunks = rows.select(F.col("flag_id").alias("chunk"), (F.col("flag_id") % 100 / 100).alias("confidence"))
    reasons = flags.review_reasons(chunks).select(F.col("chunk").alias("flag_id"), "reason")
    return found.join(reasons, "flag_id", "left").select(F.col("flag_id").alias("doc_id"), "status", "resolved_at", "reason")


@query("n10_given_consent", f"""
SELECT o_custkey AS patient_id, o_orderkey AS consent_type, o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 AS granted, o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 AS revoked,
  CASE WHEN o_orderkey % 3 <> 0 THEN '{{"a":"1"}}' WHEN o_orderkey % 2 = 0 THEN '{{"b":"2"}}' ELSE '{{"a":"3"}}' END AS evidence FROM orders WHERE o_orderkey % 6 <> 0
UNION ALL SELECT o_custkey, o_orderkey, true, false, '{{"b":"2"}}' FROM orders WHERE o_orderkey % 6 = 0""")
def n10(spark, d):
    n, o = F.col("o_orderkey"), table(spark, d, "orders")
    key = [F.col("o_custkey").alias("patient_id"), n.alias("consent_type")]
    old = o.where("o_orderkey % 6 <> 0").select(*key, (n % 2 == 0).alias("granted"), F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.when(n % 5 == 0, now()).alias("revoked_at"), braces("{'a':'1'}").alias("evidence"))
    fresh = o.where("o_orderkey % 3 = 0").select(*key, F.when(n % 2 == 0, braces("{'b':'2'}")).otherwise(braces("{'a':'3'}")).alias("evidence"))
    after = access.given_consent(old, fresh, now())
    return after.select("patient_id", "consent_type", "granted", F.col("revoked_at").isNotNull().alias("revoked"), "evidence")


@query("n11_granted_access", """
WITH g AS (SELECT o_orderkey AS grant_id, o_custkey % 20 AS provider_id, o_custkey AS patient_id, CASE WHEN o_orderkey % 4 = 0 THEN 'revoked' ELSE 'active' END AS status FROM orders WHERE o_orderkey % 2 = 0),
f AS (SELECT DISTINCT o_custkey % 25 AS provider_id, o_custkey AS patient_id FROM orders WHERE o_orderkey % 7 = 1), v AS (SELECT f.*, provider_id % 3 <> 0 AND provider_id < 20 AS fine FROM f),
a AS (SELECT CASE WHEN status = 'active' AND EXISTS (SELECT 1 FROM v WHERE v.fine AND v.provider_id = g.provider_id AND v.patient_id = g.patient_id) THEN 'revoked' ELSE status END AS status FROM g UNION ALL SELECT 'active' FROM v WHERE fine
  UNION ALL SELECT CASE WHEN provider_id >= 20 THEN 'provider_not_found' ELSE 'provider_not_verified' END FROM v WHERE NOT fine)
SELECT status, count(*) AS n FROM a GROUP BY status""")
def n11(spark, d):
    n, c, o = F.col("o_orderkey"), F.col("o_custkey"), table(spark, d, "orders")
    grants = o.where("o_orderkey % 2 = 0").select(n.alias("grant_id"), (c % 20).alias("provider_id"), c.alias("patient_id"), F.when(n % 4 == 0, "revoked").otherwise("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("revoked_at"))
    fresh = o.where("o_orderkey % 7 = 1").select((c % 25).alias("provider_id"), c.alias("patient_id")).distinct().withColumn("grant_id", -F.col("patient_id"))
    providers = o.select((c % 20).alias("provider_id")).distinct().withColumn("verified", F.col("provider_id") % 3 != 0)
    after, refused = records.granted_access(grants, fresh, providers, now())
    return after.select("status").union(refused.select("reason")).groupBy("status").agg(F.count("*").alias("n"))


@query("n12_answered_items", """
WITH i AS (SELECT o_orderkey AS item_id, o_custkey AS patient_id FROM orders), a AS (SELECT l_orderkey AS item_id, l_suppkey % 10 AS provider_id, CASE l_linenumber % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'declined' ELSE 'seen' END AS status FROM lineitem),
m AS (SELECT a.item_id, max((status, provider_id)) AS m FROM a JOIN i ON i.item_id = a.item_id WHERE provider_id = patient_id % 10 OR provider_id = patient_id % 7 GROUP BY a.item_id)
SELECT coalesce(m.m[1], 'open') AS status, m.m[1] IN ('completed', 'declined') AND m.m IS NOT NULL AS done, count(*) AS n FROM i LEFT JOIN m ON m.item_id = i.item_id GROUP BY 1, 2""")
def n12(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("patient_id"), F.lit("open").alias("status"))
    k = F.col("l_linenumber") % 3
    answers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), (F.col("l_suppkey") % 10).alias("provider_id"), F.when(k == 0, "completed").when(k == 1, "declined").otherwise("seen").alias("status"), F.lit("x").alias("response"))
    may = items.select("patient_id", F.explode(F.array(F.col("patient_id") % 10, F.col("patient_id") % 7)).alias("provider_id"))
    found = records.answered_items(items, answers, may, now())
    return found.groupBy("status", F.col("resolved_at").isNotNull().alias("done")).agg(F.count("*").alias("n"))


@query("n42_retry_waits", """
SELECT event_id, CASE WHEN event_id % 5 > 3 THEN 300000.0 WHEN event_id % 3 = 0 THEN event_id % 90 * 1000.0 WHEN event_id % 3 = 1 THEN greatest(0, event_id % 60 - 20) * 1000.0 ELSE least(60000.0, 1000.0 * 2.0 ** (event_id % 5 - 1)) END AS ms FROM events""")
def n42(spark, d):
    n = F.col("event_id")
    told = F.concat(F.lit("Sun, 15 Jun 1997 00:00:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(" GMT"))
    after = F.when(n % 3 == 0, (n % 90).cast("string")).when(n % 3 == 1, told)
    return table(spark, d, "events").select("event_id", queues.retry_wait(n % 5, after, F.lit("1997-06-15 00:00:20").cast("timestamp"), most=3).alias("ms"))


@query("q15_legacy_checks", f"""
WITH x AS (SELECT o_orderkey AS document_id, o_orderdate::DATE AS date, CASE o_orderkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Someone else' WHEN 2 THEN '' ELSE 'customer ' || c_mktsegment END AS name, lower(c_name || ' ' || c_mktsegment) AS display,
  (CASE WHEN o_orderkey % 4 <> 2 AND o_orderkey % 3 <> 0 THEN 2.0 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1.5 ELSE 0 END + 1.0 + CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE 0 END) / 5.5 AS share FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT *, string_split(lower(name), ' ') AS a, string_split(display, ' ') AS b FROM x),
y AS (SELECT *, len(list_filter(a, lambda w: len(list_filter(b, lambda v: contains(w, v) OR contains(v, w))) > 0)) / greatest(len(a), len(b)) AS alike FROM s)
SELECT document_id, 'future_date_check' AS problem_code, 'warning' AS severity, 0.85::DOUBLE AS confidence, '1997-06-15' AS suggestion FROM y WHERE date_diff('day', DATE '1997-06-15', date) > 30
UNION ALL SELECT document_id, 'name_similarity_check', 'critical', round(1 - alike, 6), display FROM y WHERE name <> '' AND alike < 0.6
UNION ALL SELECT document_id, 'incomplete_extraction', 'warning', 0.8, NULL FROM y WHERE share < 0.4""")
def q15(spark, d):
    n, segment = F.col("o_orderkey"), F.col("c_mktsegment")
    name = F.when(n % 4 == 0, F.col("c_name")).when(n % 4 == 1, "Someone else").when(n % 4 == 2, "").otherwise(F.concat(F.lit("customer "), segment))
    filled = {"patient_info": (name != "") & (n % 3 != 0), "medical_data": n % 5 == 0, "dates": F.lit(True), "provider": F.when(n % 7 == 0, True)}
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        n.alias("document_id"), F.col("o_custkey").alias("profile_id"), F.col("o_orderdate").cast("timestamp_ntz").cast("date").alias("document_date"), name.alias("name"),
        F.lower(F.concat("c_name", F.lit(" "), segment)).alias("display_name"), flags.legacy_completeness(filled).alias("completeness"),
    )
    found = flags.raised(rows, "documents", flags.legacy_rules(now()))
    return found.select("document_id", "problem_code", "severity", F.round("confidence", 6).alias("confidence"), "suggestion")


@query("f93_split_and_joined", """
SELECT p_partkey, len(string_split(p_name, ' ')) AS n, array_to_string(list_reverse(list_filter(string_split(p_name, ' '), lambda w: w <> '')), ', ') AS said FROM part""")
def f93(spark, d):
    words = T.words_of(F.col("p_name"), " ")
    return table(spark, d, "part").select("p_partkey", F.size(words).cast("long").alias("n"), T.words_joined(F.reverse(words), ", ").alias("said"))


@query("t04_delayed_jobs", """
WITH l AS (SELECT max(CASE WHEN n_nationkey % 2 = 0 AND n_nationkey * 4.0 / 50 > 0.8 THEN n_nationkey * 10 END) AS wait FROM nation)
SELECT event_id AS job_id, ts + to_seconds(CASE WHEN event_id % 4 = 1 THEN coalesce(wait, 0) ELSE 0 END) AS scheduled_at FROM events, l""")
def t04(spark, d):
    n = F.col("n_nationkey")
    limits = table(spark, d, "nation").select(F.lit("p").alias("provider"), F.when(n % 2 == 0, "e").otherwise("f").alias("endpoint"), F.lit("active").alias("status"), (n * 4).alias("requests_used"),
        F.lit(50).alias("requests_per_minute"), F.lit(0.8).alias("threshold"), (n * 10).alias("delay_seconds"))
    jobs = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 4 == 1, "ai_processing").otherwise("audit_cleanup").alias("job_type"), F.col("ts").alias("scheduled_at"))
    return queues.delayed(jobs, limits, "p", "e").select("job_id", "scheduled_at")


@query("n41_handed_over", """
SELECT o_orderkey AS visit_id, CASE WHEN o_orderkey % 3 = 0 THEN 'encounter_temp_generated_' || md5(o_orderkey::VARCHAR)[1:9] WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'encounter_temp_generated_' || md5(o_orderkey::VARCHAR)[1:9] ELSE 't' || o_orderkey END AS temp_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'told' WHEN o_orderkey % 4 = 0 THEN 'discharge_summary' WHEN o_orderkey % 4 = 1 THEN 'post_operative_notes' WHEN o_orderkey % 4 = 2 THEN 'results_or_report' ELSE 'continuation' END AS expected_continuation FROM orders""")
def n41(spark, d):
    n = F.col("o_orderkey")
    temp = F.when(n % 3 == 0, F.lit(None).cast("string")).when((n % 3 == 1) & (n % 2 == 0), "x_undefined_1").otherwise(F.concat(F.lit("t"), n.cast("string")))
    kind = F.when(n % 4 == 0, "Inpatient stay").when(n % 4 == 1, "Surgery").when(n % 4 == 2, "imaging visit").otherwise("walk")
    told = F.when(n % 5 == 0, "told").when(n % 5 == 1, "")
    rows = table(spark, d, "orders").select(n.alias("visit_id"), temp.alias("temp_id"), kind.alias("kind"), told.alias("expected_continuation"))
    return processing.handed_over(rows).select("visit_id", "temp_id", "expected_continuation")
