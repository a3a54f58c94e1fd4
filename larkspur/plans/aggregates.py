"""Queries of aggregations, joins, windows and unions, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import month_bounds
from ..operators import access, queues, reconcile, records, retrieval, scan, timeline
from ..operators import aggregates as A
from ..registry import query
from ..sources import table

c = F.col


@query("a02_conditional_counts", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS large, count(*) AS n FROM events GROUP
BY user_id""")
def a02(spark, d):
    t = lambda name: table(spark, d, name)
    return A.conditional_counts(t("events"), ["user_id"], {"errors": c("event_type") == "error", "large": c("value") > 50})


@query("a03_filtered_distinct", """
SELECT o_orderpriority, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS customers FROM orders GROUP BY o_orderpriority""")
def a03(spark, d):
    t = lambda name: table(spark, d, name)
    return A.distinct_where(t("orders"), ["o_orderpriority"], {"customers": (c("o_custkey"), c("o_totalprice") > 100000)})


@query("a04_distinct_lists", """
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey""")
def a04(spark, d):
    t = lambda name: table(spark, d, name)
    return A.distinct_list(t("orders"), ["o_custkey"], "o_orderpriority", "priorities").withColumn("priorities", F.array_join("priorities", ","))


@query("a05_ordered_lists", """
SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders WHERE o_totalprice > 50000 GROUP BY
o_custkey""")
def a05(spark, d):
    t = lambda name: table(spark, d, name)
    return A.ordered_list(t("orders").where("o_totalprice > 50000"), ["o_custkey"], c("o_orderkey").cast("string"), ["o_orderdate", "o_orderkey"],
        "orders").withColumn("orders", F.array_join("orders", ","))


@query("a07_distinct_concat", """
SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey""")
def a07(spark, d):
    t = lambda name: table(spark, d, name)
    return A.distinct_concat(t("nation"), ["n_regionkey"], "n_name", "names")


@query("a08_group_filter", """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12""")
def a08(spark, d):
    t = lambda name: table(spark, d, name)
    return A.frequent(t("orders"), ["o_custkey"], 12)


@query("a09_global_having", """
SELECT count(*) AS n, max(o_totalprice) AS top FROM orders HAVING count(*) > 10""")
def a09(spark, d):
    t = lambda name: table(spark, d, name)
    return A.overall(t("orders"), {"n": F.count("*"), "top": F.max("o_totalprice")}, c("n") > 10)


@query("a10_category_stats", """
SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE value > 80) AS major FROM events GROUP BY
user_id, event_type""")
def a10(spark, d):
    t = lambda name: table(spark, d, name)
    return A.category_stats(t("events"), ["user_id", "event_type"], "ts", c("value") > 80)


@query("a11_volume_stats", """
SELECT 'orders' AS source, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS active FROM orders
UNION ALL SELECT 'events', count(*), count(*) FILTER (WHERE event_type <> 'error') FROM events UNION ALL SELECT 'customer', count(*), count(*) FILTER
(WHERE c_acctbal > 0) FROM customer""")
def a11(spark, d):
    t = lambda name: table(spark, d, name)
    return A.volume_stats({"orders": (t("orders"), c("o_orderstatus") == "O"), "events": (t("events"), c("event_type") != "error"),
        "customer": (t("customer"), c("c_acctbal") > 0)})


@query("a12_dashboard", """
SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT round(avg(c_acctbal), 4)
FROM customer) AS balance""")
def a12(spark, d):
    t = lambda name: table(spark, d, name)
    return A.dashboard({"orders": (t("orders"), F.count("*")), "errors": (t("events"), F.count_if(c("event_type") == "error")),
        "balance": (t("customer"), F.round(F.avg("c_acctbal"), 4))})


@query("a13_elapsed_ms", """
SELECT user_id, date_sub('millisecond', min(ts), max(ts)) AS elapsed_ms FROM events GROUP BY user_id""")
def a13(spark, d):
    t = lambda name: table(spark, d, name)
    return A.elapsed_ms(t("events"), ["user_id"], "ts", "ts")


@query("a15_mean_default", """
SELECT p.p_partkey, coalesce(round(avg(l.l_discount), 6), 0.85) AS confidence FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey AND
l.l_quantity > 45 GROUP BY p.p_partkey""")
def a15(spark, d):
    t = lambda name: table(spark, d, name)
    return A.mean_or(t("part"), t("lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "l_discount", 0.85, "confidence",
        c("l_quantity") > 45).withColumn("confidence", F.round("confidence", 6))


@query("a19_histogram", """
SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def a19(spark, d):
    t = lambda name: table(spark, d, name)
    return A.histogram(t("events"), "event_type")


@query("a20_batch_sizes", """
SELECT count(*) AS n, coalesce(round(avg(k), 6), 0) AS mean_k, coalesce(min(k), 0) AS min_k, coalesce(max(k), 0) AS max_k FROM (SELECT count(*) AS k
FROM lineitem GROUP BY l_orderkey) t""")
def a20(spark, d):
    t = lambda name: table(spark, d, name)
    return queues.batch_sizes(t("lineitem").groupBy("l_orderkey").count(), "count").select(c("batches").alias("n"), c("mean").alias("mean_k"),
        c("least").alias("min_k"), c("most").alias("max_k"))


@query("a23_best_model", """
SELECT o_orderpriority, arg_min(o_orderstatus, m) AS best FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY
o_orderpriority, o_orderstatus) t GROUP BY o_orderpriority""")
def a23(spark, d):
    t = lambda name: table(spark, d, name)
    return retrieval.best_models(t("orders"), "o_orderpriority", ["o_orderstatus"], "o_totalprice").select("o_orderpriority",
        c("o_orderstatus").alias("best"))


@query("a25_any_true", """
SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey""")
def a25(spark, d):
    t = lambda name: table(spark, d, name)
    return A.any_true(t("lineitem"), ["l_orderkey"], c("l_returnflag") == "R", "returned")


@query("a32_health_check", """
SELECT event_type, count(*) AS n, CASE WHEN count(*) > 3000 THEN 'CRITICAL' WHEN count(*) > 1000 THEN 'WARNING' ELSE 'OK' END AS status FROM events
GROUP BY event_type""")
def a32(spark, d):
    t = lambda name: table(spark, d, name)
    return records.health_checks(A.histogram(t("events"), "event_type", "value").withColumnRenamed("event_type", "metric"),
        dict.fromkeys(("signup", "purchase", "error", "view", "click"), (1001, 3001))).select(c("metric").alias("event_type"), c("value").alias("n"),
        "status")


@query("a34_quality", """
SELECT round(avg(l_discount * l_quantity), 6) AS score, round(100.0 * count(*) FILTER (WHERE l_tax > 0) / nullif(count(*), 0), 1) AS complete FROM
lineitem""")
def a34(spark, d):
    t = lambda name: table(spark, d, name)
    return A.quality_assessment(t("lineitem"), "l_discount", "l_quantity", c("l_tax") > 0)


@query("j02_left_chain", """
SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey =
n.n_regionkey""")
def j02(spark, d):
    t = lambda name: table(spark, d, name)
    return A.left_chain(t("customer").select("c_custkey", "c_nationkey"),
        (t("nation"), c("n_nationkey") == c("c_nationkey"), ["n_name", "n_regionkey"]),
        (t("region"), c("r_regionkey") == c("n_regionkey"), ["r_name"])).select("c_custkey", "n_name", "r_name")


@query("j03_fanout_rewrite", """
SELECT c_custkey, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS done, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN
o_orderkey END) AS large FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def j03(spark, d):
    t = lambda name: table(spark, d, name)
    return A.distinct_where(t("customer").join(t("orders"), c("o_custkey") == c("c_custkey"), "left"), ["c_custkey"],
        {"done": (c("o_orderkey"), c("o_orderstatus") == "F"), "large": (c("o_orderkey"), c("o_totalprice") > 100000)})


@query("j05_self_join", """
SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def j05(spark, d):
    t = lambda name: table(spark, d, name)
    return access.allowed_patients(t("supplier").select(c("s_suppkey").alias("profile_id"), c("s_nationkey").alias("owner_id"),
        F.lit("self").alias("profile_type"), F.lit(False).alias("archived")),
        F.lit("2024-01-01").cast("timestamp_ntz")).where("scope = 'emergency'").select(c("profile_id").alias("a"), c("patient_id").alias("b"))


@query("j06_semi", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)""")
def j06(spark, d):
    t = lambda name: table(spark, d, name)
    return A.with_match(t("customer"), t("orders").where("o_totalprice > 150000").withColumnRenamed("o_custkey", "c_custkey"),
        "c_custkey").select("c_custkey")


@query("j07_anti_recent", """
SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate > TIMESTAMP
'1998-01-01')""")
def j07(spark, d):
    t = lambda name: table(spark, d, name)
    return A.without_recent(t("customer"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderdate",
        F.lit("1998-01-01").cast("timestamp_ntz")).select("c_custkey")


@query("j09_either_side", """
SELECT n_nationkey AS a, n_regionkey AS b, 'child' AS side FROM nation WHERE n_nationkey IN (1, 2, 3) UNION ALL SELECT n_nationkey, n_regionkey,
'parent' FROM nation WHERE n_regionkey IN (1, 2)""")
def j09(spark, d):
    t = lambda name: table(spark, d, name)
    return A.either_side(t("nation").select(c("n_nationkey").alias("a"), c("n_regionkey").alias("b")), "a", "b", [1, 2, 3], [1, 2])


@query("j11_expand_pages", """
SELECT l_orderkey, l_linenumber, unnest(range(l_linenumber, l_linenumber + 3))::INT AS page FROM lineitem""")
def j11(spark, d):
    t = lambda name: table(spark, d, name)
    return reconcile.expanded_pages(t("lineitem").withColumn("until", c("l_linenumber") + 2), ["l_orderkey", "l_linenumber"], "l_linenumber", "until")


@query("j13_latest_of_group", """
SELECT l_orderkey, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY l_orderkey""")
def j13(spark, d):
    t = lambda name: table(spark, d, name)
    return A.latest_of_group(t("lineitem"), ["l_orderkey"], "l_partkey", ["l_shipdate", "l_linenumber", "l_partkey"], "part")


@query("w02_chunk_gaps", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, turn + cast(floor(turn / 3) AS bigint) AS v, lag(turn + cast(floor(turn / 3) AS bigint)) OVER
(PARTITION BY conv_id ORDER BY turn) AS before
FROM conversations) t WHERE v <> before + 1""")
def w02(spark, d):
    t = lambda name: table(spark, d, name)
    return scan.gaps(t("conversations").select("conv_id", "turn"), ["conv_id"], c("turn") + F.floor(c("turn") / 3))


@query("w08_chunks", """
SELECT event_id, cast(floor((event_id - 1) / 50) AS bigint) + 1 AS chunk FROM events""")
def w08(spark, d):
    t = lambda name: table(spark, d, name)
    return t("events").select("event_id", A.chunk_of(c("event_id")).alias("chunk"))


@query("w09_renumber", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS n FROM
lineitem""")
def w09(spark, d):
    t = lambda name: table(spark, d, name)
    return A.numbered(t("lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]).select("l_orderkey", "l_linenumber",
        "n")


@query("w10_total_with_page", """
SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders""")
def w10(spark, d):
    t = lambda name: table(spark, d, name)
    return A.with_total(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


@query("l02_ranked_order", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END AS rank FROM orders ORDER BY rank,
o_orderdate, o_orderkey LIMIT 50""")
def l02(spark, d):
    t = lambda name: table(spark, d, name)
    return A.ranked(t("orders"), F.when(c("o_orderpriority").startswith("1"), 0).when(c("o_orderpriority").startswith("2"), 1).otherwise(2),
        ["o_orderdate", "o_orderkey"], 50).select("o_orderkey", "rank")


@query("l05_offset_page", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def l05(spark, d):
    t = lambda name: table(spark, d, name)
    return timeline.offset_page(t("orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 40).select("o_orderkey", "o_totalprice")


@query("u01_tagged_union", """
SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT
'part', p_partkey, p_name FROM part""")
def u01(spark, d):
    t = lambda name: table(spark, d, name)
    return A.tagged_union(**{k: t(k).select(c(f"{p}key").alias("id"), c(n).alias("name")) for k, p,
        n in (("customer", "c_cust", "c_name"), ("supplier", "s_supp", "s_name"), ("part", "p_part", "p_name"))})


@query("u03_distinct_branches", """
SELECT DISTINCT c_nationkey AS k FROM customer UNION ALL SELECT DISTINCT s_nationkey FROM supplier""")
def u03(spark, d):
    t = lambda name: table(spark, d, name)
    return A.distinct_branches(t("customer").select(c("c_nationkey").alias("k")), t("supplier").select(c("s_nationkey").alias("k")))


@query("u04_keep_first", """
SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS n FROM
orders) t WHERE n = 1""")
def u04(spark, d):
    t = lambda name: table(spark, d, name)
    return A.keep_first(t("orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("p08_validity", """
SELECT o_orderkey FROM orders WHERE TIMESTAMP '1996-06-01' >= o_orderdate AND (o_totalprice < 1000 OR TIMESTAMP '1996-06-01' <= o_orderdate + INTERVAL
'90' DAY)""")
def p08(spark, d):
    t = lambda name: table(spark, d, name)
    return t("orders").where(access.valid_at(c("o_orderdate"), F.when(c("o_totalprice") >= 1000, F.timestamp_add("DAY", F.lit(90), c("o_orderdate"))),
        F.lit("1996-06-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("p10_status_buckets", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'critical' WHEN c_acctbal < 1000 THEN 'warning' ELSE 'ok' END AS status FROM customer""")
def p10(spark, d):
    t = lambda name: table(spark, d, name)
    return t("customer").select("c_custkey", A.bucketed(c("c_acctbal"), [(0, "critical"), (1000, "warning")], "ok").alias("status"))


@query("p12_json_field", """
SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE props->>'$.k' IS NOT NULL""")
def p12(spark, d):
    t = lambda name: table(spark, d, name)
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k IS NOT NULL")


@query("f57_month_bucket", """
SELECT year(o_orderdate) * 100 + month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate) * 100 + month(o_orderdate)""")
def f57(spark, d):
    t = lambda name: table(spark, d, name)
    return A.histogram(t("orders").select((F.year(month_bounds(c("o_orderdate"))["first"]) * 100 + F.month("o_orderdate")).alias("m")), "m")


@query("s18_date_spine", """
SELECT day::DATE AS day, year(day) AS y, month(day) AS m, day(day) AS d FROM (SELECT unnest(generate_series(DATE '2000-01-01', DATE '2050-12-31',
INTERVAL 1 DAY)) AS day) t""")
def s18(spark, d):
    t = lambda name: table(spark, d, name)
    return A.date_spine(spark, "2000-01-01", "2050-12-31").select("day", F.year("day").alias("y"), F.month("day").alias("m"),
        F.dayofmonth("day").alias("d"))


@query("d13_retention", """
SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL '20' DAY GROUP BY event_type""")
def d13(spark, d):
    t = lambda name: table(spark, d, name)
    return A.histogram(timeline.retained(t("events"), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 20), "event_type", "kept")
