"""Queries that apply the operator functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import reconcile, retrieval, scan, timeline
from ..registry import query
from ..sources import page_manifest, split_valid, table


@query("p02_timeline_filter", """
SELECT event_id, user_id, event_type, ts, value FROM events WHERE event_type IN ('purchase', 'signup')
AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND value >= 1 AND contains(lower(props), '"k"')""")
def p02(spark, d):
    rows = timeline.timeline_filter(table(spark, d, "events"), ["purchase", "signup"], "2024-01-05", "2024-01-25", 1, '"K"')
    return rows.select("event_id", "user_id", "event_type", "ts", "value")


@query("l06_keyset_page", """
SELECT event_id, ts, true AS has_more FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id > 5)
ORDER BY ts DESC, event_id LIMIT 25""")
def l06(spark, d):
    return timeline.keyset_page(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", ("2024-01-20", 5), 25)


@query("w03_merge_ranges", """
WITH r AS (SELECT l_orderkey, l_linenumber * 3 AS a, l_linenumber * 3 + l_quantity::INT % 5 AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
i AS (SELECT *, sum(CASE WHEN a <= p + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY a, b) AS g FROM m)
SELECT l_orderkey, min(a) AS a, max(b) AS b FROM i GROUP BY l_orderkey, g""")
def w03(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 3).alias("a"),
        (F.col("l_linenumber") * 3 + F.col("l_quantity").cast("int") % 5).alias("b"))
    return scan.merged_ranges(r, "l_orderkey", "a", "b")


@query("a26_longest_value", """
SELECT c_nationkey, arg_max(c_mktsegment, length(c_mktsegment) * 1000000 - c_custkey) AS longest FROM customer GROUP BY c_nationkey""")
def a26(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(reconcile.longest_value("c_mktsegment", "c_custkey").alias("longest"))


@query("a14_weighted_confidence", """
SELECT l_orderkey, round(sum(l_quantity * CASE WHEN l_discount IS NULL OR l_discount = 0 THEN 0.5 ELSE l_discount END) / sum(l_quantity), 9) AS
confidence
FROM lineitem GROUP BY l_orderkey""")
def a14(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(reconcile.weighted_confidence("l_discount", F.col("l_quantity")),
        9).alias("confidence"))


@query("d02_current_versions", """
SELECT o_orderkey, lead(o_orderdate) OVER w AS valid_to, lead(o_orderkey) OVER w AS superseded_by, lead(o_orderkey) OVER w IS NULL AS is_current
FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def d02(spark, d):
    rows = reconcile.current_versions(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", "valid_to", "superseded_by", "is_current")


@query("d03_upsert", """
WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, 0 AS fresh FROM orders UNION ALL SELECT o_custkey, xor(o_orderkey, 1), o_totalprice + 1, 1 FROM
orders)
SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey
DESC, fresh DESC) = 1""")
def d03(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    new = o.select("o_custkey", F.col("o_orderkey").bitwiseXOR(F.lit(1)).alias("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return reconcile.upsert(o, new, ["o_custkey"], "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("v07_lexical_matches", """
WITH h AS (SELECT p_partkey, contains(lower(p_name), 'widget')::INT + contains(lower(p_name), 'bolt')::INT + contains(lower(p_name), 'cold')::INT AS
hits FROM part)
SELECT p_partkey, hits, hits / 3.0 AS score FROM h WHERE hits > 0 ORDER BY hits DESC, p_partkey LIMIT 20""")
def v07(spark, d):
    return retrieval.lexical_matches(table(spark, d, "part"), "p_name", ["Widget", "bolt", " ", "cold"], "p_partkey")


@query("f05_embeddable", r"""
SELECT doc_id, coalesce(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 2 AND length(text) <= 8000 AND length(regexp_replace(text,
'[\s\d\-./]', '', 'g')) >= 2, false) AS ok FROM documents""")
def f05(spark, d):
    return table(spark, d, "documents").select("doc_id", X.embeddable(F.col("text")).alias("ok"))


@query("f06_sanitized_text", r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 500) AS shown FROM documents")
def f06(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sanitized(F.col("text")).alias("shown"))


@query("f12_folded_similarity", """
SELECT n_nationkey, round(1 - levenshtein(lower(n_name), lower(r_name)) / greatest(length(n_name), length(r_name)), 6) AS similarity FROM nation JOIN
region ON n_regionkey = r_regionkey""")
def f12(spark, d):
    j = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    return j.select("n_nationkey", F.round(X.name_similarity(F.col("n_name"), F.col("r_name")), 6).alias("similarity"))


@query("f07_normalize_identifier", "SELECT s_suppkey, lower(regexp_replace(s_name, '[\\s\\-_#]', '', 'g')) AS v FROM supplier")
def f07(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.replace(X.normalize_identifier(F.col("s_name")), F.lit("#"), F.lit("")).alias("v"))


@query("f11_name_similarity", """
SELECT n_nationkey, round(1 - levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)), 6) AS similarity FROM nation JOIN region ON
n_regionkey = r_regionkey""")
def f11(spark, d):
    j = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    return j.select("n_nationkey", F.round(X.similarity(F.col("n_name"), F.col("r_name")), 6).alias("similarity"))


@query("f24_masked_identifiers", "SELECT c_custkey, '***' || sha256(c_name)[1:6] || ':' || right(c_name, 6) AS shown FROM customer")
def f24(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.mask_identifier(F.col("c_name")).alias("shown"))


@query("f25_truncated_text", """
SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '... [truncated ' || (length(text) - 80) || ' chars]' ELSE text END AS shown FROM
documents""")
def f25(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncated(F.col("text"), 80).alias("shown"))


@query("f50_normalized_dates", """
WITH x AS (SELECT event_id, ts::DATE AS t, event_id % 5 AS k FROM events)
SELECT event_id, strftime(CASE WHEN k = 1 AND day(t) <= 12 THEN make_date(2024, day(t), month(t)) ELSE t END, '%Y-%m-%d') AS iso, k IN (0, 1) AND
day(t) <= 12 AS ambiguous,
CASE WHEN k IN (0, 1) AND day(t) <= 12 THEN 'ambiguous_default' WHEN k = 0 THEN 'dd_mm' WHEN k = 1 THEN 'mm_dd' WHEN k = 2 THEN 'iso' ELSE 'text' END
AS method, CASE WHEN k IN (0, 1) AND day(t) <= 12 THEN 'low' ELSE 'high' END AS confidence FROM x""")
def f50(spark, d):
    form = F.element_at(F.array(*map(F.lit, ("dd/MM/yyyy", "MM/dd/yy", "yyyy-MM-dd", "d MMM yyyy", "MMMM d, yyyy"))),
        (F.col("event_id") % 5 + 1).cast("int"))
    raw = F.coalesce(*(F.when(form == p, F.date_format("ts", p)) for p in ("dd/MM/yyyy", "MM/dd/yy", "yyyy-MM-dd", "d MMM yyyy", "MMMM d, yyyy")))
    return table(spark, d, "events").select("event_id", X.normalized_date(raw, 2027).alias("date")).select("event_id", "date.iso", "date.ambiguous",
        "date.method", "date.confidence")


@query("f55_age_years", """
SELECT o_orderkey, date_diff('year', o_orderdate, TIMESTAMP '2024-02-28') - (strftime(TIMESTAMP '2024-02-28', '%m%d') < strftime(o_orderdate,
'%m%d'))::INT AS age FROM orders""")
def f55(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.age_years(F.col("o_orderdate"), F.lit("2024-02-28").cast("date")).alias("age"))


@query("f74_backoff", "SELECT l_orderkey, l_linenumber, least(60000.0, 1000 * pow(2.0, l_linenumber - 1)) AS wait_ms FROM lineitem")
def f74(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.backoff_ms(F.col("l_linenumber"), 1000, 60000).alias("wait_ms"))


@query("s10_page_manifest", """
SELECT conv_id AS doc_id, count(*) AS pages, sum(octet_length(encode(text))) AS bytes, sha256(string_agg(sha256(text), '' ORDER BY turn)) AS checksum
FROM conversations GROUP BY conv_id""")
def s10(spark, d):
    return page_manifest(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"),
        F.col("text").alias("content")))


@query("p19_validation_errors", """
WITH e AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 200000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status'
END], lambda x: x IS NOT NULL) AS errors FROM orders)
SELECT o_orderkey, array_to_string(errors, ',') AS errors FROM e WHERE len(errors) > 0""")
def p19(spark, d):
    o = table(spark, d, "orders")
    _, bad = split_valid(o, {"price": F.col("o_totalprice") > 200000, "status": ~F.col("o_orderstatus").isin("F", "O")})
    return bad.select("o_orderkey", F.array_join("errors", ",").alias("errors"))
