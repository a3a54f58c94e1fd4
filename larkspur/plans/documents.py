"""Queries of histories, clinical documents and cached embeddings; each oracle says the same in its own SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import embedding_cache, history
from ..registry import query
from ..shared import shared_dir
from ..sources import clinical, schedule, table


def kept_events(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return history.write_history(rows, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}", "user_id", "ts", "event_id")


@query("l05_n04_history_page", """
SELECT event_id, ts, count(*) OVER () AS total FROM events WHERE user_id = 3 ORDER BY ts DESC NULLS LAST, event_id LIMIT 25 OFFSET 30""")
def l05_history(spark, d):
    return history.page_by_offset(kept_events(spark, d), 3, 25, 30).select("event_id", "ts", "total")


@query("l06_w11_history_page", """
SELECT event_id, ts, (SELECT count(*) FROM events WHERE user_id = 5 AND (ts < TIMESTAMP '2024-01-20' OR ts IS NULL)) > 25 AS has_more FROM events
WHERE user_id = 5 AND (ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id > 5) OR ts IS NULL) ORDER BY ts DESC NULLS LAST, event_id LIMIT 25""")
def l06_history(spark, d):
    return history.page_after(kept_events(spark, d), 5, ("2024-01-20", 5), 25).select("event_id", "ts", "has_more")


@query("s05_clinical_tables", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag)::INTEGER AS row FROM lineitem)
SELECT l_orderkey AS doc, '1.1' AS path, row, c AS cell, ['Part', 'Flag & more', 'Kind'][c] AS header,
  CASE c WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN l_returnflag ELSE 'x < ' || l_linenumber END AS value FROM n, (VALUES (1), (2), (3)) t(c)""")
def s05(spark, d):
    """Each order as a clinical document: a section of a section has the table of its lines."""
    cell = lambda v: F.concat(F.lit("<td>"), v, F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), cell(F.col("l_partkey").cast("string")), cell(F.concat(F.lit("<content>"), F.col("l_returnflag"), F.lit(" </content>"))),
        cell(F.concat(F.lit("x &lt;  "), F.col("l_linenumber").cast("string"))), F.lit("</tr>"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("tr")))), lambda r: r["tr"]), "\n")
    head = "<thead><tr><th>Part</th><th>Flag &amp; more</th><th>Kind</th></tr></thead>"
    open_ = '<d:ClinicalDocument xmlns:d="urn:x"><component><structuredBody><component><section><title>Order</title><component><section><text><table>' + head + "<tbody>"
    close = "</tbody></table></text></section></component></section></component></structuredBody></component></d:ClinicalDocument>"
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.concat(F.lit(open_), ordered, F.lit(close)).alias("xml"))
    cells = clinical.tables(clinical.sections(docs, "doc", "xml"), "doc")
    return cells.select("doc", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "row", "cell", "header", "value")


@query("v12_fetch_list", r"""
WITH t AS (SELECT l_orderkey, l_linenumber, 'm' || l_orderkey % 2 AS model, p_name AS text FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT DISTINCT 'm' || o_orderkey % 2 AS model, p_name AS text FROM orders JOIN part ON p_partkey = o_orderkey % 300 WHERE o_orderdate > TIMESTAMP '1998-05-01' - INTERVAL 90 DAY AND o_orderdate <= TIMESTAMP '1998-05-01'),
f AS (SELECT t.model, t.text, bool_or(c.text IS NOT NULL) AS hit, count(*) AS n FROM t LEFT JOIN c ON c.model = t.model AND c.text = t.text GROUP BY t.model, t.text)
SELECT sha256(model || chr(0) || lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS cache_key, model, text FROM f WHERE NOT hit""")
def v12(spark, d):
    """Names of parts that lines ask for, under two models; those of recent orders are in the cache."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"))
    model = lambda k: F.concat(F.lit("m"), (F.col(k) % 2).cast("string"))
    texts = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("text", model("l_orderkey").alias("model"))
    held = table(spark, d, "orders").join(part, F.col("o_orderkey") % 300 == F.col("p_partkey"))
    cache = held.select(embedding_cache.cache_key(F.upper("text"), model("o_orderkey")).alias("cache_key"), F.array(F.lit(1.0)).alias("embedding"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    as_of = F.lit("1998-05-01").cast("timestamp_ntz")
    return embedding_cache.to_fetch(embedding_cache.looked_up(texts, cache, as_of))


#: The order tables as a set: lines refer to orders and parts, orders to customers, customers to nations.
ORDERS = {
    "nation": schedule.Table(("n_nationkey",)),
    "customer": schedule.Table(("c_custkey",), {"nation": ("c_nationkey",)}),
    "part": schedule.Table(("p_partkey",)),
    "orders": schedule.Table(("o_orderkey",), {"customer": ("o_custkey",)}),
    "lineitem": schedule.Table(("l_orderkey", "l_linenumber"), {"orders": ("l_orderkey",), "part": ("l_partkey",)}),
}
KEPT = {"customer": "c_custkey % 4 <> 1", "part": "p_partkey % 50 <> 0"}


def order_tables(spark, d):
    return {n: table(spark, d, n).where(KEPT.get(n, "true")) for n in ORDERS}


@query("s03_key_errors", """
SELECT 'lineitem' AS "table", 'repeated key' AS problem, l_orderkey || '|' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'lineitem', 'no row in part', l_partkey::VARCHAR, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0) GROUP BY l_partkey
UNION ALL SELECT 'lineitem', 'no row in orders', l_orderkey::VARCHAR, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT 'orders', 'no row in customer', o_custkey::VARCHAR, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 1) GROUP BY o_custkey""")
def s03_errors(spark, d):
    return schedule.key_errors(order_tables(spark, d), ORDERS)


@query("s03_with_parents", """
SELECT l_orderkey, l_linenumber, p_name, c_name, n_name, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 50 <> 0 LEFT JOIN orders ON o_orderkey = l_orderkey
LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 1 LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def s03_parents(spark, d):
    rows = schedule.with_parents(order_tables(spark, d), "lineitem", ORDERS)
    wide = rows.select("l_orderkey", "l_linenumber", "part.p_name", "orders.customer.c_name", "orders.customer.nation.n_name")
    return wide.groupBy(wide.columns).agg(F.count("*").alias("n"))
