"""Queries over small tables with what larger ones have: keys beyond a million, pages of many words, owners of many profiles."""

import duckdb
import pytest
from larkspur import plans, registry
from larkspur.operators import access, layout
from pyspark.sql import functions as F

from .test_operators import SF, told

plans.load()


def agrees(spark, folder, name, **tables):
    """Whether a query over ``tables`` (each by its SELECT over the small tables) agrees with its oracle; the rows that it has."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql.format(**{t: f"'{SF}/{t}.parquet'"})}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted(repr(tuple(told(r[names.index(c)]) for c in sorted(names))) for r in found.fetchall())
    got = sorted(repr(tuple(told(r[c]) for c in sorted(names))) for r in registry.QUERIES[name](spark, str(folder)).collect())
    assert got == want and got
    return got


@pytest.mark.parametrize("wide", [1, 1_000_003])
def test_batches_keep_their_order_whatever_the_keys(spark, tmp_path, wide):
    agrees(spark, tmp_path, "u06_w09_joined_batches", lineitem=f"SELECT * REPLACE (l_partkey * {wide} AS l_partkey) FROM {{lineitem}}")


def test_height_beside_a_place_of_a_full_page(spark, tmp_path):
    """Words that share y and text meet as one: 2,000 words and as many places on one page give far fewer pairs than 4,000,000."""
    w = spark.range(2000).selectExpr("1 AS page", "id AS seq", "concat('w', id % 5) AS text", "CAST(id % 40 * 7 AS INT) AS y", "CAST(8 + id % 5 AS INT) AS height")
    a = spark.range(2000).selectExpr("id AS ask_id", "1 AS page", "concat('see W', id % 5) AS marker", "CAST(id % 40 * 7 + id % 13 AS INT) AS y")
    a = a.unionByName(spark.createDataFrame([(5000, 1, None, 7), (5001, 1, "w1", None), (5002, None, "w1", 7), (5003, 2, "w1", 7)], "ask_id long, page int, marker string, y int"))
    words, want = [tuple(r) for r in w.collect()], {}
    for r in a.collect():
        near = [(0 if abs(y - r.y) <= 5 and text in (r.marker or "").lower() else 1, seq, height) for page, seq, text, y, height in words if r.y is not None and page == r.page and abs(y - r.y) <= 10]
        want[r.ask_id] = min(near)[2] if near else None
    found = layout.text_height(w, a)
    assert {r.ask_id: r.height for r in found.collect()} == want and want[5000] is not None and want[5001] is None
    joins = [int(n) for n in rows_of_joins(found)]
    assert max(joins) < 100_000


def rows_of_joins(df):
    """The rows that each join of a query that has run gave."""
    nodes, plan = [], df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    waiting = [plan]
    while waiting:
        at = waiting.pop()
        name = at.nodeName()
        if "QueryStage" in name:
            waiting.append(at.plan())
        if "Join" in name:
            nodes.append(at.metrics().apply("numOutputRows").value())
        waiting += [at.children().apply(i) for i in range(at.children().size())]
    return nodes


def test_no_row_of_a_marker_search_holds_a_page(spark, tmp_path, monkeypatch):
    sizes, keep = [], layout.written

    def seen(df):
        table = keep(df)
        sizes.append(table.agg(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] or 0)
        return table

    monkeypatch.setattr(layout, "written", seen)
    part = "SELECT * REPLACE (1 AS p_size) FROM {part}"
    agrees(spark, tmp_path, "v11_marker_matches", part=part)
    agrees(spark, tmp_path, "v11_fuzzy_markers", part=part)
    words = spark.range(600).selectExpr("1 AS page", "id AS seq", "concat('word', id % 9) AS text", "CAST(id * 5 AS INT) AS y", "12 AS height", "0.5 AS confidence")
    markers = spark.createDataFrame([(1, "word3", "word4 word4"), (2, "word3 word4 ward5", "word0 none"), (3, "word8 word0", None)], "marker_id int, marker string, context string")
    markers = markers.selectExpr("*", "1 AS page", "IF(marker_id = 1, 'bottom', NULL) AS region", "3300 AS page_height")
    got = {r.marker_id: (r.text, r.y, r.exact) for r in layout.marker_matches(words, markers).collect()}
    assert got == {1: ("word3", 2490.0, True), 2: ("word3 word4 word5", 15.0, False), 3: ("word8 word0", 40.0, True)}
    assert max(sizes) < 1500


def test_costs_need_no_shuffle_by_model(spark, tmp_path):
    agrees(spark, tmp_path, "f76_a40_costs", lineitem="SELECT * FROM {lineitem}")
    plan = registry.QUERIES["f76_a40_costs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("block", [12, 2048])
def test_pairs_of_one_owner_are_dealt_to_all_tasks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(access, "BLOCK", block, raising=False)
    agrees(spark, tmp_path, "r07_allowed_patients", customer="SELECT * REPLACE (CASE WHEN c_custkey % 10 > 7 THEN c_nationkey WHEN c_custkey % 100 > 2 THEN 3 END AS c_nationkey) FROM {customer}")
    if block == 12:
        rows = registry.QUERIES["r07_allowed_patients"](spark, str(tmp_path)).where("scope = 'emergency'")
        tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) == 4 and max(tasks) < 0.5 * sum(tasks)
