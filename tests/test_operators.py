import os
import random

import duckdb
import pytest
from larkspur import functions as X
from larkspur import plans, registry, sources, streaming
from larkspur.operators import queues, reconcile, retrieval, scan
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
plans.load()


def told(v):
    if isinstance(v, float):
        return round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_its_oracle(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted(repr(tuple(told(r[names.index(c)]) for c in sorted(names))) for r in found.fetchall())
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(told(r[c]) for c in sorted(names))) for r in df.collect()) == want


def test_merged_ranges(spark):
    rows = spark.createDataFrame([(1, 5, 7), (1, 1, 3), (1, 4, 4), (1, 10, 12)], "k int, a int, b int")
    assert sorted(map(tuple, scan.merged_ranges(rows, "k", "a", "b").collect())) == [(1, 1, 7), (1, 10, 12)]


def test_window_limit(spark):
    rows = spark.createDataFrame([(1, float(t), i) for i, t in enumerate([0, 10, 20, 30, 60, 61])], "k long, s double, i long")
    got = queues.window_limit(rows, ["k"], "s", "i", 3, 60).orderBy("i").collect()
    assert [r.allowed for r in got] == [True, True, True, False, False, True]


def test_a_hundred_events_a_minute(spark):
    rows = spark.createDataFrame([(k, 0.1 * i, i) for k in (1, 2) for i in range(150)] + [(1, 61.0, 999)], "k long, s double, i long")
    got = queues.window_limit(rows, ["k"], "s", "i").collect()
    assert sum(r.allowed for r in got if r.k == 1) == 101 and sum(r.allowed for r in got if r.k == 2) == 100
    assert all(r.allowed == (r.i < 100 or r.i == 999) for r in got)


def test_limit_on_tokens(spark):
    rows = spark.createDataFrame([(1, float(i), i, n) for i, n in enumerate([50, 40, 20, 10, None])], "k long, s double, i long, n int")
    got = queues.window_limit(rows, ["k"], "s", "i", None, 60, "n", 100).orderBy("i").collect()
    assert [r.allowed for r in got] == [True, True, False, True, True]


def test_streamed_limit_agrees_with_the_batch_form(spark, tmp_path):
    rows = [(k, float(t)) for k in (1, 2) for t in range(0, 200, 7 * k)]
    for i in range(3):
        spark.createDataFrame([r for r in rows if i * 70 <= r[1] < (i + 1) * 70], "k long, s double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("i", F.col("s"))
    want = {(r.k, r.s, r.allowed) for r in queues.window_limit(batch, ["k"], "s", "i", 4, 60).collect()}
    files = spark.readStream.schema("k long, s double").parquet(str(tmp_path / "in"))
    q = streaming.limited(files, "k", "s", 4, 60, expire=False).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    assert {tuple(r) for r in spark.table("limited").collect()} == want


def test_a_feed_that_upserts_merges_its_batches(spark, tmp_path):
    schema = "user_id long, n int, ts timestamp, op string"
    at = "2024-01-0{} 00:00:00"
    for i, rows in enumerate([[(1, 1, at.format(1), "INSERT"), (2, 1, at.format(1), "INSERT"), (9, 1, at.format(1), "INSERT")], [(1, 5, at.format(3), "UPDATE"), (1, 4, at.format(2), "UPDATE"), (3, 1, at.format(1), "INSERT"), (2, 1, at.format(3), "DELETE")]]):
        df = spark.createDataFrame(rows, "user_id long, n int, ts string, op string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = streaming.change_feed(spark, str(tmp_path / "in"), schema, [1, 2, 3])
        feed.writeStream.foreachBatch(streaming.upserts_to(str(tmp_path / "out"), "user_id", "ts")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
        got = {(r.user_id, r.n) for r in streaming.latest(spark, str(tmp_path / "out")).collect()}
        assert got == ({(1, 1), (2, 1)} if i == 0 else {(1, 5), (3, 1)})


def test_windowed_counts(spark, tmp_path):
    rows = [("a", "2024-01-01 01:00:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-01 03:00:00"), ("a", "2024-01-02 05:00:00"), ("a", "2024-01-05 00:00:00")]
    spark.createDataFrame(rows, "event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = streaming.windowed_counts(spark.readStream.schema("event_type string, ts timestamp").parquet(str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    got = {(str(r.window.start)[:10], r.event_type, r.n) for r in spark.table("counts").collect()}
    assert got == {("2024-01-01", "a", 2), ("2024-01-01", "b", 1), ("2024-01-02", "a", 1), ("2024-01-05", "a", 1)}


@pytest.mark.parametrize(("scores", "kept"), [
    ([0.90, 0.86, 0.80, 0.78, 0.77, 0.76, 0.755, 0.75, 0.75, 0.75, 0.75, 0.62], 11), ([0.90, 0.70, 0.65], 3), ([0.5], 0)])
def test_selected_candidates(spark, scores, kept):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "q int, p int, s double")
    got = retrieval.selected_candidates(rows, "q", "p", "s").orderBy("rank").collect()
    assert sorted(r.p for r in got) == list(range(kept)) and [r.s for r in got] == sorted((r.s for r in got), reverse=True)


def plain_batches(first, last, splits):
    """The batches of a visit, step by step."""
    n = last - first + 1
    if n <= 10 or (not splits and n <= 50):
        return [(first, last)]
    cuts, at = [], first
    if not splits:
        cuts = list(range(first + 50, last, 50))
    while splits and at + 10 <= last and len(cuts) <= 100:
        near = [s for s in splits if at + 3 <= s <= min(at + 12, last)]
        at = min(near, key=lambda s: abs(s - at - 10)) if near else at + 10
        cuts.append(at)
    return list(zip([first, *cuts], [*(c - 1 for c in cuts), last], strict=True))


def test_planned_batches(spark):
    r = random.Random(1)
    cases = [(1, 25, [9, 12, 20]), (1, 120, []), (1, 30, []), (1, 40, [5]), (1, 40, None), (3, 12, [5]), (1, 51, []), (1, 101, []), (1, 20, [13, 7])]
    cases += [(a, a + r.randrange(200), r.sample(range(200), r.randrange(12))) for a in range(1, 40)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "v int, a int, b int, s array<int>")
    got = {}
    for row in reconcile.planned_batches(df, "v", "a", "b", "s").orderBy("v", "index").collect():
        got.setdefault(row.v, []).append((row.start, row.end))
    assert got == {i: plain_batches(*c) for i, c in enumerate(cases)}
    assert got[3] == [(1, 4), (5, 14), (15, 24), (25, 34), (35, 40)] and got[0] == [(1, 11), (12, 19), (20, 25)]


@pytest.mark.parametrize(("raw", "iso", "method"), [
    ("03/04/2024", "2024-04-03", "ambiguous_default"), ("25/12/23", "2023-12-25", "dd_mm"), ("12/25/1985", "1985-12-25", "mm_dd"), ("01/02/49", "2049-02-01", "ambiguous_default"),
    ("01/02/50", "1950-02-01", "ambiguous_default"), ("31/02/2020", None, "unparseable"), ("2024-01-05", "2024-01-05", "iso"), ("5 Jan 2024", "2024-01-05", "text"), ("", None, "empty"), (None, None, "empty")])
def test_dates(spark, raw, iso, method):
    r = spark.createDataFrame([(raw,)], "r string").select(X.normalized_date(F.col("r"), 2027).alias("d")).first().d
    assert (r.iso, r.method) == (iso, method)


def test_date_of_birth_must_be_sane(spark):
    r = spark.createDataFrame([("01/02/49",)], "r string").select(X.normalized_date(F.col("r"), 2027, birth=True).alias("d")).first().d
    assert (r.iso, r.method, r.error) == (None, "failed_sanity_check", "year_out_of_range")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,null\n"a,b",2\n')
    assert [tuple(r) for r in sources.csv_strings(spark, str(tmp_path / "a.csv"), ["x", "y"], "null").collect()] == [("1", None), ("a,b", "2")]
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert sources.json_array(spark, str(tmp_path / "a.json"), "x int").count() == 2
    (tmp_path / "a.xml").write_text("<l><Data><x>1</x></Data><Data><x>2</x></Data></l>")
    assert sources.xml_items(spark, str(tmp_path / "a.xml"), "Data", "x int").count() == 2


def test_page_store(spark, tmp_path):
    path = str(tmp_path / "pages")
    assert sources.load_pages(spark, path, [1]) is None
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c"), (3, 1, "d")], "doc_id int, page int, content string")
    sources.write_pages(pages, path, 2)
    sources.write_pages(pages.where("doc_id = 1 AND page = 1").withColumn("content", F.lit("new")), path, 2)
    assert sorted(map(tuple, spark.read.parquet(path).select("doc_id", "page", "content").collect())) == [(1, 1, "new"), (2, 1, "c"), (3, 1, "d")]
    assert {tuple(r) for r in sources.load_pages(spark, path, [1, 3, 9], 2).collect()} == {(1, 1, "new"), (3, 1, "d")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    errors = {"v": F.col("v").isNull()}
    assert sources.insert_counted(rows, str(tmp_path / "t"), errors, dry_run=True) == {"inserted": 2, "failed": 1} and not sources.exists(spark, str(tmp_path / "t"))
    assert sources.insert_counted(rows, str(tmp_path / "t"), errors) == {"inserted": 2, "failed": 1} and spark.read.parquet(str(tmp_path / "t")).count() == 2
    sources.append_events(rows, str(tmp_path / "good"), str(tmp_path / "bad"), errors, F.concat(F.lit("c"), F.col("id").cast("string")))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [(2, None, "c2", ["v"])] and spark.read.parquet(str(tmp_path / "good")).count() == 2
    sources.write_json(rows, str(tmp_path / "j"))
    assert spark.read.schema("id int, v string").json(str(tmp_path / "j")).count() == 3
    got = sources.scan(rows, ["id"], {"v": None}).collect() + sources.scan(rows, ["id"], among={"v": ["a", "c"]}, order=[F.desc("id")], limit=1).collect()
    assert [r.id for r in got] == [2, 3]


def test_lexical_match_wants_a_variant(spark):
    with pytest.raises(ValueError, match="no variant"):
        retrieval.lexical_matches(spark.range(1), "id", [" "], "id")
