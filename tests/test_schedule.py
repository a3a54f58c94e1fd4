import pytest
from larkspur import registry
from larkspur.sources import schedule as S
from pyspark.sql import functions as F

from .test_larger_tables import agrees


def folder(tmp_path, **change):
    rows = {name: [{c: f"{c[:3]}1" for c in {*t.key, *(c for cs in t.parents.values() for c in cs)}}] for name, t in S.SCHEDULE.items()}
    for name, more in change.items():
        rows[name.replace("_", "-")] += more
    for name, found in rows.items():
        columns = sorted({*found[0], "note"})
        lines = [",".join(columns)] + [",".join(r.get(c) or "" for c in columns) for r in found]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_sixteen_tables_are_loaded_and_checked(spark, tmp_path):
    assert len(S.SCHEDULE) == 16
    tables = S.load(spark, folder(tmp_path), S.SCHEDULE)
    # relationships name their codes otherwise, but all have the first three letters of their column
    errors = {(r.table, r.problem, r.key) for r in S.key_errors(tables).collect()}
    assert errors == {("extemporaneous-prep-sfp-relationships", "no row in standard-formula-preparations", "sfp1|sch1"), ("extemporaneous-prep-sfp-relationships", "no row in extemporaneous-preparations", "ex_1|sch1")}
    row = S.with_parents(tables, "markup-bands").first()
    assert row["programs"]["program_code"] == "pro1" and row["programs"]["schedules"]["schedule_code"] == "sch1" and row["dispensing-rules"]["dispensing_rule_mnem"] == "dis1"


def test_keys_that_are_wrong(spark, tmp_path):
    fees = [{"program_code": "pro9", "schedule_code": "sch1"}, {"program_code": "pro9", "schedule_code": "sch1"}, {"schedule_code": "sch1"}]
    tables = S.load(spark, folder(tmp_path, fees=fees, programs=[{"program_code": "pro1", "schedule_code": "sch1", "note": "x"}]))
    errors = {(r.table, r.problem, r.key, r.n) for r in S.key_errors(tables).where("table IN ('fees', 'programs')").collect()}
    assert errors == {("fees", "repeated key", "pro9|sch1", 2), ("fees", "null key", "|sch1", 1), ("fees", "no row in programs", "pro9|sch1", 2), ("programs", "repeated key", "pro1|sch1", 2)}
    assert sorted((r.program_code or "", r.programs is not None) for r in S.with_parents(tables, "fees").collect()) == [("", False), ("pro1", True), ("pro9", False), ("pro9", False)]
    (tmp_path / "fees.csv").write_text("code\n1\n")
    with pytest.raises(ValueError, match="fees has no program_code, schedule_code"):
        S.load(spark, str(tmp_path))


def test_a_task_of_a_key_check_holds_no_more_keys_than_rows_are_dealt_to_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 500, raising=False)
    twice = "SELECT * FROM {lineitem} UNION ALL SELECT * FROM {lineitem}"
    assert len(agrees(spark, tmp_path, "s03_key_errors", lineitem=twice, **{t: f"SELECT * FROM {{{t}}}" for t in ("nation", "customer", "part", "orders")})) > 4000
    found = registry.QUERIES["s03_key_errors"](spark, str(tmp_path)).where("problem = 'repeated key'")
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 500


def test_a_key_of_many_rows_is_counted_before_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 500, raising=False)
    spec = {"a": S.Table(("k", "l")), "b": S.Table(("id",), {"a": ("x", "y")})}
    ids = spark.range(20_000)
    a = spark.createDataFrame([(1, 0), (1, None), (None, None), (2, 0), (2, 0)], "k int, l long")
    b = ids.selectExpr("IF(id = 7, 6, IF(id = 8, NULL, id)) AS id", "IF(id % 10 > 0, 3, CAST(id AS INT) % 4000) AS x", "IF(id % 9000 = 10, NULL, 0) AS y")
    errors = {(r.table, r.problem, r.key): r.n for r in S.key_errors({"a": a, "b": b}, spec).collect()}
    want = {("a", "null key", "1|"): 1, ("a", "null key", "|"): 1, ("a", "repeated key", "2|0"): 2, ("b", "repeated key", "6"): 2, ("b", "null key", ""): 1}
    want |= {("b", "no row in a", "3|0"): 18_000} | {("b", "no row in a", f"{x}|0"): 5 - (x in (10, 1010, 2010)) for x in range(0, 4000, 10)}
    assert {k: errors.get(k) for k in want} == want and len(errors) == len(want)
    found = S.key_errors({"a": a, "b": b.where("x = 3").withColumn("id", F.lit(1))}, spec)
    assert 0 < dealt_rows(found) < 100 and found.where("table = 'b'").count() == 2


def test_references_of_another_type_are_told_as_they_stand(spark):
    spec = {"a": S.Table(("k",)), "b": S.Table(("id",), {"a": ("x",)})}
    a, b = spark.range(1, 3).selectExpr("id AS k"), spark.createDataFrame([(1, "1"), (2, "01"), (3, "7"), (4, "07"), (5, "07"), (6, None)], "id int, x string")
    assert sorted(map(tuple, S.key_errors({"a": a, "b": b}, spec).collect())) == [("b", "no row in a", "07", 2), ("b", "no row in a", "7", 1)]


def dealt_rows(df):
    """The rows that all shuffles of a query wrote."""
    df.collect()
    waiting, rows = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        at = waiting.pop()
        name = at.nodeName()
        if name == "AdaptiveSparkPlan":
            waiting.append(at.executedPlan())
        elif "QueryStage" in name:
            waiting.append(at.plan())
        elif name == "Exchange":
            rows += at.metrics().apply("shuffleRecordsWritten").value()
        waiting += [at.children().apply(i) for i in range(at.children().size())]
    return rows
