import pytest
from larkspur.operators import access, aggregates as A
from larkspur.operators import flags, model_output, processing, queues, records, retrieval, scan, timeline
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "b", 2.0, 10), (1, "a", None, 20), (1, "a", 1.0, None), (2, None, 3.0, 30), (None, "c", 0.0, 40)]
    return spark.createDataFrame(data, "k int, s string, v double, t int").cache()


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counts_and_lists_with_nulls(rows):
    assert got(A.conditional_counts(rows, ["k"], {"big": F.col("v") > 1})) == [(1, 1, 3), (2, 1, 1), (None, 0, 1)]
    assert got(A.distinct_where(rows, ["k"], {"n": (F.col("s"), F.col("t") > 5)})) == [(1, 2), (2, 0), (None, 1)]
    assert got(A.distinct_list(rows, ["k"], "s", "l")) == [(1, ["a", "b"]), (2, []), (None, ["c"])]
    assert got(A.distinct_list(rows, ["k"], "s", "l", F.col("v") > 5)) == [(1, []), (2, []), (None, [])]
    assert got(A.ordered_list(rows, ["k"], F.col("s"), ["t", "v"], "l")) == [(1, ["a", "b", "a"]), (2, [None]), (None, ["c"])]
    assert got(A.json_list(rows, ["k"], ["s"], ["t"], "j", F.col("k") == 1)) == [(1, '[{"s":"a"},{"s":"b"},{"s":"a"}]'), (2, "[]"), (None, "[]")]
    assert got(A.distinct_concat(rows, ["k"], "s", "j")) == [(1, "a, b"), (2, ""), (None, "c")]
    assert got(A.any_true(rows, ["k"], F.col("v") > 1, "x")) == [(1, True), (2, True), (None, False)]
    assert got(A.histogram(rows, "s")) == [("a", 2), ("b", 1), ("c", 1), (None, 1)]


def test_measures_over_all_rows(rows):
    assert got(A.overall(rows, {"n": F.count("*")}, F.col("n") > 9)) == [] and got(A.overall(rows, {"n": F.count("*")})) == [(5,)]
    assert got(A.dashboard({"a": (rows, F.count("*")), "b": (rows.limit(0), F.max("v"))})) == [(5, None)]
    assert got(A.volume_stats({"a": (rows, F.col("v") > 1), "b": (rows.limit(0), F.col("v") > 1)})) == [("a", 5, 2), ("b", 0, 0)]
    assert got(A.quality_assessment(rows.limit(0), "v", "t", F.col("v") > 0)) == [(None, None)]
    assert got(queues.batch_sizes(rows.limit(0), "t")) == [(0, 0.0, 0, 0, 0)]


def test_groups_and_joins(spark, rows):
    owners = spark.createDataFrame([(1,), (9,)], "k int")
    assert got(A.mean_or(owners, rows, "k", "v", 0.85, "m")) == [(1, 1.5), (9, 0.85)]
    assert got(A.latest_of_group(rows, ["k"], "s", ["t", "v"], "last")) == [(1, "a"), (2, None), (None, "c")]
    assert got(A.keep_first(rows, ["k"], ["t", "v"]).select("k", "t")) == [(1, None), (2, 30), (None, 40)]
    assert got(A.frequent(rows, ["k"], 2)) == [(1, 3)]
    assert got(A.with_match(owners, rows, "k")) == [(1,)] and got(A.without_recent(owners, rows, "k", "t", F.lit(15))) == [(9,)]
    assert got(A.distinct_branches(owners, owners)) == [(1,), (1,), (9,), (9,)]
    assert got(A.either_side(spark.createDataFrame([(1, 2), (2, 1)], "a int, b int"), "a", "b", [1], [2])) == [(1, 2, "child"), (1, 2, "parent")]
    assert [r.n for r in A.numbered(rows, ["k"], ["t", "v"]).orderBy("k", "n").collect()] == [1, 1, 2, 3, 1]
    assert got(scan.gaps(spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 7)], "k int, v int"), ["k"], F.col("v"))) == [(1, 4)]
    assert got(A.date_spine(spark, "2024-02-28", "2024-03-01"))[1][0].day == 29


def test_values_below_limits(rows):
    status = A.bucketed(F.col("v"), [(1, "low"), (2, "mid")], "high")
    assert [r.x for r in rows.select(status.alias("x")).collect()] == ["high", "high", "mid", "high", "low"]


def test_empty_tables(spark, rows):
    none = rows.limit(0)
    for df in (A.conditional_counts(none, ["k"], {"x": F.col("v") > 1}), A.keep_first(none, ["k"], ["t"]), A.frequent(none, ["k"], 1), A.with_total(none, ["k"]), A.histogram(none, "s"), scan.gaps(none, ["k"], F.col("t"))):
        assert df.count() == 0
    assert retrieval.retrieval_accuracy(spark.createDataFrame([], "query int, expected array<string>"), spark.createDataFrame([], "query int, code_value string, rank int")).first().known == 0
    assert flags.flag_statistics(spark.createDataFrame([], "status string, severity string, created_at timestamp_ntz, resolved_at timestamp_ntz")).first().resolution_rate == 0.0
    assert records.normalisation_stats(spark.createDataFrame([], "status string")).first().rate == 0.0


def test_visits_that_go_on(spark):
    columns = "visit_id int, kind string, last_page int, told_status string, told_temp_id string, told_next string, end_date string, timeframe string"
    rows = [(1, "Surgery", 50, None, None, None, "2024-01-01", "completed"), (2, "visit", 20, None, "t2", "", "2024-01-01", "completed"), (3, "visit", 20, None, None, "report", None, "completed"), (4, "visit", None, None, None, None, None, None), (5, "emergency", 20, None, None, None, None, "ongoing")]
    df = spark.createDataFrame(rows, columns)
    seen = {r.visit_id: (r.status, r.temp_id, r.expected_continuation) for r in processing.continued_visits(df, 1, 2, 50).collect()}
    assert seen == {1: ("continuing", "encounter_temp_chunk1_1", "post_operative_notes"), 2: ("complete", None, None), 3: ("continuing", "encounter_temp_chunk1_3", "report"), 4: ("complete", None, None), 5: ("continuing", "encounter_temp_chunk1_5", "disposition_or_admission")}
    assert {r.status for r in processing.continued_visits(df, 2, 2, 50).collect()} == {"complete"}


def test_uploads_with_and_without_keys(spark):
    asked = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3), (4, None, 3), (5, "b", 1)], "request_id int, idempotency_key string, at int")
    known = spark.createDataFrame([("b", 99)], "idempotency_key string, file_id int")
    assert got(queues.uploads(asked, known)) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 99, False)]


def test_alerts_are_not_raised_twice(spark):
    at = F.lit("2024-06-01").cast("timestamp_ntz")
    meds = spark.createDataFrame([(p, "active", None) for p in (1, 2) for _ in range(10)], "patient_id int, status string, archived boolean")
    people = spark.createDataFrame([(1, "1970-01-01"), (2, "1990-01-01"), (3, "1948-07-01")], "patient_id int, birth_date string").withColumn("birth_date", F.col("birth_date").cast("date"))
    labs = spark.createDataFrame([(1, 7, "critical_low", None, "2024-05-20"), (1, 8, "high", None, "2024-01-20"), (2, 9, "high", None, "2024-05-30")], "patient_id int, lab_id int, flag string, archived boolean, test_date string").withColumn("test_date", F.col("test_date").cast("timestamp_ntz"))
    items = spark.createDataFrame([(2, "polypharmacy_check", None, "pending", "2024-05-20"), (1, "screening_due", "mammography", "assigned", "2024-05-01"), (1, "screening_due", "colorectal", "done", "2024-05-01"), (2, "lab_abnormal", "9", "pending", "2020-01-01")], "patient_id int, action_type string, subject string, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    found = got(timeline.alerts(meds, people, labs, items, at).select("patient_id", "action_type", "subject", "priority", "risk"))
    assert found == sorted([(1, "polypharmacy_check", None, "moderate", "high"), (1, "screening_due", "colorectal", "routine", None), (3, "screening_due", "colorectal", "routine", None), (1, "lab_abnormal", "7", "critical", None)], key=str)


def test_levels_scores_and_costs(spark):
    one = spark.range(1)
    assert [one.select(access.implies(F.lit(x), "read_write").alias("v")).first().v for x in ("owner", "read_write", "read_only")] == [True, True, False]
    assert one.select(model_output.output_quality(F.lit(1), F.lit(2), F.lit(0.8), F.lit(40.0)).alias("v")).first().v == pytest.approx(100 - 25 - 10 - 2 - 5)
    assert one.select(model_output.output_quality(F.lit(9), F.lit(0), F.lit(1.0), F.lit(90.0)).alias("v")).first().v == 0.0
