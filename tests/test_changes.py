import json
import os
import time

from larkspur.streaming import changes
from pyspark.sql import Row


def run(spark, folder, out, checkpoint):
    schema = "op string, id long, seq long, change_id string, image string, owner long"
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    with changes.keyed_state(spark):
        applied = changes.row_changes(changes.valid_changes(feed, owners=[1, 2]), None)
        query = applied.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
    assert query.awaitTermination(100) and query.exception() is None
    return spark.read.schema(changes.CHANGE).parquet(str(out))


def batch(folder, n, rows):
    folder.mkdir(exist_ok=True)
    names = ("op", "id", "seq", "change_id", "image", "owner")
    part = folder.parent / f"{n}.json"
    part.write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
    os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in the order of their times
    part.rename(folder / part.name)


def test_changes_are_applied_once_and_in_order_over_restarts(spark, tmp_path):
    batch(tmp_path / "in", 1, [("UPDATE", 1, 2, "b", "v2", 1), ("INSERT", 1, 1, "a", "v1", 1), ("INSERT", 2, 3, "c", "w1", 2), ("UPDATE", 3, 4, "d", "x1", 1)])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    batch(tmp_path / "in", 2, [("UPDATE", 1, 2, "b", "again", 1), ("DELETE", 2, 6, "e", None, 2), ("UPDATE", 2, 5, "f", "w2", 2), ("DELETE", 9, 7, "g", None, 1), ("INSERT", 3, 8, "d", "seen", 1)])
    batch(tmp_path / "in", 3, [("INSERT", 2, 4, "h", "late", 2), ("INSERT", 2, 9, "i", "w3", 2), ("UPSERT", 1, 10, "j", "bad", 1), ("UPDATE", None, 11, "k", "bad", 1), ("UPDATE", 1, 12, "l", None, 1), ("INSERT", 5, 13, "m", "other", 7)])
    applied = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    assert sorted(tuple(r) for r in applied.collect()) == [
        ("1", "INSERT", 1, None, "v1"), ("1", "UPDATE", 2, "v1", "v2"), ("2", "DELETE", 6, "w2", None), ("2", "INSERT", 3, None, "w1"),
        ("2", "INSERT", 9, None, "w3"), ("2", "UPDATE", 5, "w1", "w2"), ("3", "INSERT", 4, None, "x1"),
    ]
    assert sorted((r.id, r.image) for r in changes.current_rows(applied).collect()) == [("1", "v2"), ("2", "w3"), ("3", "x1")]


def test_state_of_seen_changes_expires(spark, tmp_path):
    batch(tmp_path / "in", 1, [("INSERT", 1, 1, "a", "v1", 1)])
    schema = "op string, id long, seq long, change_id string, image string, owner long"
    with changes.keyed_state(spark):
        applied = changes.row_changes(spark.readStream.schema(schema).json(str(tmp_path / "in")), 1)
        query = applied.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
    read = lambda: [] if not list((tmp_path / "out").glob("*.parquet")) else sorted(r.new for r in spark.read.schema(changes.CHANGE).parquet(str(tmp_path / "out")).collect())
    try:
        for n, want in ((1, ["v1"]), (2, ["v1", "v2"])):
            if n == 2:  # the same change_id once its state has expired, with a newer place in the order
                batch(tmp_path / "in", 2, [("UPDATE", 1, 2, "a", "v2", 1)])
            until = time.time() + 40
            while read() != want and time.time() < until and query.isActive:
                time.sleep(1)
            assert read() == want, query.exception()
    finally:
        query.stop()


def test_repeats_within_the_watermark_go(spark, tmp_path):
    spark.createDataFrame([(i % 3, f"2024-01-01 00:0{i}:00") for i in range(6)], "change_id int, at string").selectExpr("change_id", "CAST(at AS TIMESTAMP) AS at").write.parquet(str(tmp_path / "in"))
    feed = changes.once_within(spark.readStream.schema("change_id int, at timestamp").parquet(str(tmp_path / "in")), "at", "1 hour")
    query = feed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    assert sorted(r.change_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_a_batch_goes_to_the_state_a_few_times_however_many_changes_it_has():
    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "exists":
                    return bool(self.held)
                if name == "get":
                    return self.held[-1] if self is rows.image else iter(self.held)
                self.held += args[-1] if name == "appendList" else [args[-1]]
                return None

            return call

    class Handle:
        def __getattr__(self, name):
            return lambda *args: State()

    rows = changes._Rows(None)
    rows.init(Handle())
    told = lambda a, b: [Row(op="UPDATE", seq=i, change_id=f"c{i}", image=f"v{i}") for i in range(a, b)] * 2
    for a, b in ((0, 300), (200, 500)):  # 100 of the second batch were in the first
        calls.clear()
        made = list(rows.handleInputRows(("k",), iter(told(a, b)), None))
        assert [r.seq for r in made] == list(range(max(a, 300 * (a > 0)), b)) and len(calls) <= 5
