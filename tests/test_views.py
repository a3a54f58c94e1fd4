import random

from pyspark.sql import functions as F

from larkspur.operators import views

VIEW = views.View(["k", "t"], sums={"total": "v"}, counts={"told": "v"}, means={"mean": "v"}, least={"low": "v"}, greatest={"high": "v", "last": "d"})
SCHEMA = "id long, k int, t string, v int, d string"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_refreshes_agree_round_after_round(spark):
    rng = random.Random(1)
    new = lambda i: (i, rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(20)]), rng.choice("xyz"))
    base = [new(i) for i in range(200)]
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    stored = views.full_refresh(VIEW, make(base))
    for n in range(3):
        out = rng.sample(base, 60)
        fresh = [new(1000 * (n + 1) + i) for i in range(30)] + [(5000 + n, 7, "only", 3, "q")]
        base = [r for r in base if r not in out] + fresh
        stored = spark.createDataFrame(views.incremental_refresh(VIEW, stored, make(base), make(fresh), make(out)).collect(), stored.schema)
        assert rows_of(stored) == rows_of(views.full_refresh(VIEW, make(base)))
    gone = views.incremental_refresh(VIEW, stored, make([]), make([]), make(base))
    assert gone.count() == 0
    assert {r.k: (r.total, r.mean) for r in views.shown(VIEW, views.full_refresh(VIEW, make([(1, 1, "a", None, "x"), (2, 2, "a", 4, "x")]))).collect()} == {1: (None, None), 2: (4, 4.0)}


def test_only_groups_that_lost_an_end_are_read_again(spark):
    base = spark.range(1000).select("id", (F.col("id") % 10).cast("int").alias("k"), F.lit("a").alias("t"), F.col("id").cast("int").alias("v"), F.lit("x").alias("d"))
    view = views.View(["k", "t"], least={"low": "v"})
    out = base.where("id IN (3, 555)")  # 3 is the least of its group, 555 is not
    seen = spark.sparkContext.accumulator(0)
    after = base.where("id NOT IN (3, 555)")
    got = {r.k: r.low for r in views.incremental_refresh(view, views.full_refresh(view, base), after, base.limit(0), out).collect()}
    assert got == {k: k if k != 3 else 13 for k in range(10)} and not seen.value
