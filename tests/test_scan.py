import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import layout, scan


def merged(rows):
    out = {}
    for k, a, b in sorted((r for r in rows if None not in r[1:]), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:])):
        runs = out.setdefault(k, [])
        if runs and a <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return sorted((str(k), *r) for k, runs in out.items() for r in runs)


@pytest.mark.parametrize("parts", [None, 1, 7, 50])
def test_ranges_of_a_key_that_holds_most_rows(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), a := rng.randrange(3000), a + rng.choice([0, 1, 3, 60])) for _ in range(700)]
    rows += [(1, 0, 2500), (4, 5, None), (4, None, 5), (2, 7, 7), (2, 7, 7)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    assert sorted((str(r.k), r.a, r.b) for r in scan.merged_ranges(df, "k", "a", "b", parts).collect()) == merged(rows)
    v = [(k, a) for k, a, _ in rows]
    got = sorted((str(r.k), r.a) for r in scan.gaps(df.select("k", "a"), ["k"], F.col("a"), parts).collect())
    want = []
    for k in {k for k, _ in v}:
        s = sorted(a for x, a in v if x == k and a is not None)
        want += [(str(k), y) for x, y in zip(s, s[1:], strict=False) if y != x + 1]
    assert got == sorted(want)


def test_one_key_lies_in_many_ranges_and_little_is_carried(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + F.col("id") % 5).alias("b"))
    ranged = scan.spread(df, ["k"], ["a"], 16)
    sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4000
    assert scan.carried(ranged, ["k"], "b").count() == 15
    assert scan.merged_ranges(df.limit(0), "k", "a", "b").count() == 0


def test_zones_meet_by_bins(spark):
    rng = random.Random(5)
    zones = [(i, rng.choice([1, 1, 1, 2]), a := rng.choice([rng.randrange(3000), rng.uniform(0, 1)]), a + rng.choice([0, 0.25, 1, 40, 900, -5]), rng.choice(["lab_results", "vitals"])) for i in range(150)]
    zones += [(900 + i, 1, 10.0, 20.0, "vitals") for i in range(60)]  # copies but for the id
    found = [(i, rng.choice([1, 1, 1, 2, 3]), rng.choice([rng.randrange(3000), rng.uniform(0, 1), None, zones[i % 150][2]]), rng.choice(["lab", "vital", "x"])) for i in range(300)]
    z = spark.createDataFrame([(i, p, float(a), float(b), t) for i, p, a, b, t in zones], "zone_id int, page int, y_start double, y_end double, schema_type string")
    e = spark.createDataFrame([(i, p, None if y is None else float(y), t) for i, p, y, t in found], "entity_id int, page int, y double, entity_type string")
    want = []
    for i, p, y, t in found:
        hits = [(not s.startswith(t), n) for n, q, a, b, s in zones if y is not None and p == q and a <= y <= b]
        want.append((i, min(hits)[1] if hits else None))
    assert sorted((r.entity_id, r.zone_id) for r in layout.zone_of(e, z).collect()) == sorted(want)
    assert layout.zone_of(e, z.limit(0)).where("zone_id IS NOT NULL").count() == 0


def test_a_page_with_many_zones_and_entities_is_no_product(spark):
    n = 3000
    z = spark.range(n).select(F.col("id").alias("zone_id"), F.lit(1).alias("page"), (F.col("id") * 10).alias("y_start"), (F.col("id") * 10 + 8).alias("y_end"), F.lit("t").alias("schema_type"))
    e = spark.range(n).select(F.col("id").alias("entity_id"), F.lit(1).alias("page"), (F.col("id") * 10 + 3).alias("y"), F.lit("t").alias("entity_type"))
    assert layout.zone_candidates(e, z).count() <= 3 * n
    assert layout.zone_of(e, z).where("entity_id = zone_id").count() == n
