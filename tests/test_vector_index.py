import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import retrieval
from larkspur.operators import vector_index as V
from larkspur.sources import table

SMALL = "/root/testdata/sf0.01"


def plain(codes, asked, k, minimum):
    """Every query against every code."""
    unit = lambda v: np.array(v, dtype=float) / np.linalg.norm(v)
    out = {}
    for q, wanted, v in asked:
        hits = [(-float(unit(v) @ unit(c)), key) for key, kind, c in codes if wanted is None or wanted == kind]
        out[q] = [key for s, key in sorted((round(s, 9), key) for s, key in hits) if -s >= minimum][:k]
    return {q: keys for q, keys in out.items() if keys}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query, r.position)):
        out.setdefault(r.query, []).append(r.code)
    return out


def invented(spark, seed=1, n=400, dims=6):
    rng = random.Random(seed)
    vector = lambda: [rng.gauss(0, 1) for _ in range(dims)]
    codes = [(i, rng.choice(["a", "b", None]), vector()) for i in range(n)] + [(n + i, "a", [1.0] * dims) for i in range(n // 2)]  # a third is one vector
    asked = [(i, rng.choice(["a", "b", None]), vector()) for i in range(25)] + [(99, "a", [2.0] * dims)]
    make = lambda rows, key: spark.createDataFrame(rows, f"{key} long, kind string, embedding array<double>")
    return codes, asked, make(codes, "code").repartition(5), make(asked, "query").repartition(3)


@pytest.mark.parametrize("cells,minimum", [(1, -1.0), (7, 0.3), (50, 0.8), (600, 0.5)])
def test_exact_search_meets_every_code_that_counts(spark, cells, minimum):
    codes, asked, c, q = invented(spark, cells)
    got = found(V.search_index(V.build_index(c, ["code"], "kind", cells=cells), q, 12, minimum, kind="kind"))
    assert got == plain(codes, asked, 12, minimum)


def test_recall_of_probed_cells_and_exact_mode_on_the_given_table(spark):
    rows = table(spark, SMALL, "embeddings").select(F.col("vec_id").alias("code"), "embedding")
    asked = rows.where("code % 50 = 0").withColumnRenamed("code", "query")
    index = V.build_index(rows, ["code"], cells=100)
    exact, probed = (found(V.search_index(index, asked, 10, 0.0, probes=p)) for p in (None, 60))
    recall = sum(len(set(probed[q]) & set(exact[q])) for q in exact) / sum(map(len, exact.values()))
    assert recall >= 0.9, recall
    assert found(V.search_index(index, asked, 10, 0.0, probes=100)) == exact


def test_no_nested_loop_and_only_probed_cells_are_read(spark, tmp_path):
    _, _, c, q = invented(spark, 3)
    index = V.build_index(c, ["code"], "kind", cells=20)
    plan = V.search_index(index, q, 5, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    V.save_index(index, str(tmp_path))
    loaded = V.load_index(spark, str(tmp_path))
    one = q.where("query = 99")
    assert found(V.search_index(loaded, one, 5, 0.9, kind="kind")) == found(V.search_index(index, one, 5, 0.9, kind="kind")) == {99: list(range(400, 405))}
    cells = V.probed_cells(loaded, one, 0.999)
    assert 0 < len(cells) < 20
    near = loaded._replace(blocks=loaded.blocks.where(F.col("cell").isin(cells)))
    plan = near.blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert found(V.search_index(near, one, 5, 0.999, kind="kind")) == {99: list(range(400, 405))}


def test_edges(spark):
    codes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, []), (None, [1.0, 0.0]), (6, [1.0, None])], "code long, embedding array<double>")
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query long, embedding array<double>")
    rows = V.search_index(V.build_index(codes, ["code"]), asked, 5, 0.7).collect()
    assert [(r.query, r.code, r.position) for r in rows] == [(1, None, 1), (1, 1, 2)]
    assert V.search_index(V.build_index(codes.limit(0), ["code"]), asked, 5, 0.7).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        V.search_index(V.build_index(codes, ["code"]), asked.select("query", F.array(F.lit(1.0)).alias("embedding")), 5, 0.7).collect()


def test_thresholds_are_not_rounded(spark):
    just_below = 0.6999997
    codes = spark.createDataFrame([(1, [just_below, (1 - just_below**2) ** 0.5]), (2, [0.7000001, (1 - 0.7000001**2) ** 0.5])], "code long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query long, embedding array<double>")
    assert [r.code for r in retrieval.vector_search(codes, asked, ["code"], 5, 0.7).collect()] == [2]


def test_queries_are_placed_in_their_cells_a_few_at_a_time(spark):
    """A query that meets all of 100 cells has a hundred rows; 3,000 queries of one batch are not placed at once."""
    asked = spark.range(0, 3000, 1, 1).selectExpr("id AS query", "array(cast(id % 7 + 1 AS double), cast(id % 5 AS double)) AS v")
    centroids = np.random.default_rng(1).normal(size=(100, 2))
    placed = V.placed(asked, ["query"], "v", centroids, lambda near: np.full(near.shape, len(near) * 100 <= V.PLACED))
    assert placed.count() == 300_000 and placed.select("query", "cell").distinct().count() == 300_000
