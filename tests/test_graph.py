import random

import pytest

from larkspur.operators import graph


def closure(edges, starts):
    out, next_of = set(), {}
    for a, b in edges:
        if a is not None and b is not None:
            next_of.setdefault(a, set()).add(b)
    for s in starts:
        todo = [s] if s is not None else []
        while todo:
            n = todo.pop()
            if (s, n) not in out:
                out.add((s, n))
                todo += next_of.get(n, ())
    return out


def invented(seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    return edges + [(7, None), (None, 3), (5, 5), (40, 41), (41, 40)]  # a long path, branches, cycles, nulls and a loop


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability_and_paths_agree_with_a_search(spark, seed):
    edges = invented(seed)
    df = spark.createDataFrame(edges, "a long, b long")
    starts = [0, 40, 59, 77, None]
    got = {tuple(r) for r in graph.reachable(df, spark.createDataFrame([(s,) for s in starts], "start long")).collect()}
    assert got == closure(edges, starts)
    pairs = [(a, b) for a in (0, 5, 29, 40, 50) for b in (0, 12, 30, 41, 58, 99)] + [(None, 1), (0, 12)]
    found = sorted(tuple(r) for r in graph.paths_exist(df, spark.createDataFrame(pairs, "a long, b long")).collect())
    all_of = closure(edges, {a for a, _ in pairs})
    assert found == sorted({p for p in pairs if p in all_of})


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    step = graph.Visited.step
    monkeypatch.setattr(graph.Visited, "step", lambda self, edges: rounds.append(1) or step(self, edges))
    chain = spark.range(n).selectExpr("id AS a", "id + 1 AS b")
    assert graph.reachable(chain, spark.createDataFrame([(0,)], "start long")).count() == n + 1 and len(rounds) <= 16
    rounds.clear()
    proposed = spark.createDataFrame([(n, 0), (0, n), (7, 3), (3, 7)], "a long, b long")
    assert sorted(tuple(r) for r in graph.refused_edges(chain, proposed).collect()) == [(7, 3), (n, 0)] and len(rounds) <= 30


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, i) for i in range(300, 340)] + [(7, None), (200, 200)]
    group = {n: n for e in edges for n in e if None not in e}
    for _ in group:
        for a, b in edges:
            if a is not None and b is not None:
                group[a] = group[b] = min(group[a], group[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == group and graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
