import hashlib
import math
import random

import numpy as np
import pytest

from larkspur.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, dims, scale, rounds, seed=1):
    """Lloyd rounds over all pairs, in Python integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    means = [list(v) for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(means)), key=lambda c: (far(v, means[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        for c, g in groups.items():
            means[c] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    out = [(i, c := nearest(v), far(v, means[c])) for i, v in kept]
    total = sum(d for _, _, d in out)
    own = {c: sum(d for _, x, d in out if x == c) for c in range(len(means))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, own[c], total, sha[c]) for i, c, d in out), key=str)


def got(spark, rows, parts=3, **settings):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in C.clustered(df, **settings).collect()), key=str)


@pytest.mark.parametrize("dims,k,leaf", [(1, 3, 1), (2, 5, 2), (5, 7, 4), (64, 4, 32)])
def test_agrees_with_all_pairs(spark, dims, k, leaf):
    rng = random.Random(dims)
    rows = [(i, [rng.choice([0.0, 0.5, rng.gauss(0, 1)]) for _ in range(dims)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * dims) for i in range(150)]  # a third of the rows are one vector
    settings = dict(k=k, dims=dims, scale=64, rounds=3)
    assert got(spark, rows, leaf=leaf, tree_bytes=8 * dims * 50, **settings) == plain(rows, **settings)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(x)]) for i, x in enumerate([0, 0, 0, 2, 2, 1, 1, 9])]
    for rounds in (0, 1, 3):
        settings = dict(k=6, dims=1, scale=1, rounds=rounds)
        assert got(spark, rows, leaf=1, **settings) == plain(rows, **settings)


def test_rows_that_take_no_part_nulls_and_repeats(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (7, []), (None, [3.0, -1.0])]
    settings = dict(k=2, dims=2, scale=64, rounds=3)
    found = got(spark, rows, **settings)
    assert found == plain(rows, **settings) and [r[0] for r in found] == [1, 1, None]
    assert got(spark, [], **settings) == [] == got(spark, [(1, None)], **settings)


def test_clashing_columns_and_large_components(spark):
    df = spark.createDataFrame([(1, [1.0], 1, 2, b"x"), (2, [5.0], 1, 2, b"y")], SCHEMA + ", cluster int, points binary")
    assert C.clustered(df, k=2, dims=1).count() == 2
    with pytest.raises(Exception, match="squared distances"):
        C.clustered(spark.createDataFrame([(1, [1.0], 1), (2, [3e30], 1)], SCHEMA), k=1, dims=1).collect()


def test_dominated_centroids_are_pruned_and_nodes_assigned_whole():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(at, 3, (500, 2)) for at in (0, 100, 200)]).astype(np.int64)
    _, tree = C.grow(points, 8)
    middles = np.array([[0, 0], [100, 100], [200, 200]])
    whole, at, cluster, _ = C.filtered(tree, middles)
    assert sum((tree.bounds[n, 1] - tree.bounds[n, 0]).sum() for n, _ in whole) + len(at) == 1500 and len(at) <= 40  # only leaves that hold points of two groups are compared
    assert (tree.low[0] == points.min(0)).all() and (tree.sums[0] == points.sum(0)).all() and tree.squares[0] == (points**2).sum()
    assert C.dot(np.array([[2**31]]), np.array([[2**31]]))[0, 0] == 2**62
