import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, scale=256, kp=5, kn=5, low=80, every=10):
    """Every anchor against every row."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v, strict=True)), i is None, i or 0, m, i, y) for m, (i, v, y) in enumerate(kept) if m != n and len(v) == len(a)]
        scored.sort(key=lambda r: r[:4])
        for p in [r for r in scored if r[5] == label][:kp]:
            inside = [r for r in scored if r[5] != label and low * -p[0] <= 100 * -r[0] <= 100 * -p[0]]
            out += [(anchor, p[4], rank, r[4], -p[0], -r[0]) for rank, r in enumerate(inside[:kn], 1)]
    return sorted(out, key=str)


def got(spark, rows, every=10, parts=3, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in H.hard_negatives(df, F.col("id") % every == 0, **settings).collect()), key=str)


def invented(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        long = rng.choice([0.1, 1, 1, 3])
        rows.append((i, [long * rng.choice([0.5, rng.gauss(0.3, 0.5)]) for _ in range(3)], rng.choice([0, 0, 0, 1, 2])))
    return rows + [(n + i, [0.5, 0.5, 0.5], i % 2) for i in range(n // 2)]  # a third of all rows are one vector


@pytest.mark.parametrize("bucket,block", [(4096, 256), (7, 3)])
def test_agrees_with_all_pairs(spark, bucket, block):
    rows = invented(bucket)
    expected = plain(rows)
    assert got(spark, rows, bucket=bucket, block=block) == expected and len(expected) > 300


def test_nulls_repeats_other_lengths_and_no_windows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.95, 0.0], 2), (None, [0.85, 0.0], 2), (3, [0.9], 2), (4, None, 2), (5, [0.9, 0.0], None)]
    rows += [(6, [0.9, None], 2), (7, [float("inf"), 0.0], 2), (8, [], 2), (10, [0.0, 0.0], 3), (11, [-1.0, 0.0], 3), (20, [-1.0, -1.0], 4), (21, [1.0, 1.0], 4)]
    found = got(spark, rows)
    assert found == plain(rows) and {r[3] for r in found if r[0] == 0} >= {None, 2}
    assert got(spark, []) == [] == got(spark, [(0, [1.0], None)]) == got(spark, [(0, [1.0], 1)])


def test_clashing_columns_and_bad_input(spark):
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]
    df = spark.createDataFrame([(*r, 4, "x") for r in rows], SCHEMA + ", row int, block string")
    assert [tuple(r) for r in H.hard_negatives(df, F.col("id") == 0).collect()] == plain(rows)
    with pytest.raises(ValueError):
        H.hard_negatives(df, F.col("id") == 0, low=100)
    with pytest.raises(Exception, match="squared distances|too long"):
        H.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], SCHEMA), F.col("id") == 0)


def test_rows_past_the_bound_are_not_multiplied(monkeypatch):
    vectors = np.array([[9, 0], [5, 0], [3, 0], [1, 0]], np.int32)
    bucket = {"norms": [9.0, 5.0, 3.0, 1.0], "rows": [1, 2, 3, 4], "ids": [1, 2, 3, 4], "dims": 2, "vecs": vectors.tobytes()}
    block = {"norms": [2.0], "rows": [9], "dims": 2, "vecs": np.array([[2, 0]], np.int32).tobytes()}
    shapes = []
    monkeypatch.setattr(H, "dot", lambda a, b: shapes.append(b.shape) or a @ b)
    ask = lambda low: H.best_in_bucket(block | {"windows": [{"pos": 0, "slot": 0, "low": low, "high": 100}]}, bucket, 5)
    assert [r[4] for r in ask(10)] == [18, 10] and shapes == [(2, 2)]
    assert ask(19) == [] and len(shapes) == 1
