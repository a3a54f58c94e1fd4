import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from larkspur.llm.simhash import fingerprints, neighbours, simhash_report
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, range string"


def even():
    return F.col("doc_id") % 2 == 0


def plain(text):
    """The 128-bit SimHash as (fp0, fp1), by counting each term's votes on each bit."""
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", (text or "").lower()) if w]
    out = []
    for seed in (1, 2):
        start = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        votes = [0] * 64
        for a, b in zip(words, [*words[1:], None][: len(words)], strict=True):
            h = xxhash.xxh64_intdigest(a.encode(), start)
            h = xxhash.xxh64_intdigest(b.encode(), h) if b is not None else h
            votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
        out.append(sum(1 << i for i, v in enumerate(votes) if v > 0))
    return tuple(out)


def shown(fp):
    return f"{fp[0]:016x}{fp[1]:016x}"


def bits(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))


def check(spark, docs, radius=3):
    """The whole report against brute force, for ids that do not repeat."""
    rows = simhash_report(spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA).repartition(3), even(), radius).collect()
    assert len(rows) == len(docs)
    order = sorted(docs)
    fp = {i: plain(t) for i, t in docs}
    for r in rows:
        k = next(k for k, (i, _) in enumerate(order) if i == r.doc_id)
        after_id, after = order[(k + 1) % len(order)]
        text, after = order[k][1] or "", after or ""
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == shown(fp[r.doc_id]) and r.edited_fingerprint == shown(plain(edited))
        for other, got in ((plain(edited), r.near_edited), (fp[after_id], r.near_next)):
            assert abs(max(0, 1 - 2 * bits(fp[r.doc_id], other) / 128) - got) < 1e-6
        near = [i for i in fp if bits(fp[i], fp[r.doc_id]) <= radius]
        assert (r.n_near, r.near_least) == ((len(near) - 1, min(near)) if r.doc_id % 2 == 0 else (None, None))
    return rows


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = check(spark, docs)
    assert np.mean([r.near_edited > r.near_next for r in rows if r.n_chars > 200]) > 0.97
    assert any(r.n_near for r in rows)


def test_edge_cases(spark):
    check(spark, [(5, None), (1, ""), (9, "\u00e9\U0001f600 one two"), (-3, "w " * 70000), (2, "one two three four"), (3, "one two three four"), (4, "one two three four")])
    check(spark, [(2, "only one here")])
    assert simhash_report(spark.createDataFrame([], SCHEMA), even()).count() == 0


def test_rows_that_repeat_an_id(spark):
    texts = ["alpha beta gamma delta " * 3, "one two three four five " * 4, "other words in this text " * 5, "null id text here " * 3]
    docs = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (2, texts[2]), (None, texts[3]), (None, texts[0])]
    rows = simhash_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), even()).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in rows) == sorted((i or -1, shown(plain(t))) for i, t in docs)
    tag = lambda t: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted({(i if i is not None else -(2**63), tag(t), t) for i, t in docs})
    for k, (i, _, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        want = round(max(0, 1 - 2 * bits(plain(t), plain(after)) / 128), 6)
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        got = [r for r in rows if (r.doc_id if r.doc_id is not None else -(2**63)) == i and r.fingerprint == shown(plain(t))]
        assert got and all((r.near_next, r.edited_sha256) == (want, hashlib.sha256(edited.encode()).hexdigest()) for r in got)
    assert [r.n_near for r in rows if r.doc_id == 2] == [2, 2, 2]
    assert all(r.n_near is None for r in rows if r.doc_id != 2)


@pytest.mark.parametrize(("radius", "blocks"), [(3, 4), (7, 8), (2, 5), (0, 2), (5, 7)])
def test_block_tables_find_all_within_the_radius(spark, radius, blocks):
    r = random.Random(radius)
    centres = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(6)]
    some = set(centres)
    for a, b in centres:
        for _ in range(25):
            flip = sum(1 << k for k in r.sample(range(128), r.randrange(10)))
            some.add((a ^ flip >> 64, b ^ flip & (2**64 - 1)))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in some], "fp0 long, fp1 long")
    want = {(p, q, bits(p, q)) for p in some for q in some if p[0] % 2 == 0 and bits(p, q) <= radius}
    got = {((x.q0 % 2**64, x.q1 % 2**64), (x.fp0 % 2**64, x.fp1 % 2**64), x.distance) for x in neighbours(df.where("fp0 & 1 = 0"), df, radius, blocks).collect()}
    assert got == want and want


def test_too_few_blocks(spark):
    with pytest.raises(ValueError, match="more blocks"):
        neighbours(spark.range(0), spark.range(0), 3, 3)
