import hashlib
import random

import pytest
from larkspur.llm.substrings import without_repeats

SCHEMA = "doc_id long, text string, rank string"


def brute(docs, n):
    seen, out = set(), set()
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            if s in seen:
                gone[k : k + n] = b"\x01" * n
            seen.add(s)
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.add((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, docs, n=100):
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA).repartition(3)
    return {tuple(r) for r in without_repeats(df, n).collect()}


@pytest.mark.parametrize("n", [100, 70, 20, 300])
def test_against_brute_force(spark, n):
    r = random.Random(n)
    words = ["the", "of", "and", "ein", "été", "x", "longerword", "\n"]
    passages = [" ".join(r.choice(words) + r.choice(words) for _ in range(k)) for k in (8, 12, 20, 40, 90)]
    docs = []
    for i in range(60):
        parts = [r.choice([r.choice(passages), r.choice(passages)[r.randrange(30) :], " ".join(r.choice(words) for _ in range(20)), "ab" * 70, "z" * r.randrange(250)]) for _ in range(r.randrange(6))]
        docs.append((i * 37 % 61, r.choice(["", " "]).join(parts)))
    assert got(spark, docs, n) == brute(docs, n)


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(spark, docs) == brute(docs, 100)


def test_edge_cases(spark):
    docs = [(3, None), (2, ""), (1, "a" * 99), (0, "a" * 100), (7, "a" * 3000), (8, "é" * 60), (9, "é" * 60), (-4, "é" * 50)]
    assert got(spark, docs) == brute(docs, 100)
    assert got(spark, []) == set()


def test_lengths_that_make_no_sense(spark):
    with pytest.raises(ValueError, match="positive"):
        without_repeats(spark.createDataFrame([], SCHEMA), 0)


def test_of_repeated_rows_one_keeps_its_bytes(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    one, two, three, short = text(579), text(300), text(250), text(60)
    rows = [(1, one), (1, one), (2, two), (2, two + three), (None, three), (None, three), (None, short), (None, short), (7, one + three)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(3)
    out = sorted(map(tuple, without_repeats(df, 100).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    of = lambda i: sorted((n, gone, sha) for d, n, gone, _, sha in out if d == i)
    assert of(1) == [(579, 0, sha(one)), (579, 579, sha(""))]
    assert of(None) == sorted([(60, 0, sha(short)), (60, 0, sha(short)), (250, 0, sha(three)), (250, 250, sha(""))])
    # which of the two rows of id 2 comes first follows a hash of their texts; together they keep the bytes once
    kept = {sha(two): 300, sha(""): 0, sha(two + three): 550, sha(three): 250}
    assert sum(kept.get(s, 0) for _, _, s in of(2)) == 300
    assert [gone for _, gone, _ in of(7)] == [829]


def test_many_rows_with_one_id_and_text(spark):
    df = spark.createDataFrame([(5, "ab" * 400)] * 500 + [(None, "")] * 20, "doc_id long, text string").repartition(7)
    out = without_repeats(df, 100).collect()
    want = brute([(5, "ab" * 400)], 100)
    assert sum(tuple(r) in want for r in out) == 1
    assert sum(r.n_removed == 800 for r in out) == 499 and sum(r.n_bytes == 0 for r in out) == 20
