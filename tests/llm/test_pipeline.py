import random
import re

import corpus_pipeline
import pytest
from larkspur.llm.common import SHUFFLE_CLEANUP

from .test_ngram_join import brute

SCHEMA = "doc_id long, text string, n_chars long"


@pytest.fixture
def stage(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)

    def run(f, rows):
        df = f(spark, spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], SCHEMA), None)
        assert df.columns == ["doc_id", "text", "n_chars"]
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    yield run
    if before is None:
        spark.conf.unset(SHUFFLE_CLEANUP)
    else:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def smallest(rows, group):
    """The first row with the smallest id of each group, null before all others."""
    best = {}
    for k, (i, _) in enumerate(rows):
        key = (i is not None, i or 0, k)
        best[group[k]] = min(best.get(group[k], key), key)
    return sorted((rows[k] for *_, k in best.values()), key=str)


def test_exact_copies_with_null_and_repeated_ids(stage):
    rows = [(1, "a"), (2, "a"), (2, "b"), (None, "c"), (None, "c"), (None, "d"), (5, "d"), (7, "e"), (7, "e"), (8, ""), (9, None)]
    r = random.Random(2)
    rows += [(r.choice([None, *range(10, 20)]), f"t{r.randrange(25)}") for _ in range(100)]
    norm = lambda t: re.sub("[\\x20\\x09-\\x0D]+", " ", t or "")
    assert stage(corpus_pipeline.exact_copies, rows) == smallest(rows, [norm(t) for _, t in rows])
    assert stage(corpus_pipeline.exact_copies, []) == []


def test_near_copies_with_null_and_repeated_ids(stage):
    r = random.Random(4)
    text = lambda: [f"w{r.randrange(400)}" for _ in range(60)]
    one, two = text(), text()
    near = lambda t, k: " ".join([*t[:-1], f"x{k}"])
    rows = [(3, near(one, 0)), (None, near(one, 1)), (4, near(one, 2)), (None, near(one, 3))]
    rows += [(6, near(two, 0)), (7, near(two, 1)), (7, near(text(), 0)), (None, near(text(), 0)), (8, ""), (8, None)]
    root = {k: b for k, _, b in brute(list(enumerate(t for _, t in rows)), 5, 4, 5)}
    want = smallest(rows, [root[k] for k in range(len(rows))])
    assert len(want) == 6
    assert stage(corpus_pipeline.near_copies, rows) == want


def test_near_copies_of_a_long_chain_keep_one(stage):
    words = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(words[:60] if not i else [*(f"v{k}" for k in range(i)), *words[i : 60]])) for i in range(5)]
    root = {k: b for k, _, b in brute(list(enumerate(t for _, t in rows)), 5, 4, 5)}
    assert stage(corpus_pipeline.near_copies, rows) == smallest(rows, [root[k] for k in range(len(rows))])


def test_personal_data_gives_way_and_sizes_follow(stage, spark):
    rows = [(1, "mail joe@x.org now"), (None, "ssn 123-45-6789"), (2, None), (2, ""), (3, "clean text of 2024")]
    assert stage(corpus_pipeline.personal_data, rows) == sorted([(1, "mail <email> now"), (None, "ssn <ssn>"), (2, None), (2, ""), (3, "clean text of 2024")], key=str)
    df = corpus_pipeline.personal_data(spark, spark.createDataFrame([(1, "mail joe@x.org now", 18)], SCHEMA), None)
    assert df.first().n_chars == len("mail <email> now")


def test_packing_holds_every_id_once(spark):
    docs = spark.createDataFrame([(1, "one two three", 13), (1, "one two three", 13), (None, None, None), (4, "word " * 9000, 45000)], SCHEMA)
    rows = corpus_pipeline.packing(spark, docs, None).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in rows if r.doc_id == 4) == max(r.doc_tokens for r in rows if r.doc_id == 4)
    assert sorted((r.start, r.length) for r in rows if r.doc_id is None) == [(0, 1)] and len([r for r in rows if r.doc_id == 1]) == 2


def test_quality_keeps_rows_as_the_model_scores_them(spark):
    from larkspur.llm.quality import fit, quality_scores

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality_scores(docs, fit(docs, labels)).collect() if r.score >= 0.7}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < docs.count()
    assert corpus_pipeline.quality(spark, docs.limit(0), sf).count() == 0


def test_the_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_join", "pii", "packing"]


def test_run_is_the_stages_one_after_another_and_restores_the_setting(spark):
    sf, before = "/root/testdata/sf0.001", spark.conf.get(SHUFFLE_CLEANUP, None)
    got = corpus_pipeline.run(spark, sf)
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    try:
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, sf)
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
