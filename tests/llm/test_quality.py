import zlib

import numpy as np
import pyarrow as pa
from larkspur.llm.quality import NEIGHBOURS, SHARPNESS, Neighbours, fit, quality_scores, term_counts

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.98
    assert np.mean([r.predicted for r in bad]) < 0.1


def test_votes_against_brute_force():
    r = np.random.default_rng(1)
    counts = r.integers(0, 3, (60, 2050))
    counts[:, 2049] = 0
    labels = r.integers(0, 2, 60)
    m = Neighbours(counts, labels, np.ones(60))
    got = m.scores(counts[:5])
    v = m._latent(counts[:5])
    for i in range(5):
        near = sorted(((float(v[i] @ w), int(y)) for w, y in zip(m.vectors, labels, strict=True)), reverse=True)[:NEIGHBOURS]
        told = [(max(s, 0) ** SHARPNESS, y) for s, y in near]
        want = (sum(w * y for w, y in told) + 0.01 * m.prior) / (sum(w for w, _ in told) + 0.01)
        assert abs(want - got[i]) < 1e-4


def test_terms_do_not_cross_texts():
    a = term_counts(pa.array(["abc", None, "de", "fghij"]))
    assert a[:, :2048].sum(axis=1).tolist() == [1, 0, 0, 3]
    assert term_counts(pa.array(["a a b", "b b b", None, "b"]))[:, 2048:].tolist() == [[3, 1], [3, 2], [0, 0], [1, 0]]
    assert (term_counts(pa.array(["a1b"])) == term_counts(pa.array(["a7b"]))).all()


def test_edge_cases(spark):
    schema = "doc_id long, text string, score string, quality int"
    docs = spark.createDataFrame([(1, None, "c", 0), (1, "", "c", 0), (None, "word", "c", 0), (2, "x" * 300000, "c", 0)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_scores(docs, fit(docs, none)).collect()
    assert len(rows) == 4 and all(r.score == 1 and r.predicted == 1 for r in rows)
    some = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (7, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_scores(docs, fit(docs, some)).collect())
    assert quality_scores(docs.limit(0), fit(docs, some)).count() == 0
