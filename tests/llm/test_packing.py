import zlib

import numpy as np
import pyarrow as pa
import pytest
from larkspur.llm.common import text_bytes
from larkspur.llm.packing import WordEncoder, best_pattern, pack, plan_patterns, word_bpe_path
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, length string"


def brute(texts):
    t = Tokenizer.from_file(word_bpe_path())
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, docs):
    ids = dict(zip([d for d, _ in docs], brute([t for _, t in docs]), strict=True))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(own) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert by_doc.keys() == ids.keys()
    for d, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    assert sorted(by_seq) == list(range(len(by_seq)))
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return len(by_seq) * 4096 / sum(len(x) for x in ids.values())


def test_whole_table_matches_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack(docs, word_bpe_path()).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()]) < 1.05


def test_edge_cases(spark):
    texts = [None, "", "a", "a", "x" * 30000, "A\x1cb ć d e", "it's 3.5 \U0001f600!! \n\n", "w " * 9000]
    docs = list(enumerate(texts))
    rows = pack(spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS), word_bpe_path()).collect()
    check(rows, docs)
    assert pack(spark.createDataFrame([], DOCS), word_bpe_path()).count() == 0
    assert pack(spark.createDataFrame([(None, "x", ""), (3, "y", ""), (3, "y", "")], DOCS), word_bpe_path()).count() == 3


def test_encoder_remembers(spark):
    e = WordEncoder(word_bpe_path())
    texts = ["The the THE dog", "", "dog dog the"]
    for _ in range(2):
        ids, upto = e.encode(*text_bytes(pa.array(texts)))
        assert [len(x) - 1 for x in brute(texts)] == np.diff(upto).tolist()
        assert ids.tolist() == [i for x in brute(texts) for i in x[:-1]]


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_up_the_demand(seed):
    r = np.random.default_rng(seed)
    lengths = sorted(r.choice(np.arange(1, 100), 12, replace=False).tolist())
    demand = r.integers(1, 300, 12).tolist()
    used = dict.fromkeys(lengths, 0)
    for n, p in (plan := plan_patterns(lengths, demand, 100)):
        assert sum(s * k for s, k in p.items()) <= 100
        for s, k in p.items():
            used[s] += n * k
    assert list(used.values()) == demand
    rooms = []  # first fit, largest first
    for s in sorted((s for s, n in zip(lengths, demand, strict=True) for _ in range(n)), reverse=True):
        fit = next((i for i, room in enumerate(rooms) if room >= s), None)
        if fit is None:
            rooms.append(100 - s)
        else:
            rooms[fit] -= s
    assert sum(n for n, _ in plan) <= len(rooms) + 2


def test_knapsack():
    value, copies = best_pattern(np.array([1.0, 2.5, 4.2]), np.array([2, 4, 7]), 11)
    assert value == pytest.approx(6.7) and (copies == [0, 1, 1]).all()
