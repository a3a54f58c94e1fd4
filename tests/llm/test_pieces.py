import numpy as np
from larkspur.llm.pieces import PieceEncoder, double_array, encoded, piece_bpe_path

SCHEMA = "doc_id long, text string, ids string"


def brute(e, text):
    """Plain Viterbi over characters of the whole text; ties go to the longer last piece."""
    if not text:
        return []
    s = "▁" + text.replace(" ", "▁")
    ids = {p: i for i, p in enumerate(e.pieces) if i > 258}
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        for k in range(i + 1, min(len(s), i + 16) + 1):
            if (p := ids.get(s[i:k])) is not None and best[i] + e.scores[p] > best[k] + 1e-12:
                best[k], back[k] = best[i] + e.scores[p], (i, [p])
        if s[i] not in ids and best[i] + e.unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + e.unknown, (i, [int(e.byte[b]) for b in s[i].encode()])
    out, k = [], len(s)
    while k:
        k, p = back[k]
        out = p + out
    return out


def test_table_round_trips_and_matches_plain_viterbi(spark):
    e = PieceEncoder(piece_bpe_path())
    rows = encoded(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), piece_bpe_path()).collect()
    assert len(rows) == 200 and all(r.decoded == r.text for r in rows)
    for r in rows[:60]:
        want = brute(e, r.text)
        assert abs(sum(e.scores[i] for i in want) - sum(e.scores[i] for i in r.ids)) < 1e-6 * len(want) + 1e-9


def test_edge_cases(spark):
    e = PieceEncoder(piece_bpe_path())
    texts = [None, "", " ", "  a  b ", "Hello  wörld\n\n x 😀", "\x00\x01", "x" * 3000, "日本語 ꙮ", "á", "the the"]
    rows = encoded(spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], SCHEMA), piece_bpe_path()).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert r.decoded == (t or "")
        assert abs(sum(e.scores[i] for i in brute(e, t or "")) - sum(e.scores[i] for i in r.ids)) < 1e-6
    assert encoded(spark.createDataFrame([], SCHEMA), piece_bpe_path()).count() == 0


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", "é".encode(), b"zz"]
    base, check, value = double_array(keys, list(range(6)))

    def find(key):
        s = 0
        for b in key:
            t = base[s] + b
            if check[t] != s:
                return -1
            s = t
        return value[s]

    assert [find(k) for k in keys] == list(range(6)) and find(b"z") == -1 and find(b"ac") == -1


def test_long_words_match_plain_viterbi():
    import random

    r = random.Random(4)
    e = PieceEncoder(piece_bpe_path())
    texts = ["".join(r.choice(["the", "and", "tion", "x", "é", "日", "ꙮ", "qz"]) for _ in range(n)) for n in (400, 2000)] + ["x" * 5000]
    for t in texts:
        word = (" " + t).encode()
        got = e._long(word)
        assert e.decode(np.array(got)).decode() == t
        assert abs(sum(e.scores[i] for i in brute(e, t)) - sum(e.scores[i] for i in got)) < 1e-6
        assert got == e._viterbi([word])[0]


def test_very_long_word_is_encoded_in_time():
    import time

    e, began = PieceEncoder(piece_bpe_path()), time.time()
    text = "aloneword" * 100_000
    ids, _ = e.encode(*(np.frombuffer((" " + text).encode(), np.uint8), np.array([0, len(text) + 1])))
    assert e.decode(ids.astype(np.int64)).decode() == text and time.time() - began < 60


def test_double_array_grows():
    keys = [bytes([a, b, c]) for a in range(1, 60) for b in range(1, 60) for c in range(1, 60, 3)]
    base, check, value = double_array(keys, list(range(len(keys))))
    for k in range(0, len(keys), 997):
        s = 0
        for b in keys[k]:
            t = base[s] + b
            assert check[t] == s
            s = t
        assert value[s] == k
