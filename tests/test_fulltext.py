import math
import random
import re

import pytest

from larkspur.operators import fulltext

WORD = re.compile(r"[^\W_]+")


def plain(docs, query, stop=()):
    """Rank of every document that has all words, from all pairs of places."""
    terms = [t for t in dict.fromkeys(WORD.findall(query.lower())) if t not in stop]
    out = {}
    for key, fields in docs.items():
        words = [(w, weight) for text, weight in fields for w in WORD.findall((text or "").lower())]
        at = [[(i, w) for i, (x, w) in enumerate(words) if x == t] for t in terms]
        if not terms or not all(at):
            continue
        if len(terms) == 1:
            weights = [w for _, w in at[0]]
            first = weights.index(max(weights)) + 1
            out[key] = (max(weights) + sum(w / (j * j) for j, w in enumerate(weights, 1)) - max(weights) / first**2) / 1.64493406685
        else:
            left = 1.0
            for i, a in enumerate(at):
                for b in at[:i]:
                    for p, v in a:
                        for q, w in b:
                            d = abs(p - q)
                            left *= 1 - math.sqrt(v * w * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
            out[key] = 1 - left
    return {k: round(v, 9) for k, v in out.items()}


def invented():
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["the", "alpha", "Beta", "gamma", "ÑANDÚ", "x1", "filler", "more", "words"]) for _ in range(n))
    docs = {i: [(say(rng.randrange(4)), 1.0), (say(rng.choice([0, 3, 30, 260])), 0.1)] for i in range(40)}
    docs[99] = [("alpha", 1.0), ("filler " * 150 + "beta", 0.1)]  # further apart than 100
    docs[98] = [(None, 1.0), (None, 0.1)]
    return docs


def test_ranks_agree_with_all_pairs(spark, tmp_path):
    docs = invented()
    df = spark.createDataFrame([(k, t, b) for k, ((t, _), (b, _)) in docs.items()], "id long, title string, body string")
    asked = ["alpha", "alpha beta", "gamma, ALPHA! beta", "the alpha", "the", "", "ñandú x1", "absent alpha", "alpha alpha"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate([*asked, None])], "query long, text string")
    index = fulltext.build_index(df, "id", {"title": "A", "body": "D"}, stop=["the"])
    for used in (index, fulltext.save_index(index, str(tmp_path / "i"))):
        got = {}
        for r in fulltext.search(used, q, stop=["the"]).collect():
            got.setdefault(r.query, {})[r.id] = round(r.rank, 9)
        assert got == {i: found for i, t in enumerate(asked) if (found := plain(docs, t, ["the"]))} and len(got) >= 6


def test_only_the_folders_of_asked_words_are_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"w{i} common") for i in range(300)], "id long, text string")
    index = fulltext.save_index(fulltext.build_index(df, "id", {"text": "D"}), str(tmp_path))
    q = spark.createDataFrame([(1, "w7 common")], "query long, text string")
    read = []
    keep = fulltext.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fulltext, "written", lambda df: read.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
        assert [(r.id, round(r.rank, 4)) for r in fulltext.search(index, q).collect()] == [(7, round(plain({7: [("w7 common", 0.1)]}, "w7 common")[7], 4))]
    assert "PartitionFilters: [" in read[0] and "bucket" in read[0].split("PartitionFilters: [")[1].split("]")[0]


def test_owners_and_edges(spark):
    df = spark.createDataFrame([(1, 10, "red car"), (2, 11, "red car"), (2, None, "red car"), (2, 12, None)], "owner int, id int, text string")
    index = fulltext.build_index(df, "id", {"text": "D"}, ["owner"])
    q = spark.createDataFrame([(1, 2, "car red"), (2, None, "car"), (3, 1, "bus")], "query int, owner int, text string")
    assert [(r.query, r.id) for r in fulltext.search(index, q).collect()] == [(1, 11)]
    assert fulltext.search(index, q.limit(0)).count() == 0 == fulltext.search(fulltext.build_index(df.limit(0), "id", {"text": "D"}, ["owner"]), q).count()


def test_only_postings_of_asked_words_are_made(spark):
    df = spark.createDataFrame([(i, f"w{i} common " + " ".join(f"v{i}x{j}" for j in range(50))) for i in range(40)], "id long, text string")
    q = spark.createDataFrame([(1, "w7 common")], "query long, text string")
    plans, keep = [], fulltext.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fulltext, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
        assert [r.id for r in fulltext.search(fulltext.build_index(df, "id", {"text": "D"}), q).collect()] == [7]
    assert "LeftSemi" in plans[0].split("collect_list", 1)[1]  # beneath the grouping, so before its shuffle
