import random
import re

import pytest
from larkspur.llm import ngram_join
from larkspur.llm.common import connected_components
from larkspur.llm.ngram_join import jaccard_components

SCHEMA = "doc_id long, text string, root string"


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, n, num, den):
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


def got(spark, docs, n, t):
    df = jaccard_components(spark.createDataFrame([(i, x, "clash") for i, x in docs], SCHEMA), n, t)
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(("n", "t"), [(3, (9, 10)), (5, (4, 5))])
def test_against_brute_force_on_edited_copies(spark, n, t):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs, chain = [], []
    for i in range(150):
        if i % 3 and chain:
            base = r.choice(chain).split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                base[r.randrange(len(base))] = r.choice(words)
        else:
            base = [r.choice(words) for _ in range(r.choice([1, 2, 4, 9, 20, 60, 150]))]
        chain.append(" ".join(base))
        docs.append((i * 7 % 151, chain[-1].upper() if i % 5 == 0 else chain[-1]))
    assert got(spark, docs, n, t) == brute(docs, n, *t)


def test_sf_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(spark, docs, 3, (9, 10)) == brute(docs, 3, 9, 10)


def test_edge_cases(spark):
    docs = [(5, None), (4, ""), (3, " \n"), (2, "one"), (1, "ONE"), (0, "x " * 50000), (9, "É"), (8, "é")]
    assert got(spark, docs, 3, (9, 10)) == brute(docs, 3, 9, 10)
    assert got(spark, [], 3, (9, 10)) == set()
    df = jaccard_components(spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string"), 3)
    assert df.count() == 3


def test_large_buckets_and_clusters_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 100)
    r = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    base = [f"b{i}" for i in range(40)]
    docs = []
    for i in range(50):
        own = list(base) if i % 2 else [f"w{r.randrange(500)}" for _ in range(40)]
        own[r.randrange(40)] = f"x{i}"
        docs.append((i, " ".join(own + common)))
    assert got(spark, docs, 5, (4, 5)) == brute(docs, 5, 4, 5)


@pytest.mark.parametrize("edges", [
    [(5, 1), (5, 2)],
    [(2, 5), (5, 6), (6, 9), (9, 1)],
    [(8, 3), (3, 4), (12, 10), (12, 11), (13, 11), (20, 20)],
])
def test_components_have_one_row_a_node_and_the_smallest_root(spark, edges):
    root = {n: n for a, b in edges if a != b for n in (a, b)}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted(root.items())


def test_random_trees(spark):
    r = random.Random(11)
    edges, root = [], {}
    for k in range(60):
        own = list(range(k * 20, k * 20 + r.choice([2, 3, 3, 5, 20])))
        r.shuffle(own)
        edges += [(own[i], own[i - 1] if k % 2 else own[r.randrange(i)]) for i in range(1, len(own))]
        root |= dict.fromkeys(own, min(own))
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted(root.items())


def test_document_that_links_two_smaller_ids_comes_out_once(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [(5, " ".join(words)), (1, " ".join(["x", *words[1:]])), (2, " ".join([*words[:-1], "y"]))]
    docs += [(12, " ".join(words[:50])), (11, " ".join(["x", *words[1:50]]))]
    assert brute(docs, 3, 49, 50) == {(5, 98, 5), (1, 98, 1), (2, 98, 2), (12, 48, 12), (11, 48, 11)}
    near = brute(docs, 3, 97, 100)
    rows = jaccard_components(spark.createDataFrame([(i, x, "clash") for i, x in docs], SCHEMA), 3, (97, 100)).collect()
    assert len(rows) == len(docs) and {tuple(r) for r in rows} == near
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 5)} == {1}


def test_null_ids_link_only_as_their_texts_do(spark):
    rows = [(None, "a b c d e f"), (None, "z y x w v u"), (1, "a b c d e f"), (2, "z y x w v u"), (3, "one two three"), (None, ""), (None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, 3).collect()), key=str)
    assert got == sorted([(None, 4, None), (None, 4, None), (1, 4, None), (2, 4, None), (3, 1, 3), (None, 0, None), (None, 0, None), (4, 0, 4)], key=str)
    parts = spark.createDataFrame([r for r in rows if r[0] != 1 and r[1] != "z y x w v u"] + [(9, "z y x w v u"), (8, "z y x w v u")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(parts, 3).where("doc_id IS NOT NULL").collect()} == {3: 3, 4: 4, 8: 8, 9: 8}
