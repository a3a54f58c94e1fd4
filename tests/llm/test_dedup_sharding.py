import hashlib
import re
import zlib

from larkspur.llm.exact_dedup import exact_groups
from larkspur.llm.sharding import WHOLE, coordinates, kd_shards

SCHEMA = "doc_id long, text string, lang string, source string, size string"


def test_exact_groups_against_brute_force(spark):
    texts = [None, "", "a  b", "a b", "a\t\nb", "A b", "é" * 50000, "é" * 50000, " "]
    got = exact_groups(spark.createDataFrame([(9 - i, t, None, "s", "clash") for i, t in enumerate(texts)], SCHEMA)).collect()
    norm = {9 - i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in enumerate(texts)}
    for r in got:
        same = [k for k, v in norm.items() if v == norm[r.doc_id]]
        assert tuple(r) == (r.doc_id, min(same), len(same), r.doc_id == min(same), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    assert len(got) == len(texts)
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shards_keep_their_laws(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = kd_shards(docs, 7).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    by = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(7))
    sizes = [sum(r.size for r in rs) for rs in by.values()]
    assert max(sizes) < 1.1 * min(sizes)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())


def test_sharding_edge_cases(spark):
    rows = [(i, "same", "en", "s", "c") for i in range(300)] + [(None, None, None, None, "c"), (5, "", "en", "s", "c")]
    got = kd_shards(spark.createDataFrame(rows, SCHEMA), 5).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert len(got) == 302 and max(sizes) - min(sizes) <= 60
    assert kd_shards(spark.createDataFrame([], SCHEMA), 5).count() == 0


def plain_tree(points, first, shards, whole):
    """(shard, row) for every row by the rules of the tree, on sorted lists."""
    if shards == 1 or not points:
        return [(first, p) for p in points]
    dims = range(len(whole))
    width = lambda i: (max(p["at"][i] for p in points) - min(p["at"][i] for p in points)) / whole[i]
    dim = max(dims, key=lambda i: (width(i), -i))
    bytes_of = {}
    for p in points:
        bytes_of[p["at"][dim]] = bytes_of.get(p["at"][dim], 0) + p["size"]
    goal, before = sum(bytes_of.values()) * (shards // 2) / shards, 0
    for key in sorted(bytes_of):
        if before + bytes_of[key] > goal or key == max(bytes_of):
            break
        before += bytes_of[key]
    last = key if (goal - before) * 2 > bytes_of[key] else key - 1
    left, right = [p for p in points if p["at"][dim] <= last], [p for p in points if p["at"][dim] > last]
    return plain_tree(left, first, shards // 2, whole) + plain_tree(right, first + shards // 2, shards - shards // 2, whole)


def test_the_tree_against_sorted_lists_on_40_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    points, dims = coordinates(docs, 40, 16, "doc_id", "text", ("lang", "source"))
    rows = [{"doc_id": r.doc_id, "size": r["size"], "at": [r[f"at{i}"] for i in range(dims)]} for r in points.collect()]
    assert dims == 4 and len(rows) == docs.count()
    whole = [max(1, max(r["at"][i] for r in rows) - min(r["at"][i] for r in rows)) for i in range(dims)]
    want = {r["doc_id"]: s for s, r in plain_tree(rows, 0, 40, whole)}
    assert {r.doc_id: r.shard for r in kd_shards(docs, 40).collect()} == want


def test_equal_texts_stay_together_below_the_stated_size(spark):
    rows = [(i, f"text {i} " * 30, "en", "s", "c") for i in range(2000)]
    rows += [(10_000 + i, f"copy {i % 40} " * 30, ["en", "de"][i % 2], f"s{i % 3}", "c") for i in range(160)] + [(20_000 + i, "big " * 60, "en", "s", "c") for i in range(900)]
    got = kd_shards(spark.createDataFrame(rows, SCHEMA), 8).collect()
    shards, sizes = {}, [0] * 8
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
        sizes[r.shard] += r.size
    crc = lambda t: zlib.crc32(t.encode())
    assert all(len(shards[crc(f"copy {i} " * 30)]) == 1 for i in range(40))
    assert len(shards[crc("big " * 60)]) > 1
    assert max(sizes) - min(sizes) <= 2 * WHOLE * sum(sizes) / 8
