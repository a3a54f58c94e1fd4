import random

import pytest

from larkspur.operators import layout, records, similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def grams_of(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def invented(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randrange(18))) for _ in range(n // 3)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "", "ab" * 12]
    edited = []
    for t in base * 2:
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "a", "x"]) + t[at + rng.randrange(2) :]
        edited.append(t)
    return base + edited, edited + base[:5] + [base[0]] * n  # a string that repeats


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 1.0])
def test_edit_pairs_are_all_pairs(spark, threshold):
    left, right = invented(int(threshold * 100))
    make = lambda rows: spark.createDataFrame([(i % 2, t) for i, t in enumerate(rows)] + [(None, "ab"), (0, None)], "k int, text string")
    got = sorted((r.k, r.left_text, r.right_text, round(r.similarity, 9)) for r in similar.edit_pairs(make(left), make(right), threshold, ["k"]).collect())
    pairs = {(i % 2, a, b) for i, a in enumerate(left) for j, b in enumerate(right) if i % 2 == j % 2}
    like = lambda a, b: 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0
    assert got == sorted((k, a, b, round(like(a, b), 9)) for k, a, b in pairs if like(a, b) >= threshold) and got


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_trigram_pairs_are_all_pairs(spark, threshold):
    left, right = invented(int(threshold * 100) + 1)
    make = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    got = sorted((r.left_text, r.right_text, round(r.similarity, 9)) for r in similar.trigram_pairs(make(left), make(right), threshold, []).collect())
    want = []
    for a in set(left):
        for b in set(right):
            x, y = grams_of(a), grams_of(b)
            if x and y and len(x & y) / len(x | y) >= threshold:
                want.append((a, b, round(len(x & y) / len(x | y), 9)))
    assert got == sorted(want) and got


def test_markers_of_any_length_and_words_of_context_that_repeat(spark):
    rng = random.Random(3)
    said = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(140)]
    y = lambda i: 20 * (i // 2)
    words = [(1, i, w, y(i), 12, 1.0) for i, w in enumerate(said)]
    long = " ".join(said[30:91])
    rows = [("exact", 1, long.upper(), None), ("fuzzy", 1, long.replace("a", "x", 5), None), ("none", 1, " ".join(sorted(said[:60])), None)]
    for seq, w, at in [(0, "Total", 0), (1, "sum", 0), (2, "tax", 10), (3, "Total", 1000), (4, "sum", 1000), (5, "net", 1010), (6, "due", 1010)]:
        words.append((2, seq, w, at, 12, 1.0))
    rows += [("repeats", 2, "total sum", "tax tax net"), ("distinct", 2, "total sum", "tax net due")]
    w = spark.createDataFrame(words, "page int, seq int, text string, y int, height int, confidence double")
    m = spark.createDataFrame([(*r, None, 3300) for r in rows], "marker_id string, page int, marker string, context string, region string, page_height int")
    got = {r.marker_id: (r.y, r.exact) for r in layout.marker_matches(w, m).where("height >= 8").collect()}
    assert got["repeats"] == (0.0, True) and got["distinct"] == (1000.0, True) and "none" not in got
    spread = layout.marker_matches(w.withColumn("y", w.y % 400), m).collect()  # a run over many lines is higher than a marker may be
    assert {r.marker_id for r in spread} >= {"exact", "fuzzy"} and {r.marker_id: r.exact for r in spread}["fuzzy"] is False


def test_names_that_are_nearly_equal_are_one(spark):
    schema = "patient_id int, name string, value string, sources array<string>"
    known = spark.createDataFrame([(1, "Metformin", "a", ["s1"]), (1, "Aspirin", "b", ["s1"]), (2, "Metformin", "c", ["s1"]), (None, "Metformin", "n", ["s1"]), (1, None, "x", ["s9"])], schema)
    fresh = spark.createDataFrame([(1, " metfromin ", None, ["s2"]), (1, "METFORMINE", "d", ["s3"]), (1, "ibuprofen", "e", ["s2"])], schema)
    got = sorted((r.patient_id or 0, r.name_key or "", sorted(r.names), r.value, r.sources, r.touched) for r in records.merged_by_similar_name(known, fresh, threshold=0.75).collect())
    assert got == [
        (0, "metformin", ["metformin"], "n", ["s1"], False), (1, "", [], "x", ["s9"], False), (1, "aspirin", ["aspirin"], "b", ["s1"], False),
        (1, "ibuprofen", ["ibuprofen"], "e", ["s2"], True), (1, "metformin", ["metformin", "metformine", "metfromin"], "d", ["s1", "s2", "s3"], True),
        (2, "metformin", ["metformin"], "c", ["s1"], False),
    ]


def test_grams_are_numbered_and_ranked_in_their_row(spark):
    rows = spark.createDataFrame([(i, t, True, True) for i, t in enumerate(["aaaaa", "abab", "", "xyz"])], "sid long, text string, is_left boolean, is_right boolean")
    grams = similar.padded_grams(rows.text, 3)
    found = similar._prefixes(rows, grams, similar.F.lit(100), [], True)
    got = sorted((r.sid, r.gram, r.nth, r["size"]) for r in found.collect())
    want = []
    for i, t in enumerate(["aaaaa", "abab", "", "xyz"]):
        full, seen = "\u0001\u0001" + t + "\u0002\u0002", []
        for at in range(len(t) + 2):
            seen.append(full[at : at + 3])
            want.append((i, seen[-1], seen.count(seen[-1]), len(t) + 2))
    assert got == sorted(want)
    tables, keep = [], similar.written
    try:
        similar.written = lambda df: tables.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
        similar._prefixes(rows, grams, similar.F.lit(2), [], True)
    finally:
        similar.written = keep
    assert tables and not any(n in p for p in tables for n in ("Window", "Aggregate", "Exchange"))  # no task gathers grams
