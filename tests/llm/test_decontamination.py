import random
import re

import pytest

from larkspur.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, width):
    """Every window of every item against every place of every text."""
    keys = {}
    for item, *texts in items:
        for text in texts:
            w = WORD.findall((text or "").translate(LOWER))
            for i in range(max(1, len(w) - width + 1)) if w else ():
                keys.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        at = [(m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]
        w = tuple(WORD.findall((text or "").translate(LOWER)))
        hit, found = set(), set()
        for n in {len(k) for k in keys}:
            for i in range(len(w) - n + 1):
                if w[i : i + n] in keys:
                    hit |= set(range(i, i + n))
                    found |= keys[w[i : i + n]]
        starts = [i for i in sorted(hit) if i - 1 not in hit]
        runs = [(i, next(j for j in range(i, len(w) + 1) if j not in hit)) for i in starts]
        spans = [(a, b, at[a][0], at[b - 1][1]) for a, b in runs]
        out.append((doc, len(w), len(hit), len(found), sorted(found), spans, bool(hit)))
    return sorted(out, key=str)


def got(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    names = ["text", "answer"][: len(items[0]) - 1] if items else ["text"]
    i = spark.createDataFrame(items, "item_id long, " + ", ".join(f"{n} string" for n in names))
    rows = D.contaminated(d, i, item_texts=tuple(names), **settings).collect()
    return sorted(((*r[:4], list(r.items), [tuple(s) for s in r.spans], r.contaminated) for r in rows), key=str)


def invented(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice(["a", "B", "cé", "日本", "D4", "ſ"]) + rng.choice([" ", ", ", "\n", "-", "  "]) for _ in range(n))
    return [(i, say(rng.randrange(40))) for i in range(60)], [(i, say(rng.randrange(7))) for i in range(25)]


@pytest.mark.parametrize("width,chunk", [(1, 1 << 22), (3, 1), (3, 7), (4, 64), (10, 20)])
def test_agrees_with_every_place(spark, width, chunk):
    docs, items = invented(width * 100 + chunk)
    assert got(spark, docs, items, width=width, chunk=chunk) == plain(docs, items, width)


def test_more_pairs_than_one_automaton_takes(spark):
    docs, items = invented(5)
    docs += [(i, docs[0][1]) for i in range(3)]  # ids that repeat
    assert got(spark, docs, items, width=3, pairs_limit=7) == plain(docs, items, 3) == got(spark, docs, items, width=3)


def test_nulls_empty_tables_and_answers(spark):
    docs = [(None, "The ANSWER is: forty-two, of course"), (1, None), (2, ""), (3, "..."), (4, "the answer is"), (4, "forty two")]
    items = [(7, "Say: the answer is", "Forty two"), (None, None, "of course"), (8, "...", None), (7, "is forty", "")]
    found = got(spark, docs, items, width=4)
    assert found == plain(docs, items, 4)
    assert {r[0]: r[4] for r in found}[None] == ["", "7"]
    assert got(spark, [], items) == [] and all(not r[6] for r in got(spark, docs, []))


def test_spans_are_places_of_the_original_and_long_texts_go_by_pieces(spark):
    question = "What  is\tthe - größte Stadt?"
    filler = "Ünrelated wörds stand here, " * 40_000
    text = filler + "WHAT is the... größte Stadt" + " " + filler
    ((_, n, hit, _, _, ((_, _, start, end),), _),) = got(spark, [(1, text)], [(1, question)], chunk=1 << 16)
    assert text[start:end] == "WHAT is the... größte Stadt" and n == 320_005 and hit == 5


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, row long, item string")
    i = spark.createDataFrame([(1, "a", "y", 3)], "item_id long, text string, win string, doc_id long")
    assert [tuple(r)[:3] for r in D.contaminated(d, i).collect()] == [(1, 2, 1)]
