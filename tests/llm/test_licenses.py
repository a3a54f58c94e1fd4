import re

from larkspur.llm.licenses import BASE, FAMILIES, WORDING, license_scan, rules

SCHEMA = "doc_id long, text string, words string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(i, k) for k, p in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    line = " " + " ".join(words) + " "
    hits = []
    for i, (_, label, p, priority, c) in enumerate(rules()):
        if priority:
            hits += [(line[: m.start()].count(" ") - 1, line[: m.end()].count(" "), priority, i, label, c) for m in re.finditer(f"(?<= )(?:{p})(?= )", line)]
    left = [h for h in hits if not any(o[0] <= h[0] and o[1] >= h[1] and o[2] <= h[2] and (o[:3] != h[:3] or o[3] < h[3]) for o in hits)]
    base = sorted({k for _, k in at})
    labels = sorted({*base, *(h[4] for h in left)})
    score = max([0.9] * bool(at) + [h[5] for h in left], default=0)
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score


def check(df, texts):
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == brute(texts[r.doc_id]), (r, brute(texts[r.doc_id]))
    return rows


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(license_scan(docs), {r.doc_id: r.text for r in docs.collect()})


def test_edge_cases(spark):
    texts = [None, "", "CC BY cc-by CC-BY-SA 4.0 cc by", "All Rights Reserved. all rights reserved", "GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
             "Licensed under the Apache License, Version 2.0.", "mit license MIT License", "É all\nrights\treserved İ", "word " * 40000 + "cc by", "cc by " * 300, "reserved rights all", "licensed under the mit license"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r.labels for r in check(license_scan(docs), dict(enumerate(texts)))}
    assert rows[5] == "cc-by,cc-by-nc" and rows[6] == "apache-2.0" and rows[4] == "gpl,gpl-3.0"
    assert license_scan(docs.limit(0)).count() == 0
    assert license_scan(spark.createDataFrame([(None, "cc by"), (1, "x"), (1, "x")], "doc_id long, text string")).count() == 3


def test_hundreds_of_rules():
    assert len(rules()) > 200 and len({(r[1], r[2]) for r in rules()}) == len(rules())


def said(pattern):
    """A few texts that a pattern without nested alternatives matches: all of its alternatives, with and without the optional parts."""
    parts, depth, at = [""], 0, 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    for p in parts:
        for optional in ("", r"\1"):
            t = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)[?*]", optional, p)
            t = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?:\{1,20\})?", r"\1", t.replace("[^ ]+", "name"))
            t = re.sub(r".\?", lambda m: m[0][0] if optional else "", t.replace("[0-9]", "7")) if "?" in t else t.replace("[0-9]", "7")
            yield p, t


def test_every_alternative_passes_its_own_gate(spark):
    named = [(label, p, t) for label, (_, name) in FAMILIES.items() for p, t in said(name)]
    worded = [(label, p, t) for label, _, wording, _ in WORDING for p, t in said(wording)]
    cases = sorted({(label, t) for label, p, t in named + worded if re.fullmatch(p, t)})
    alternatives = {(label, p) for label, p, t in named + worded}
    assert alternatives == {(label, p) for label, p, t in named + worded if re.fullmatch(p, t)}  # each is tried
    docs = spark.createDataFrame([(i, t.title(), "") for i, (_, t) in enumerate(cases)], SCHEMA)
    rows = check(license_scan(docs), {i: t.title() for i, (_, t) in enumerate(cases)})
    for r in rows:
        assert r.labels and r.score > 0, cases[r.doc_id]


def test_long_names_and_wording(spark):
    texts = ["Creative Commons Zero", "Do What The Fuck You Want To Public License",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
             "Redistribution and use in source and binary forms, with or without modification, are permitted"]
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r.labels for r in check(license_scan(docs), dict(enumerate(texts)))}
    assert rows == {0: "cc0", 1: "wtfpl", 2: "mit", 3: "bsd"}


#: A phrase and the labels it has, with the base ones.
LABELS = {
    "CC BY 4.0": "cc-by,cc-by-4.0", "CC BY 3.0": "cc-by,cc-by-3.0", "CC-BY 2.5": "cc-by,cc-by-2.5", "licensed under CC BY 2.0": "cc-by,cc-by-2.0", "CC BY 1.0": "cc-by,cc-by-1.0",
    "CC BY": "cc-by", "available under CC BY.": "cc-by", "CC BY-SA 3.0": "cc-by,cc-by-sa", "Artistic License": "artistic", "Artistic License 2.0": "artistic-2.0",
    "the Artistic License, version 1.0": "artistic-1.0", "Apache License": "apache", "Apache License 1.1": "apache-1.1", "Apache Software License, Version 1.0": "apache-1.0",
    "Apache License, Version 2.0": "apache-2.0", "Apache License v2": "apache-2.0", "Apache License v2.0": "apache-2.0", "Apache 2.0": "apache-2.0", "Apache License 3.0": "apache",
    "GNU Affero General Public License": "agpl,gpl", "GNU Affero General Public License v3": "agpl-3.0,gpl", "GNU Lesser General Public License": "gpl,lgpl",
    "GNU Lesser General Public License version 2.1": "gpl,lgpl-2.1", "Mozilla Public License": "mpl", "Mozilla Public License 2.0": "mpl-2.0", "Eclipse Public License - v 1.0": "epl-1.0",
    "X11 License": "x11", "MIT License": "mit", "GNU General Public License": "gpl", "GNU General Public License, version 2": "gpl,gpl-2.0",
}


def test_each_name_has_the_label_of_its_version(spark):
    phrases = list(LABELS)
    docs = spark.createDataFrame([(i, f"It says: {t}; and more.", "") for i, t in enumerate(phrases)], SCHEMA)
    assert {phrases[r.doc_id]: r.labels for r in license_scan(docs).collect()} == LABELS


def test_very_many_detections_take_linear_time(spark):
    import time

    text = "licensed under the mit license " * 30_000
    docs = spark.createDataFrame([(1, text, "")], SCHEMA)
    license_scan(docs.limit(0)).count()
    began = time.time()
    row = license_scan(docs).head()
    assert time.time() - began < 60
    assert row.labels == "mit" and row.n_words == 150_000
