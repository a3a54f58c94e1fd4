"""License scans: ordered signature rules, gated by keywords, with overlapping detections resolved."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, read
from .spans import let, matches, running

#: Complement of a word, in the text as it is (A-Z count as a-z later).
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: label: (keys, parted by |, of which every match of the family has one as words in a row, how the licence is called)
FAMILIES = {
    "apache-2.0": ("apache", "apache(?: software)? license(?: v| version)? ?2 0|apache(?: software)? license(?: v| version)? ?2|apache 2 0"),
    "apache-1.1": ("apache", "apache(?: software)? license(?: v| version)? ?1 1|apache 1 1"),
    "apache-1.0": ("apache", "apache(?: software)? license(?: v| version)? ?1 0|apache 1 0"),
    "apache": ("apache", "apache license|apache software license"),
    "mit": ("licen", "mit license|mit licence|expat license"),
    "x11": ("x11 license", "x11 license"),
    "bsd-3-clause": ("bsd", "bsd 3 clause|new bsd|3 clause bsd|modified bsd"),
    "bsd-2-clause": ("bsd", "bsd 2 clause|simplified bsd|freebsd license"),
    "bsd": ("bsd", "bsd license|bsd style license"),
    "gpl-1.0": ("gnu", "gnu general public license(?: v| version)? ?1(?: 0)?"),
    "gpl-2.0": ("gnu", "gnu general public license(?: v| version)? ?2(?: 0)?|gnu gpl ?v? ?2"),
    "gpl-3.0": ("gnu", "gnu general public license(?: v| version)? ?3(?: 0)?|gnu gpl ?v? ?3"),
    "lgpl-2.1": ("gnu", "gnu lesser general public license(?: v| version)? ?2 1"),
    "lgpl-3.0": ("gnu", "gnu lesser general public license(?: v| version)? ?3(?: 0)?"),
    "lgpl": ("gnu", "gnu lesser general public license"),
    "agpl-3.0": ("affero", "gnu affero general public license(?: v| version)? ?3(?: 0)?|affero general public license(?: v| version)? ?3(?: 0)?"),
    "agpl": ("affero", "gnu affero general public license|affero general public license"),
    "gfdl": ("gnu", "gnu free documentation license"),
    "mpl-1.1": ("mozilla", "mozilla public license(?: v| version)? ?1 1"),
    "mpl-2.0": ("mozilla", "mozilla public license(?: v| version)? ?2 0"),
    "mpl": ("mozilla", "mozilla public license"),
    "epl-1.0": ("eclipse", "eclipse public license(?: v| version)? ?1 0"),
    "epl-2.0": ("eclipse", "eclipse public license(?: v| version)? ?2 0"),
    "epl": ("eclipse", "eclipse public license"),
    "cddl": ("distribution license", "common development and distribution license"),
    "cpl": ("public license", "common public license"),
    "isc": ("isc license", "isc license"),
    "zlib": ("zlib", "zlib license|zlib libpng license"),
    "boost": ("boost software", "boost software license"),
    "artistic-2.0": ("artistic license", "artistic license(?: v| version)? ?2 0"),
    "artistic-1.0": ("artistic license", "artistic license(?: v| version)? ?1 0"),
    "artistic": ("artistic license", "artistic license"),
    "unlicense": ("unlicense", "the unlicense|unlicense org"),
    "wtfpl": ("wtfpl|do what the fuck", "wtfpl|do what the fuck you want to public license"),
    "postgresql": ("postgresql license", "postgresql license"),
    "python": ("license", "python software foundation license|psf license"),
    "ofl": ("font license", "sil open font license|open font license"),
    "odbl": ("odbl", "odbl|open database license odbl"),
    "cc0": ("cc0|creative commons zero", "cc0(?: 1 0)?|creative commons zero"),
    "cc-by-4.0": ("cc by", "cc by 4 0"),
    "cc-by-3.0": ("cc by", "cc by 3 0"),
    "cc-by-2.5": ("cc by", "cc by 2 5"),
    "cc-by-2.0": ("cc by", "cc by 2 0"),
    "cc-by-1.0": ("cc by", "cc by 1 0"),
    "cc-by": ("cc by", "cc by"),
    "cc-by-sa": ("cc by", "cc by sa(?: 4 0| 3 0)?"),
    "cc-by-nc": ("cc by", "cc by nc(?: 4 0| 3 0)?"),
    "cc-by-nd": ("cc by", "cc by nd(?: 4 0| 3 0)?"),
    "cc-by-nc-sa": ("cc by", "cc by nc sa(?: 4 0| 3 0)?"),
    "cc-by-nc-nd": ("cc by", "cc by nc nd(?: 4 0| 3 0)?"),
    "cc-by-attribution": ("attribution", "creative commons attribution(?: 4 0| 3 0| international)*"),
    "public-domain": ("public domain", "(?:dedicated|released|placed) (?:to|into|in) the public domain"),
    "proprietary": ("proprietary", "proprietary and confidential|proprietary software"),
    "copyright": ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
}
#: How a licence is given: (form around the name, priority - the smaller wins, confidence).
FORMS = [
    ("(?:this (?:work|file|program|software|project|text) is )?(?:licensed|released|distributed|published|available|provided) (?:under|by) (?:the )?(?:terms (?:of|and conditions of) (?:the )?)?(?:{})", 1, 1.0),
    ("(?:subject to|governed by|in accordance with|permitted under|covered by) (?:the )?(?:terms of (?:the )?)?(?:{})", 2, 0.95),
    ("spdx license identifier (?:{})", 1, 1.0),
    ("license (?:{})", 3, 0.8),
    ("(?:see|read) (?:the )?(?:{})", 4, 0.7),
    ("(?:{})", 5, 0.6),
]
#: (label, key, wording of the licence's own text, which need not name it, confidence).
WORDING = [
    ("mit", "to any person obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "the software is provided as is", "the software is provided as is without warranty of any kind", 0.7),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd-3-clause", "endorse or promote products", "neither the names? of (?:[^ ]+ ){1,20}may be used to endorse or promote products derived from this software", 0.95),
    ("isc", "this software for any purpose with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("zlib", "in no event will the authors", "in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented", 0.9),
    ("boost", "accompanying documentation covered by this license", "obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("ofl", "font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 1.0),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "you just do what the fuck", "you just do what the fuck you want to", 0.95),
    ("cc0", "related or neighboring rights", "waived all copyright and related or neighboring rights", 0.95),
    ("gpl", "is free software you can redistribute", "(?:this|the) (?:program|library|software) is free software you can redistribute it and or modify it", 0.8),
    ("gpl", "verbatim copies of this license document", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.8),
    ("apache-2.0", "except in compliance with the license", "you may not use this file except in compliance with the license", 0.95),
    ("apache-2.0", "without warranties or conditions of any kind", "(?:distributed )?on an as is basis without warranties or conditions of any kind", 0.9),
    ("apache-2.0", "terms and conditions for use reproduction", "terms and conditions for use reproduction and distribution", 0.9),
    ("mit", "portions of the software", "(?:this|the above copyright notice and this) permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("bsd", "retain the above copyright notice", "redistributions of source code must retain the above copyright notice this list of conditions", 0.95),
    ("bsd", "reproduce the above copyright notice", "redistributions in binary form must reproduce the above copyright notice this list of conditions", 0.95),
    ("bsd", "copyright holders and contributors as is", "this software is provided by the copyright holders and contributors as is", 0.9),
    ("bsd-4-clause", "advertising materials mentioning", "all advertising materials mentioning features or use of this software must display", 1.0),
    ("gpl-2.0", "either version 2 of the license", "either version 2 of the license or at your option any later version", 0.95),
    ("gpl-3.0", "either version 3 of the license", "either version 3 of the license or at your option any later version", 0.95),
    ("gpl", "without even the implied warranty", "without even the implied warranty of merchantability or fitness for a particular purpose", 0.8),
    ("gpl", "you should have received a copy of the gnu", "you should have received a copy of the gnu (?:affero |lesser )?general public license", 0.9),
    ("agpl-3.0", "interacting with it remotely", "all users interacting with it remotely through a computer network", 0.95),
    ("lgpl-2.1", "either version 2 1 of the license", "either version 2 1 of the license or at your option any later version", 0.95),
    ("mpl-2.0", "source code form is subject to", "this source code form is subject to the terms of the mozilla public license", 1.0),
    ("mpl-2.0", "incompatible with secondary licenses", "incompatible with secondary licenses as defined by the mozilla public license", 0.9),
    ("epl-2.0", "accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public license", 1.0),
    ("cddl", "common development and distribution", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("artistic-2.0", "the package", "you may (?:modify your copy of|distribute verbatim copies of the source form of) the package", 0.7),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such", 0.95),
    ("cc-by-attribution", "give appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made", 0.95),
    ("cc-by-sa", "distribute your contributions under the same license", "you must distribute your contributions under the same license as the original", 0.95),
    ("cc-by-nc", "for commercial purposes", "you may not use the material for commercial purposes", 0.9),
    ("cc-by-nd", "distribute the modified material", "you may not distribute the modified material", 0.9),
    ("cc0", "dedicate any and all copyright interest", "dedicate any and all copyright interest in the (?:software|work) to the public domain", 0.95),
    ("odbl", "open database license", "this database is made available under the open database license", 1.0),
    ("python", "psf is making python", "psf is making python available to licensee on an as is basis", 1.0),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("beerware", "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 1.0),
    ("confidential", "contains confidential information", "this (?:document|message|file) contains confidential information", 0.7),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited", 0.95),
    ("proprietary", "may be reproduced", "no part of this (?:publication|book|work|document) may be reproduced", 0.8),
]
#: Priority of WORDING: that of a licence given in full.
WORDING_PRIORITY = 1


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keywords, label, pattern over ' word word ', priority, confidence), in order: families times forms, wording, base.

    Of the keywords, parted by |, every match holds one.
    """
    made = [(k, label, form.format(name), p, c) for label, (k, name) in FAMILIES.items() for form, p, c in FORMS]
    made += [(k, label, wording, WORDING_PRIORITY, c) for label, k, wording, c in WORDING]
    return made + [(phrase, label, phrase, 0, 0.9) for label, phrase in BASE.items()]


def places(words: Column, pattern: Column) -> Column:
    """array<struct<start, end>> in words of the matches of a rule in ' word word ... ' text."""
    count = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    # state: the blanks so far; the first word has one before it, and a match one less than it has words
    starts = lambda found: running(found, F.lit(0), lambda at, x: at + count(x["gap"]) + count(x["match"]), lambda at, x: at + count(x["gap"]) - 1, "int")
    return let(matches(words, pattern), lambda found: F.zip_with(
        found, starts(found), lambda x, a: F.struct(a.alias("start"), (a + count(x["match"]) + 1).alias("end"))))


HIT = "struct<start:int,behind:int,priority:int,rule:int,label:string,confidence:double>"


def unsuppressed(hits: Column) -> Column:
    """Detections (array of HIT; ``behind`` is minus the end) that no other of the same or a stronger priority holds.

    In the order of starts, longer ones first, whatever may hold a detection stands before it, so one sweep that
    remembers the farthest end of each priority decides. Of equal ones the earlier rule stays.
    """
    levels = max(r[3] for r in rules())
    stays = lambda ordered: running(
        ordered, F.array_repeat(F.lit(-1), levels),
        lambda s, x: F.transform(s, lambda e, i: F.when(i + 1 >= x["priority"], F.greatest(e, -x["behind"])).otherwise(e)),
        lambda s, x: F.element_at(s, x["priority"]) < -x["behind"], "boolean",
    )
    return let(F.array_sort(hits), lambda ordered: let(stays(ordered), lambda kept: F.filter(ordered, lambda x, i: F.get(kept, i))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are counted in every whole text. A text that holds none of the rules' keywords is done with that; in the
    others only the rules whose keywords stand there are matched. Of the method's detections one that lies within another of the same or a stronger
    priority goes, unless the two are equal and it is the earlier rule. Base phrases are never suppressed. The
    score is the confidence of the surest detection left. All of it is one projection; nothing is shuffled.

    Null text is empty; rows are told apart by id and text, so rows that repeat both are counted each; a null id
    is shown as null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = rules()
    keys = sorted({k for r in table for k in r[0].split("|")})
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"))
    low = F.lower("text")
    # in the raw text the words of a key may be parted by anything, so each is looked for by itself
    gate = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (low.contains(w) for w in k.split())) for k in keys))
    # matching is done beside the text: an array of detections a row, built only behind the gate
    split = F.transform(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)),
                        lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = F.concat(F.lit(" "), F.array_join(split, " "), F.lit(" "))
    rows = base.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(gate, words).alias("words"))
    detections = F.array(*(F.struct(F.array(*map(F.lit, k.split("|"))).alias("k"), F.lit(lb).alias("label"), F.lit(f"(?<= )(?:{p})(?= )").alias("pattern"), F.lit(pr).alias("priority"), F.lit(c).alias("confidence"), F.lit(i).alias("rule")) for i, (k, lb, p, pr, c) in enumerate(table)))

    def hits(words: Column, r: Column) -> Column:
        at = F.transform(places(words, r["pattern"]), lambda p: F.struct(
            p["start"].alias("start"), (-p["end"]).alias("behind"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].cast("double").alias("confidence")))
        return F.when(F.exists(r["k"], partial(F.contains, words)), at).otherwise(F.array().cast(f"array<{HIT}>"))

    found = F.when(F.col("words").isNotNull(), F.flatten(F.transform(detections, partial(hits, F.col("words"))))).otherwise(F.array().cast(f"array<{HIT}>"))
    rows = rows.withColumn("hits", found)
    rows = rows.withColumn("base", F.filter("hits", lambda h: h["priority"] == 0)).withColumn("more", F.filter("hits", lambda h: h["priority"] > 0))
    rows = rows.withColumn("left", F.when(F.size("more") > 1, unsuppressed(F.col("more"))).otherwise(F.col("more")))
    names = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda h: h["label"]) for c in cols)))), ",")
    starts = F.transform("base", lambda h: h["start"].cast("long"))
    sure = F.coalesce(F.array_max(F.transform(F.concat("base", "left"), lambda h: h["confidence"])), F.lit(0.0))
    return rows.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names("base").alias("base_labels"),
        names("base", "left").alias("labels"), sure.alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))
