"""Benchmark decontamination: one automaton over the windows of all test items, one scan of each text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, slices, text_bytes

#: Words of a window.
WINDOW = 10
#: Pairs of window and item, and bytes of windows, that one automaton takes. Beyond it texts are scanned once for each share of the pairs.
PAIRS, PAIR_BYTES = 1 << 17, 64 << 20
#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 22

#: Word bytes as they are, A-Z in lower case, all others as spaces: the length stays, so places in the result are places in the text.
NORMAL = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

RUN = "struct<first:bigint,after:bigint,start:bigint,end:bigint>"
FOUND = f"row bigint, doc_id bigint, n_words bigint, runs array<{RUN}>, items array<string>"
_RUN_TYPE = pa.struct([(n, pa.int64()) for n in ("first", "after", "start", "end")])


class Automaton(NamedTuple):
    machine: ahocorasick.Automaton | None
    vocabulary: dict[bytes, int]
    length: list[int]
    items: list[list[str]]


def windows(text: bytes, width: int = WINDOW) -> set[bytes]:
    """The windows of an item's normalised bytes: runs of ``width`` words, or all its words if they are fewer."""
    words = text.split()
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def item_windows(items: DataFrame, id_col: str, text_cols: list[str], width: int) -> DataFrame:
    """(item, win): the distinct windows of each item; its texts (questions, answers) don't run into each other. A null id is ''."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                body, ends = text_bytes(part.column("text"))
                raw, ids = body.tobytes().translate(NORMAL), part.column("item").to_pylist()
                pairs = [(i, w) for i, a, b in zip(ids, ends, ends[1:], strict=False) for w in windows(raw[a:b], width)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.binary())], names=["item", "win"])

    ids = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item")
    texts = items.select(ids, F.explode(F.array(*(F.col(c) for c in text_cols))).alias("text"))
    return texts.mapInArrow(cut_up, "item string, win binary").distinct()


def compiled(pairs: list[tuple[str, bytes]]) -> Automaton:
    """An automaton over the words of windows, each word a number; no other word has one, so 0 leads back to the root."""
    of: dict[bytes, list[str]] = {}
    for item, window in pairs:
        of.setdefault(window, []).append(item)
    vocabulary: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    length = []
    for n, window in enumerate(of):
        words = window.split()
        machine.add_word(tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), n)
        length.append(len(words))
    machine.make_automaton()
    return Automaton(machine if of else None, vocabulary, length, list(of.values()))


_LAST: dict[str, Automaton] = {}


def automaton_of(key: str, sent: Broadcast) -> Automaton:
    """The automaton of broadcast pairs, made once a Python worker; it holds that of the last ``key`` only."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = compiled(sent.value)
    return _LAST[key]


def joined(runs: list[tuple[int, int]], first: int, after: int) -> None:
    """Adds words first to after to sorted runs; windows come in the order of their ends, so only the last runs can meet them."""
    while runs and runs[-1][1] >= first:
        before = runs.pop()
        first, after = min(first, before[0]), max(after, before[1])
    runs.append((first, after))


def pieces_of(text: bytes, chunk: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of runs of a normalised text that end between words."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + chunk)
        end = len(text) if end < 0 else end
        yield at, text[at:end]
        at = end


def scanned(auto: Automaton, text: bytes, width: int, chunk: int = CHUNK) -> tuple[int, list[tuple[int, int]], set[int]]:
    """The number of words of a normalised text, its runs of hit words and the windows that occur. A long text goes by pieces: the next one
    begins again with the last ``width`` - 1 words."""
    n, tail, runs, seen = 0, [], [], set()
    for _, piece in pieces_of(text, chunk):
        words = piece.split()
        if auto.machine is not None:
            ids = tail + list(map(auto.vocabulary.get, words, repeat(0)))
            base = n - len(tail)
            for last, found in auto.machine.iter(tuple(ids)):
                if last >= len(tail):
                    seen.add(found)
                    joined(runs, base + last + 1 - auto.length[found], base + last + 1)
            tail = ids[len(ids) - min(width - 1, len(ids)) :]
        n += len(words)
    return n, runs, seen


def placed(text: bytes, runs: list[tuple[int, int]], chunk: int = CHUNK) -> list[dict[str, int]]:
    """Runs of words with the code points where they start and end in the text itself."""
    starts, ends, words, points = {}, {}, 0, 0
    firsts, lasts = np.array([r[0] for r in runs]), np.array([r[1] - 1 for r in runs])
    for _, piece in pieces_of(text, chunk):
        raw = np.frombuffer(piece, np.uint8)
        full = np.concatenate([[False], raw != 32, [False]])
        begin, stop = np.flatnonzero(full[1:-1] & ~full[:-2]), np.flatnonzero(full[1:-1] & ~full[2:])
        upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) + points
        for wanted, marks, to in ((firsts, begin, starts), (lasts, stop + 1, ends)):
            here = np.flatnonzero((wanted >= words) & (wanted < words + len(begin)))
            to |= zip(here.tolist(), upto[marks[wanted[here] - words]].tolist(), strict=True)
        words, points = words + len(begin), int(upto[-1])
    return [{"first": a, "after": b, "start": starts[i], "end": ends[i]} for i, (a, b) in enumerate(runs)]


def _scan(docs: DataFrame, sent: Broadcast, width: int, chunk: int, all_rows: bool) -> DataFrame:
    """FOUND rows of (row, doc_id, text); without ``all_rows`` only those with a hit."""
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton_of(key, sent)
        for batch in batches:
            for part in slices(batch):
                body, ends = text_bytes(part.column("text"))
                raw, out, kept = body.tobytes().translate(NORMAL), ([], [], []), []
                for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    text = raw[a:b]
                    n, runs, seen = scanned(auto, text, width, chunk)
                    if runs or all_rows:
                        kept.append(i)
                        out[0].append(n)
                        out[1].append(placed(text, runs, chunk) if runs else [])
                        out[2].append(sorted({x for w in seen for x in auto.items[w]}))
                columns = [part.column(c).take(pa.array(kept, pa.int64())) for c in ("row", "doc_id")]
                columns += [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(_RUN_TYPE)), pa.array(out[2], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "runs", "items"])

    return docs.mapInArrow(scan, FOUND)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of several scans of one text become maximal runs."""
    for batch in batches:
        rows = []
        for found in batch.column("runs").to_pylist():
            out: list[dict[str, int]] = []
            for run in sorted(found, key=lambda r: (r["first"], r["after"])):
                if out and out[-1]["after"] >= run["first"]:
                    out[-1] |= {k: max(out[-1][k], run[k]) for k in ("after", "end")}
                else:
                    out.append(dict(run))
            rows.append(out)
        yield batch.set_column(batch.schema.get_field_index("runs"), "runs", pa.array(rows, pa.list_(_RUN_TYPE)))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_texts: tuple[str, ...] = ("text",),
    width: int = WINDOW, pairs_limit: int = PAIRS, chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, contaminated), a row for each document.

    Texts are lower-cased (A-Z) and cut into words: runs of ASCII letters, digits and all other non-ASCII characters. A window is
    ``width`` consecutive words of an item, or all its words if they are fewer; a document's word inside any occurrence of
    a window is hit. ``items`` are the sorted ids, as strings, of items with occurring windows, ``spans`` the maximal runs of hit words: first
    word and the one after the last, and the code points of the text where they start and end.

    The windows of all items make one automaton, sent to all tasks only while it has ``pairs_limit`` pairs of window and item and
    64 MB at most; more pairs are dealt by hash into shares of that size, the documents are scanned once for each share, and the runs of a
    document are merged. No pair and no text is left out, and rows are the same either way.

    A null text has no words, nor has one of other characters only: nothing is hit. A null document id stays null, rows that repeat
    an id count each; a null item id is '' in ``items``, rows that repeat an item's id are one item. Items without words have no window. Long texts go by pieces.
    Other columns are not read. Empty tables: no rows, or no hits.
    """
    spark = docs.sparkSession
    pairs = cut(item_windows(items, item_id, list(item_texts), width))
    size = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("item") + F.length("win")), F.lit(0)).alias("bytes")).first()
    shares = max(1, -(-size.n // pairs_limit), -(-size.bytes // PAIR_BYTES))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def send(share: int) -> Broadcast:
        own = pairs.where(F.pmod(F.xxhash64("item", "win"), F.lit(shares)) == share)
        return spark.sparkContext.broadcast([(r.item, bytes(r.win)) for r in own.collect()])  # a share has a bounded size

    if shares == 1:
        found = _scan(base.withColumn("row", F.lit(0).cast("long")), send(0), width, chunk, True)
    else:
        rows = cut(base.withColumn("row", F.monotonically_increasing_id()))
        found = None
        for share in range(shares):
            part = cut(_scan(rows, send(share), width, chunk, share == 0))
            found = part if found is None else found.unionByName(part)
        found = found.groupBy("row").agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        ).mapInArrow(_merged, FOUND)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["after"] - r["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("runs").alias("spans"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM b, range(1, 100000) AS t(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 9)),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.i, p.n, k.item_id FROM p JOIN k ON k.n = p.n AND k.win = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
