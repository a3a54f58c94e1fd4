"""Packing token sequences by cutting-stock column generation."""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_text, read, shown_id, slices, text_bytes
from .words import CachedEncoder

#: Pieces that are ranked together, about, and at most eight times as many of one length.
PART_ROWS = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Words on which normalising is lower-casing alone, and characters that white space classes disagree on.
PLAIN = re.compile("[\x00-\u024f]*")
ODD = re.compile("[\x1c-\x1f]")
# fixed values: the pre-tokenizer's pattern and the normalizer's steps in the vocabulary file
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = ["NFC", "Replace", "Lowercase"]


class WordEncoder(CachedEncoder):
    """Ids of texts by a tokenizer that drops white space and joins nothing across it.

    Each distinct word is encoded once: words are told apart by 64-bit hashes, and the ids of up to ``remember``
    words are kept in flat arrays for later slices, which gives the ids of whole texts at a fraction of the time.
    Where the vocabulary file has the known normalizer and pattern, plain words go straight to its BPE model; all
    other words, and all words of another file, go through the whole tokenizer.
    """

    def __init__(self, path: str, remember: int = 1_500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        super().__init__(remember)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            told = json.load(f)
        steps = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        pattern = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.plain = steps == STEPS and pattern == PATTERN
        self.split = regex.compile(PATTERN).findall
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [i for i in range(256) if i not in shown]
        self.letters = {i: chr(i) for i in shown} | {i: chr(256 + k) for k, i in enumerate(hidden)}
        self.parts: dict[str, list[int]] = {}

    def _part(self, part: str) -> list[int]:
        ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        if len(self.parts) < 100_000 and len(part) < 20:
            self.parts[part] = ids
        return ids

    def encode_new(self, words: list[bytes]) -> list[list[int]]:
        return self._words([w.decode() for w in words])

    def _words(self, words: list[str]) -> list[list[int]]:
        whole, out, known, part = [], [], self.parts.get, self._part
        for w in words:
            if self.plain and w.isalpha() and (w.isascii() or PLAIN.fullmatch(w) and is_normalized("NFC", w)):
                w = w.lower()
                out.append(known(w) or part(w))
            elif self.plain and PLAIN.fullmatch(w) and is_normalized("NFC", w) and "<|" not in w and not ODD.search(w):
                out.append([i for p in self.split(w.lower()) for i in known(p) or part(p)])
            else:
                whole.append(len(out))
                out.append([])
        if whole:
            for k, e in zip(whole, self.tokenizer.encode_batch([words[k] for k in whole], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder a Python worker: later tasks find its vocabulary loaded and its words remembered."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, budget: int, grain: int) -> DataFrame:
    """Each document's ids cut into pieces of ``budget``, one multiple of ``grain`` and one shorter rest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # lists of numbers make no cycles, and looking for some takes a tenth of the time
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                rows = []
                ids, upto = encoder.encode(*text_bytes(part.column("text")))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), upto[:-1], upto[1:], strict=True):
                    own, n = np.append(ids[a:b], np.uint32(end_id)).astype("<u4"), int(b - a) + 1
                    whole, rest = n - n % budget, n % budget
                    marks = [*range(0, whole + 1, budget), whole + rest - rest % grain, n]
                    for a, b in zip(marks, marks[1:], strict=False):
                        if b > a:
                            rows.append((doc, a, b - a, zlib.crc32(own[a:b].tobytes()), n))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(run, PIECES)


def best_pattern(worth: np.ndarray, lengths: np.ndarray, budget: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the copies of each length that fit the budget and are worth most."""
    best, steps = np.zeros(budget + 1), []
    for k, (w, s) in enumerate(zip(worth, lengths.tolist(), strict=True)):
        n = 1
        while n * s <= budget:  # copies in powers of two, so that any number of them is a sum
            gain = best[: -n * s] + n * w
            better = gain > best[n * s :] + 1e-12
            if better.any():
                best[n * s :][better] = gain[better]
                steps.append((k, n, better))
            n *= 2
    copies, c = np.zeros(len(lengths)), budget
    for k, n, better in reversed(steps):
        if c >= n * lengths[k] and better[c - n * lengths[k]]:
            copies[k] += n
            c -= n * lengths[k]
    return best[budget], copies


def plan_patterns(lengths: list[int], demand: list[int], budget: int, gap: float = 0.0005) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) that use up the demand of every length: column generation, then rounding.

    The linear program minimises the number of sequences; a knapsack prices new columns by its duals until none
    pays or the value is within ``gap`` of the bound by total length. Rounded-down patterns leave less than one
    sequence for each length; those rests are filled largest first. The size of all this depends on the number
    of lengths only, not on that of documents.
    """
    size, need = np.array(lengths), np.array(demand, float)
    order = np.argsort(size)
    size, need = size[order], need[order]
    basis = np.diag((budget // size).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    times = inverse @ need
    for _ in range(8 * len(size)):
        if times.sum() <= (need @ size) / budget * (1 + gap) + 1:
            break
        value, column = best_pattern(inverse.sum(axis=0), size, budget)
        if value <= 1 + 1e-9:
            break
        turn = (inverse * column).sum(axis=1)
        ratio = np.where(turn > 1e-9, np.maximum(times, 0) / np.where(turn > 1e-9, turn, 1), np.inf)
        r = int(np.argmin(ratio))
        basis[:, r] = column
        row = inverse[r] / turn[r]
        inverse -= turn[:, None] * row
        inverse[r] = row
        times = (inverse * need).sum(axis=1)
    out, left = [], np.array(demand)[order].astype(int)
    for column, n in zip(basis.T, np.floor(np.maximum(times, 0) + 1e-9).astype(int), strict=True):
        used = column.round().astype(int)
        n = min([n, *(left[used > 0] // used[used > 0])])
        if n > 0:
            left -= n * used
            out.append((int(n), {int(s): int(k) for s, k in zip(size, used, strict=True) if k}))
    while left.any():
        room, used = budget, {}
        for i in range(len(size) - 1, -1, -1):
            if k := min(left[i], room // size[i]):
                used[int(size[i])] = int(k)
                room -= k * size[i]
        n = min(int(left[np.searchsorted(size, s)]) // k for s, k in used.items())
        for s, k in used.items():
            left[np.searchsorted(size, s)] -= n * k
        out.append((n, used))
    return out


def pack(
    docs: DataFrame, tokenizer_path: str, budget: int = 4096, end_id: int = 2, grain: int = 64,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``. It is cut into whole sequences, one multiple of ``grain`` and one
    rest below it, so that at most budget/grain + grain lengths occur and their histogram has a bounded size
    whatever the input. ``plan_patterns`` decides what stands in a sequence; pieces are ranked within their length
    (in independent parts of about PART_ROWS rows, joined up by their counts) and the rank gives sequence and offset.
    Texts are read once and never shuffled; only pieces are.

    Null or empty text is ``end_id`` alone; rows that repeat an id are packed each; a null id is shown as null. An
    empty table gives an empty result. The last sequences, fewer than the lengths, may have padding.
    """
    pieces = cut(token_pieces(id_text(docs, id_col, text_col), tokenizer_path, end_id, budget, grain))
    parts = 1 + pieces.count() // PART_ROWS
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(8 * parts)).cast("int")
    pieces = pieces.withColumn("part", part)
    counts = pieces.groupBy("length", "part").count()
    held = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    patterns = plan_patterns(list(held), list(held.values()), budget) if held else []
    blocks: dict[int, list[tuple[int, ...]]] = {s: [] for s in held}  # length -> (end rank, times, copies, sequence, offset)
    base = 0
    for times, used in patterns:
        offset = 0
        for s, k in sorted(used.items(), reverse=True):
            before = blocks[s][-1][0] if blocks[s] else 0
            blocks[s].append((before + times * k, times, k, base, offset))
            offset += s * k
        base += times
    tables = {s: np.array(b, np.int64) for s, b in blocks.items()}

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                own, table = length == s, tables[int(s)]
                b = table[np.searchsorted(table[:, 0], rank[own], "right")]
                r = rank[own] - (b[:, 0] - b[:, 1] * b[:, 2])
                sequence[own], offset[own] = b[:, 3] + r // b[:, 2], b[:, 4] + r % b[:, 2] * s
            batch = batch.drop_columns(["rank"])
            yield batch.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    running = F.sum("count").over(Window.partitionBy("length").orderBy("part"))
    starts = counts.select("length", "part", (running - F.col("count")).alias("before"))
    in_part = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("n", F.row_number().over(in_part))
        .join(starts, ["length", "part"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("n") - 1).alias("rank"))
    )
    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long").select(
        shown_id(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), word_bpe_path())
