"""Removal of repeated substrings by prefix doubling over the positions that a sample of ranks leaves open."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_text, mix64, random_words, read, shown_id, slices, text_bytes

#: Bytes of the first ranks; positions are sampled by their least rank in each string of the wanted length.
FIRST = 32
#: Bytes of the ranks that doubling begins with.
SECOND = 64
#: Shares of the rank pairs that are sorted one after the other, so that disk holds one share's shuffle at a time.
SHARES = 2
_BYTE = random_words(301, 256), random_words(302, 256)
_BASE = (int(random_words(303, 1)[0]) | 1, int(random_words(304, 1)[0]) | 1)


class Ranges:
    """Hashes of any ranges of some bytes, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, body: np.ndarray, which: int) -> None:
        base = np.uint64(_BASE[which])
        inverse = np.uint64(pow(_BASE[which], -1, 2**64))
        n = len(body) + 1
        ones = np.ones(1, np.uint64)
        self.unpower = np.cumprod(np.concatenate([ones, np.full(n - 1, inverse)]), dtype=np.uint64)
        power = np.cumprod(np.concatenate([ones, np.full(n - 1, base)]), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[which][body] * power[:-1], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.unpower[starts])


def samples(body: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts that sample the same position: (text, first start, last start, sampled position, its rank).

    A string of ``length`` bytes samples the position of the least FIRST-byte rank within it, the leftmost of equal
    ones; so equal strings sample the same place, and neighbouring strings mostly share theirs.
    """
    size = min(FIRST, length)
    width, n = length - size + 1, len(body) - size + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if n < width:
        return none
    at = np.arange(n)
    rank = Ranges(body, 0).of(at, at + size)
    low, place, have = rank, at.astype(np.int32), 1
    while have < width:  # minima over doubling widths, the last one overlapping
        step = min(have, width - have)
        other = low[step:] < low[: len(low) - step]
        place = np.where(other, place[step:], place[: len(place) - step])
        low = np.where(other, low[step:], low[: len(low) - step])
        have += step
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    inside = np.flatnonzero(at[: len(place)] + length <= offsets[text + 1])
    if not len(inside):
        return none
    place, text = place[inside].astype(np.int64), text[inside]
    fresh = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(inside)) - 1
    return text[first], inside[first], inside[last], place[first], rank[place[first]]


def once(part: pa.RecordBatch) -> pa.RecordBatch:
    """``part`` with one row of each (doc_id, tag)."""
    both = np.stack([part.column(c).to_numpy() for c in ("doc_id", "tag")], axis=1)
    rows = np.sort(np.unique(both, axis=0, return_index=True)[1])
    return part if len(rows) == part.num_rows else part.take(pa.array(rows))


def sampled_runs(rows: DataFrame, length: int) -> DataFrame:
    """(rank, span, span2, doc_id, tag, first, more, known): each run of starts, by the rank that it samples.

    ``span`` and ``span2`` are hashes of all bytes that the run's strings cover. A run that its slice of texts has
    before is ``known`` to be covered; it gets a rank of its own, so that many copies do not meet.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in map(once, slices(batch)):
                body, offsets = text_bytes(part.column("text"))
                ids, tags = part.column("doc_id").to_numpy(), part.column("tag").to_numpy()
                text, first, last, place, rank = samples(body, offsets, length)
                if not len(text):
                    continue
                # all strings of a run together: their span, and where in it the sampled position lies
                shape = mix64(((place - first) * (length + 1) + (last - first)).astype(np.uint64))
                span, span2 = (Ranges(body, k).of(first, last + length) + shape for k in (1, 0))
                first, last = first - offsets[text], last - offsets[text]
                # of runs that a slice repeats only the earliest is compared further; the others are covered
                order = np.lexsort((first, tags[text], ids[text], span2, span, rank))
                again = np.append(False, np.all([x[order][1:] == x[order][:-1] for x in (rank, span, span2)], axis=0))
                known = np.zeros(len(text), bool)
                known[order] = again
                own = mix64(rank + (np.arange(len(rank)).astype(np.uint64) + np.uint64(1)) * random_words(305, 1)[0] + np.uint64(int(ids[0]) % 2**63))
                rank = np.where(known, own, rank)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (rank, span, span2)), pa.array(ids[text]), pa.array(tags[text]), pa.array(first),
                     pa.array((last - first).astype(np.int32)), pa.array(known)],
                    ["rank", "span", "span2", "doc_id", "tag", "first", "more", "known"],
                )

    return rows.mapInArrow(scan, "rank long, span long, span2 long, doc_id long, tag long, first long, more int, known boolean")


def rank_pairs(rows: DataFrame, runs: DataFrame, width: int, offset: int, share: int) -> DataFrame:
    """(rank1, rank2, doc_id, tag, at): for each start of the runs the ranks of ``width`` bytes at it and ``offset`` behind it, of those
    whose first rank falls into one of SHARES equal shares.

    Ranks are content hashes, so that a position needs no rank from another row. Where two ranks cover what is
    compared, each is mixed of both hashes.
    """

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 19):
                body, offsets = text_bytes(part.column("text"))
                runs = part.column("runs")
                flat, of = runs.flatten(), np.repeat(np.arange(len(runs)), np.asarray(runs.value_lengths()))
                first, more = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
                each = more + 1
                at = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                text = np.repeat(of, each)
                here, one, two = at + offsets[text], Ranges(body, 0), Ranges(body, 1)
                rank1 = two.of(here, here + width) ^ mix64(one.of(here, here + width))
                own = np.flatnonzero(rank1 % np.uint64(SHARES) == share)
                at, text, here, rank1 = at[own], text[own], here[own] + offset, rank1[own]
                rank2 = two.of(here, here + width) + one.of(here, here + width)
                ids, tags = part.column("doc_id").to_numpy(), part.column("tag").to_numpy()
                for i in range(0, len(at), 200_000):
                    own = slice(i, i + 200_000)
                    columns = [rank1[own].view(np.int64), rank2[own].view(np.int64), ids[text[own]], tags[text[own]], at[own]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["rank1", "rank2", "doc_id", "tag", "at"])

    by_text = runs.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "more")).alias("runs"))
    texts = rows.join(by_text.hint("merge"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "runs")
    return texts.mapInArrow(pairs, "rank1 long, rank2 long, doc_id long, tag long, at long")


def covered_spans(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, tag, start, upto): bytes of (doc_id, tag, text) covered by strings of ``length`` that also start earlier."""
    by_span = Window.partitionBy("rank", "span", "span2").orderBy("doc_id", "tag", "first")
    by_rank = Window.partitionBy("rank")
    # sorted by rank, then by span: unique ranks end here, repeated spans are covered, the first of each goes on
    found = sampled_runs(rows, length).withColumn("n", F.rank().over(by_span))
    found = found.withColumn("low", F.min("span").over(by_rank)).withColumn("high", F.max("span").over(by_rank))
    ranked = cut(
        found.where("known OR n > 1 OR low <> high").select("doc_id", "tag", "first", "more", (F.col("known") | (F.col("n") > 1)).alias("covered"))
    )
    spans = ranked.where("covered").select("doc_id", "tag", F.col("first").alias("start"), (F.col("first") + F.col("more") + length).alias("upto"))
    left, width = ranked.where("NOT covered").select("doc_id", "tag", "first", "more"), min(SECOND, length)
    while 2 * width < length:
        by_pair = Window.partitionBy("rank1", "rank2")
        met = (rank_pairs(rows, left, width, width, k).withColumn("n", F.count("*").over(by_pair)).where("n > 1") for k in range(SHARES))
        left, width = reduce(DataFrame.union, [cut(m.select("doc_id", "tag", F.col("at").alias("first"), F.lit(0).alias("more"))) for m in met]), 2 * width
    by_pair = Window.partitionBy("rank1", "rank2").orderBy("doc_id", "tag", "at")
    late = (rank_pairs(rows, left, width, length - width, k).withColumn("n", F.rank().over(by_pair)).where("n > 1") for k in range(SHARES))
    return reduce(DataFrame.union, [cut(x.select("doc_id", "tag", F.col("at").alias("start"), (F.col("at") + length).alias("upto"))) for x in late], spans)


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a row with a smaller id, or
    earlier in the same text. Strings are judged on the input and never cross texts.

    Prefix doubling: (1) FIRST-byte ranks of all positions, of which each string samples the least; Spark sorts the
    samples by rank, and those with a unique rank end there; (2) samples of one rank are ranked by the whole span of
    strings they stand for: equal spans are decided at once; (3) the starts of strings whose spans differ around a
    shared sample go on one by one: Spark sorts the pairs of their ranks at offsets that double from SECOND bytes,
    those with a unique pair end there, until two ranks cover ``length``; then equal pairs are equal strings. Ranks
    are 64-bit content hashes, so a position never waits for the ranks of others; a decision takes two hashes to agree.
    Within a slice repeated spans are decided before the shuffle, which keeps a group of copies that holds much of
    the input from meeting in one task.

    Null text is empty. A null id sorts first and is shown as null. Rows that repeat an id come in the order of a
    hash of their texts; of rows that repeat both, one stands for all, and one keeps what this one keeps: the
    others lose all bytes, or none if they are shorter than ``length``. An empty table gives an empty result.
    """
    if length < 1:
        raise ValueError("length must be positive")
    rows = id_text(docs, id_col, text_col)
    # a tag tells rows of one id apart; where no id repeats it is 0 and takes no room
    repeated = bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).count())
    rows = rows.withColumn("tag", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    spans = covered_spans(rows, length)
    spans = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "upto")).alias("spans"))

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, tag, text, spans in zip(*(batch.column(c) for c in ("doc_id", "tag", "text", "spans")), strict=True):
                body = np.frombuffer(text.as_py().encode(), np.uint8)
                mark = np.zeros(len(body) + 1, np.int32)
                if spans.is_valid:
                    for i, by in ((0, 1), (1, -1)):
                        where = np.minimum(np.asarray(spans.values.field(i)), len(body))
                        np.add.at(mark, where, by)
                gone = np.cumsum(mark[:-1]) > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((doc.as_py(), tag.as_py(), len(body), int(gone.sum()), runs, hashlib.sha256(body[~gone].tobytes()).hexdigest()))
            if out:
                names = ["doc_id", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 5 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names)

    joined = rows.join(spans.hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "spans")
    done = joined.mapInArrow(drop, "doc_id long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if repeated:
        done = cut(done.withColumn("row", F.monotonically_increasing_id()))
        heads = done.groupBy("doc_id", "tag").agg(F.min("row").alias("head"))
        lost = (F.col("row") > F.col("head")) & (F.col("n_bytes") >= length)
        done = done.join(heads, ["doc_id", "tag"]).select(
            "doc_id", "n_bytes", F.when(lost, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(lost, 1).otherwise(F.col("n_spans")).alias("n_spans"), F.when(lost, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        )
    return done.select(shown_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"))
