"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, read, shown_id, slices, text_bytes
from .words import span_hashes, word_spans

#: Hashed character trigrams, latent dimensions, neighbours that vote, and how fast a vote falls with the angle.
TERMS, LATENT, NEIGHBOURS, SHARPNESS = 2048, 64, 15, 20
#: Labelled documents of each class that are learnt from, at most: the documented bound of the sample.
SAMPLE_PER_CLASS = 1500


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed byte trigrams, a row a text; then of words, and of words that repeat the one before them.

    Digits count as one, so that no term is an identity.
    """
    body, offsets = text_bytes(texts)
    starts, ends, of_text = word_spans(body, offsets)
    words = span_hashes(body, starts, ends)
    again = np.append(0, np.cumsum(np.append(False, words[1:] == words[:-1]))[: len(words)])
    first = np.minimum(of_text[:-1] + 1, of_text[1:])
    extra = np.stack([np.diff(of_text), again[of_text[1:]] - again[first]], axis=1)
    return np.concatenate([_trigrams(body, offsets), extra], axis=1)


def _trigrams(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    table = np.arange(256, dtype=np.uint32)
    table[48:58] = 48
    b = table[body]
    if len(b) < 3:
        return np.zeros((n, TERMS), np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))[: len(code)]
    inside = np.arange(len(code)) + 3 <= offsets[row + 1]  # no trigram crosses texts
    return np.bincount(row[inside] * TERMS + code[inside], minlength=n * TERMS).reshape(-1, TERMS)


class Neighbours:
    """Latent vectors of labelled documents; ``scores`` votes on others."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        self.labels, self.weights = labels.astype(np.float32), weights.astype(np.float32)
        self.prior = float((weights * labels).sum() + 1) / float(weights.sum() + 1)
        if not len(labels):
            return
        self.idf = np.log((1 + len(counts)) / (1 + (counts[:, :TERMS] > 0).sum(axis=0))).astype(np.float32) + 1
        weighted = self._weighted(counts)
        # randomised singular value decomposition with fixed probes
        probe = np.random.Generator(np.random.PCG64(7)).standard_normal((TERMS, LATENT + 16)).astype(np.float32)
        for _ in range(3):
            probe = np.linalg.qr(weighted.T @ (weighted @ probe))[0]
        _, _, turn = np.linalg.svd(weighted @ probe, full_matrices=False)
        self.axes = (probe @ turn.T)[:, :LATENT]
        self.vectors = self._latent(counts)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts[:, :TERMS].astype(np.float32)) * self.idf)

    def _latent(self, counts: np.ndarray) -> np.ndarray:
        """Half of a cosine is that of the latent semantic vectors, half that of how repetitive the texts are."""
        repeats = counts[:, TERMS + 1 :] / np.maximum(counts[:, TERMS : TERMS + 1], 1)
        plain = np.sqrt(1 - repeats**2)
        return np.concatenate([self._unit(self._weighted(counts) @ self.axes), repeats, plain], axis=1).astype(np.float32) / np.sqrt(2).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """For each document the similarity-weighted share of label 1 among its nearest labelled ones."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = self._latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** SHARPNESS * self.weights[best]
        told = votes.sum(axis=1)
        score = ((votes * self.labels[best]).sum(axis=1) + 0.01 * self.prior) / (told + 0.01)
        return np.where(counts[:, :TERMS].any(axis=1), score, self.prior).astype(float).round(6)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Neighbours:
    """Learn from at most ``per_class`` labelled rows of each class, taken by the hash of their id.

    The vote of a class is weighted by how many of its labelled rows a sampled one stands for.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    ).distinct()
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = None
    for q in sizes:
        some = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return Neighbours(np.zeros((0, TERMS + 2)), np.zeros(0), np.zeros(0))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [c.astype("<u4").tobytes() for c in term_counts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(rows)], ["doc_id", "quality", "counts"])

    # of rows that repeat an id one text is learnt from; what is broadcast has 2 * per_class rows at most
    some = id_text(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = some.mapInArrow(count, "doc_id long, quality int, counts binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["quality"], bytes(r["counts"])))
    have = {q: sum(r["quality"] == q for r in rows) for q in sizes}
    counts = np.array([np.frombuffer(r["counts"], "<u4") for r in rows]).reshape(-1, TERMS + 2)
    return Neighbours(counts, np.array([r["quality"] for r in rows]), np.array([sizes[r["quality"]] / have[r["quality"]] for r in rows]))


def scored(batch: pa.RecordBatch, model: Neighbours) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in slices(batch, limit=1 << 20):
        for at in range(0, part.num_rows, 512):
            some = part.slice(at, 512)
            yield some, model.scores(term_counts(some.column("text").cast(pa.large_string())))


def quality_scores(docs: DataFrame, model: Neighbours, threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    The model (SAMPLE_PER_CLASS vectors a class at most) goes to every task; each slice of documents meets all of
    it in one exact block of cosine products. Nothing is shuffled. The whole text counts, never labels, language,
    source or id. Texts of less than three bytes, and null, get the share of label 1 among labelled documents; without
    any label that share is 1. Repeated rows are scored each; a null id is shown as null and is not held out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # about 1.5 MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, score in scored(batch, held.value):
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double").withColumn("doc_id", shown_id()).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, model: Neighbours, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, score in scored(batch, held.value):
                yield some.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, read(spark, sf_dir, "labels")))
