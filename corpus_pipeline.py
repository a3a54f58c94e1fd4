"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir); ``run`` writes each result as Parquet in the shared folder and reads it
again for the next stage. All stages but the last return the columns of ``documents``.

Stages go by rows, as ids may be null or repeat. Null texts count as empty ones: ``quality`` scores them by the share of good labels,
``exact_dedup`` keeps one of all null and empty texts, ``ngram_join`` links them with nothing, ``pii`` leaves them as they are, ``packing``
makes a piece of one id of each. Of a group the row with the smallest id stays, null before all others; of rows that repeat this id
the first that was read. Other columns pass as they are. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import NULL_ID, SHUFFLE_CLEANUP, cut, drop_table, read, release_shuffles
from larkspur.llm.exact_dedup import exact_groups
from larkspur.llm.ngram_join import jaccard_components
from larkspur.llm.packing import pack, word_bpe_path
from larkspur.llm.pii import redacted
from larkspur.llm.quality import fit, keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; without labels none does, as their share of good ones is 1."""
    return keep_quality(docs, fit(docs, read(spark, sf_dir, "labels")))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row, as ids may be null or repeat; written, so that it stays."""
    return cut(docs.withColumn("_row", F.monotonically_increasing_id()))


def first_of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group in ``groups`` (_row, _group) the row with the smallest id, null before all others; of rows that
    repeat this id the first."""
    ids = rows.select("_row", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"))
    heads = groups.join(ids.hint("merge"), "_row").groupBy("_group").agg(F.min(F.struct("_id", "_row")).alias("m")).select("m._row")
    return rows.join(heads.hint("merge"), "_row", "left_semi").drop("_row")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal once white space is squeezed, the row with the smallest id stays.

    Turns on the removal of shuffle files for the session (see ``release_shuffles``)."""
    release_shuffles(spark)
    rows = numbered(docs)
    groups = exact_groups(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("_group"))
    return first_of_groups(rows, groups).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked, directly or by others, by a five-word shingle similarity of 0.8 or more the one with the smallest id stays.

    Turns on the removal of shuffle files for the session (see ``release_shuffles``)."""
    release_shuffles(spark)
    rows = numbered(docs)
    groups = jaccard_components(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    return first_of_groups(rows, groups).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kinds; n_chars follows the text."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4096."""
    return pack(docs, word_bpe_path())


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("pii", personal_data),
    ("packing", packing),
]
#: Nearest neighbours, boosted trees and linear programs have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes once the next one is written, and the session's setting is what it was. The last but one stays, as the
    result reads it."""
    docs, before = read(spark, sf_dir, "documents"), spark.conf.get(SHUFFLE_CLEANUP, None)
    written = None
    try:
        for _, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir))
            if written is not None:
                drop_table(written)
            written = docs
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return STAGES[-1][1](spark, docs, sf_dir)
