"""Exact de-duplication by 128-bit content hash, with a byte comparison inside every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_text, read, shown_id

SPACE_RUN = r"[\x20\x09-\x0D]+"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of white space became one space. The row with the
    smallest id of a group stays. Rows are grouped by the MD5 of the normalised text *and* the text itself, so
    two texts that collide are two groups; the grouping is combined before its shuffle, so a group that holds
    a third of all rows arrives as one row a task. Only hashes and ids meet the groups again, except where a
    hash stands for several texts: those few rows compare their texts.

    Null text counts as empty. A null id sorts before all others and is shown as null. Of rows that repeat the
    smallest id, all are kept: the operator decides by id. An empty table gives an empty result.
    """
    base = id_text(docs, id_col, text_col).select(
        "doc_id", F.regexp_replace("text", SPACE_RUN, " ").alias("norm")
    )
    keyed = base.withColumn("digest", F.unhex(F.md5("norm")))
    classes = keyed.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    heads = cut(
        classes.groupBy("digest").agg(
            F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"),
            F.min(F.unhex(F.sha2("norm", 256))).alias("sha"),
        )
    )
    out = keyed.select("doc_id", "digest").join(heads.where("texts = 1"), "digest")
    several = heads.where("texts > 1").select("digest")
    if several.head(1):
        parted = keyed.join(several, "digest", "left_semi").join(
            classes.join(several, "digest", "left_semi").withColumn("sha", F.unhex(F.sha2("norm", 256))), ["digest", "norm"]
        )
        out = out.select("doc_id", "keep_id", "group_size", "sha").unionByName(
            parted.select("doc_id", "keep_id", "group_size", "sha")
        )
    return out.select(
        shown_id(), shown_id("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
