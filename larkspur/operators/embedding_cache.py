"""A cache of embeddings by the whole text and the model: what is known, what must be fetched, and what is put in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days that an entry holds.
DAYS = 90


def cache_key(text: Column, model: Column) -> Column:
    """The key of a text under a model: the SHA-256 of both; trimmed text with single spaces and in lower case is the same text."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.sha2(F.concat_ws("\u0000", model, plain), 256)


def looked_up(texts: DataFrame, cache: DataFrame, as_of: Column, days: int = DAYS) -> DataFrame:
    """``texts`` (with text and model) beside ``cache_key``, ``embedding`` and ``hit``.

    ``cache`` has cache_key, embedding and created_at; entries older than ``days`` count for nothing, of several the newest
    holds. A row without text or model has no key and is no hit. Texts meet the cache by one equi-join on the key; a key that many
    rows share is split by adaptive execution.
    """
    fresh = cache.where((F.col("created_at") > as_of - F.make_interval(days=F.lit(days))) & (F.col("created_at") <= as_of) & F.col("embedding").isNotNull())
    newest = fresh.groupBy("cache_key").agg(F.max_by("embedding", F.struct("created_at", "embedding")).alias("embedding"))
    key = F.when(F.col("text").isNotNull() & F.col("model").isNotNull(), cache_key(F.col("text"), F.col("model")))
    return texts.withColumn("cache_key", key).join(newest, "cache_key", "left").withColumn("hit", F.col("embedding").isNotNull())


def to_fetch(found: DataFrame) -> DataFrame:
    """(cache_key, model, text): each missing key once, with the least of its texts; no call is made here."""
    missing = found.where(~F.col("hit") & F.col("cache_key").isNotNull())
    return missing.groupBy("cache_key").agg(F.min("model").alias("model"), F.min("text").alias("text"))


def stored(cache: DataFrame, fetched: DataFrame, as_of: Column, days: int = DAYS) -> DataFrame:
    """The cache with what was fetched (cache_key, embedding) at ``as_of`` and without what is too old or of a later time; a fetched entry
    replaces its key's."""
    columns = ["cache_key", "embedding", "created_at"]
    held = cache.where((F.col("created_at") > as_of - F.make_interval(days=F.lit(days))) & (F.col("created_at") <= as_of)).select(columns)
    new = fetched.where("cache_key IS NOT NULL AND embedding IS NOT NULL").withColumn("created_at", as_of).select(columns)
    last = F.max_by(F.struct("embedding", "created_at"), F.struct("created_at", "embedding")).alias("e")
    return held.unionByName(new).groupBy("cache_key").agg(last).select("cache_key", "e.*")
