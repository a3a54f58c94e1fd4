"""Full-text search: a table of positional postings, matching of all words, and rank by weights and nearness."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written

#: Folders of postings: a search reads those of its words only.
BUCKETS = 64
#: Words further apart than this are not near each other.
NEAR = 100
#: Asked words that are sent to all tasks, so that others have no postings made; more are left to the join.
SENT = 100_000

# fixed values: what a word of a field of each class is worth, what a pair is worth beyond NEAR, the limit of the sum of 1/n^2,
# and words that are not looked for
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
FAR_WORTH = 1e-30
SQUARES = 1.64493406685
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but
if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now
""".split()


class TextIndex(NamedTuple):
    """``postings``: bucket, term, *by, key, places (array of struct<pos, weight> in their order)."""

    postings: DataFrame
    key: str
    by: list[str]


def tokens(text: Column) -> Column:
    """The words of a text: runs of letters and digits in lower case. There is no stemming."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def placed_words(words: Column, before: Column, weight: float) -> Column:
    """Array of struct<term, pos, weight>: words with their places, ``before`` further on."""
    return F.transform(words, lambda w, i: F.struct(w.alias("term"), (before + i + 1).alias("pos"), F.lit(weight).alias("weight")))


def build_index(docs: DataFrame, key: str, fields: dict[str, str], by: list[str] | None = None, stop: list[str] | None = None) -> TextIndex:
    """The index of ``docs``: of each word of a document its positions, and the class (A to D) of the field that it stands in.

    ``fields`` maps columns to classes; positions of a field follow those of the one before. Words of ``stop`` keep their positions
    but have no postings. ``by`` names columns that a search must share (an owner, say). All positions of a whole text count.
    Rows with a null key are left out, null texts have no words; rows that repeat a key are read as one document with several texts.
    """
    by, rows, before = by or [], docs.where(F.col(key).isNotNull()), F.lit(0)
    words = []
    for column, weight in fields.items():
        own = F.coalesce(tokens(F.col(column)), F.array().cast("array<string>"))
        words.append(placed_words(own, before, WEIGHTS[weight]))
        before = before + F.size(own)
    each = rows.select(*by, key, F.inline(F.concat(*words)))
    if stop:
        each = each.where(~F.col("term").isin(stop))
    places = each.groupBy("term", *by, key).agg(F.array_sort(F.collect_list(F.struct("pos", "weight"))).alias("places"))
    return TextIndex(places.withColumn("bucket", bucket_of(F.col("term"))), key, by)


def save_index(index: TextIndex, path: str) -> TextIndex:
    """The postings as a table of BUCKETS folders under ``path``, ordered by word within them."""
    rows = index.postings.repartition("bucket", F.pmod(F.xxhash64("term", index.key), F.lit(8))).sortWithinPartitions("bucket", "term")
    rows.write.partitionBy("bucket").mode("overwrite").parquet(path)
    return load_index(index.postings.sparkSession, path, index.key, index.by)


def load_index(spark: SparkSession, path: str, key: str, by: list[str] | None = None) -> TextIndex:
    return TextIndex(spark.read.parquet(path), key, by or [])


def nearness(apart: Column) -> Column:
    """What a pair of words that stand ``apart`` is worth, up to NEAR."""
    return 1.0 / (1.005 + 0.05 * F.exp(apart / 1.5 - 2))


def single_rank(places: Column) -> Column:
    """The rank of one word: its weights over the squares of their place in the list, the first greatest weight as if it were first."""
    weights = F.transform(places, lambda p: p["weight"])
    most = F.array_max(weights)
    first = F.array_position(weights, most)
    total = F.aggregate(F.transform(weights, lambda w, i: w / ((i + 1) * (i + 1))), F.lit(0.0), lambda s, v: s + v)
    return (most + total - most / (first * first)) / SQUARES


def search(index: TextIndex, queries: DataFrame, query: str = "query", text: str = "text", stop: list[str] | None = None) -> DataFrame:
    """(query, key, rank): the documents that have all words of a query, and how well they match.

    A query of one word ranks by ``single_rank``. One of several combines all pairs of places of different words, each worth the
    root of both weights and of ``nearness``: rank = 1 - product of (1 - worth). Pairs within NEAR words are found by a window over the
    places; all others are worth the same, so their number is enough. Words of ``stop`` and repeated words don't count; a query
    without words finds nothing. Of the postings only the folders of the asked words are read; from an index that is not saved only theirs
    are made, as the asked words meet the documents' words before these are grouped.
    """
    key, by = index.key, index.by
    words = F.array_distinct(tokens(F.col(text)))
    if stop:
        words = F.filter(words, lambda t: ~t.isin(stop))
    asked = queries.select(query, *by, words.alias("_terms")).where("size(_terms) > 0")
    asked = asked.select(query, *by, F.size("_terms").alias("_n"), F.posexplode("_terms").alias("_t", "term")).withColumn("bucket", bucket_of(F.col("term")))
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    postings = index.postings.where(F.col("bucket").isin(buckets)) if buckets else index.postings.limit(0)
    terms = asked.select("term").distinct()
    if buckets and terms.limit(SENT + 1).count() <= SENT:
        postings = postings.join(F.broadcast(terms), "term", "left_semi")
    hits = postings.join(asked, ["bucket", "term", *by])
    whole = Window.partitionBy(query, key)
    matched = written(hits.withColumn("_found", F.count("*").over(whole)).where("_found = _n").select(query, key, "_n", "_t", "places"))
    one = matched.where("_n = 1").select(query, key, single_rank(F.col("places")).alias("rank"))

    places = matched.where("_n > 1").select(query, key, "_t", F.inline("places"))
    ahead = F.collect_list(F.struct("_t", "pos", "weight")).over(Window.partitionBy(query, key).orderBy("pos").rangeBetween(1, NEAR))
    pairs = places.withColumn("_ahead", F.filter(ahead, lambda p: p["_t"] != F.col("_t"))).where("size(_ahead) > 0")
    pairs = pairs.select(query, key, "pos", "weight", F.explode("_ahead").alias("p"))
    both = F.sqrt(F.col("weight") * F.col("p.weight"))
    near = pairs.groupBy(query, key).agg(
        F.sum(F.log1p(-both * F.sqrt(nearness((F.col("p.pos") - F.col("pos")).cast("double"))))).alias("_near"), F.sum(both).alias("_near_worth")
    )
    # of words with root sums a, b, c all pairs are worth ((a + b + c)^2 - a^2 - b^2 - c^2) / 2
    roots = F.aggregate("places", F.lit(0.0), lambda s, p: s + F.sqrt(p["weight"]))
    sums = matched.where("_n > 1").select(query, key, roots.alias("_r")).groupBy(query, key).agg(F.sum("_r").alias("_s"), F.sum(F.col("_r") * F.col("_r")).alias("_ss"))
    every = (F.col("_s") * F.col("_s") - F.col("_ss")) / 2
    far = -(every - F.coalesce("_near_worth", F.lit(0.0))) * math.sqrt(FAR_WORTH)
    several = sums.join(near, [query, key], "left").select(query, key, (-F.expm1(F.coalesce("_near", F.lit(0.0)) + far)).alias("rank"))
    return one.unionByName(several)
