"""Code retrieval: vector and lexical search, merging, type rules, selection and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import unit, unit_dot
from ..functions.text import DIAGNOSIS, MEASURED, MEDICATION, PROCEDURE
from .vector_index import CELLS, build_index, search_index



def vector_search(
    codes: DataFrame, queries: DataFrame, key: list[str], k: int = 10, minimum: float = 0.7, query: str = "query", kind: str | None = None,
    country: str | None = None, vector: str = "embedding", probes: int | None = None, cells: int = CELLS,
) -> DataFrame:
    """(query, *key, similarity, position): of each query the k codes with the greatest cosine from ``minimum`` on.

    ``queries`` has ``query`` and ``vector`` and, where ``kind`` names a column of both tables, that column: then null asks for all
    kinds, else codes of another kind are left out. ``country`` keeps codes of a country. Codes without a vector, and
    inactive ones where there is a column ``active``, are left out. An index is made for the search; ``build_index`` and ``search_index`` keep one
    for several. Exact unless ``probes`` limits the cells that a query meets. Ties go by ``key``; similarities are not rounded.
    """
    if "active" in codes.columns:
        codes = codes.where("active")
    if country is not None:
        codes = codes.where(F.col("country") == country)
    return search_index(build_index(codes, key, kind, vector, cells), queries, k, minimum, query, kind, vector, probes)


def combined(first: DataFrame, second: DataFrame, key: list[str], query: str = "query") -> DataFrame:
    """Two searches' candidates as one list: of one code the first stays, then by similarity.

    ``source`` tells where a row comes from; positions are new, ties keep the order of the searches.
    """
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    seen = both.withColumn("_n", F.row_number().over(Window.partitionBy(query, *key).orderBy("source", "position"))).where("_n = 1")
    order = Window.partitionBy(query).orderBy(F.desc("similarity"), "source", "position")
    return seen.withColumn("position", F.row_number().over(order)).drop("_n")


def by_type_rules(rows: DataFrame, kind: str, system: str, query: str = "query") -> DataFrame:
    """Candidates in the order that their query's entity type prefers, with a cap on the second choice.

    Medicines: regional codes, then five universal ones; procedures alike; measurements: LOINC, then five others;
    diagnoses: SNOMED, ICD, others. Where the first choice is missing the second has no cap. Other types stay as they are.
    """
    k, s = F.col(kind), F.col(system)
    group = (
        F.when(k.isin(*MEDICATION), F.when(s.isin("pbs", "ndc"), 0).when(s == "rxnorm", 1))
        .when(k.isin(*PROCEDURE), F.when(s.isin("mbs", "cpt"), 0).when(s == "snomed", 1))
        .when(k.isin(*MEASURED), F.when(s == "loinc", 0).otherwise(1))
        .when(k.isin(*DIAGNOSIS), F.when(s == "snomed", 0).when(s.startswith("icd"), 1).otherwise(2))
        .otherwise(0)
    )
    ranked = rows.withColumn("_group", group).where("_group IS NOT NULL")
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(query, "_group").orderBy("position")))
    ranked = ranked.withColumn("_first", F.count_if(F.col("_group") == 0).over(Window.partitionBy(query)))
    capped = k.isin(*MEDICATION, *PROCEDURE, *MEASURED) & (F.col("_group") == 1) & (F.col("_first") > 0) & (F.col("_n") > 5)
    kept = ranked.where(~F.coalesce(capped, F.lit(False)))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy("_group", "position"))).drop("_group", "_n", "_first")


def selected_candidates(rows: DataFrame, query: str, position: str, score: str, minimum: float = 0.60, sure: float = 0.85, good: float = 0.75,
    target: int = 10, most: int = 20) -> DataFrame:
    """The candidate list of each query cut to size and ranked by score (V06); cuts follow ``position``, not the score.

    Of candidates from ``minimum`` on: those from ``sure`` on, filled up to ``target``; where more than ``target`` reach
    ``good``, the first ``most`` of these. So a list has five candidates wherever there are five. Adds ``rank``.
    """
    some = rows.where(F.col(score) >= minimum)
    by_query, order = Window.partitionBy(query), Window.partitionBy(query).orderBy(position)
    some = some.withColumn("_good", F.count_if(F.col(score) >= good).over(by_query)).withColumn("_sure",
        F.count_if(F.col(score) >= sure).over(by_query))
    some = some.withColumn("_good_n", F.count_if(F.col(score) >= good).over(order)).withColumn("_rest_n", F.count_if(F.col(score) < sure).over(order))
    many = (F.col(score) >= good) & (F.col("_good_n") <= most)
    few = (F.col(score) >= sure) | (F.col("_rest_n") <= target - F.col("_sure"))
    kept = some.where(F.when(F.col("_good") > target, many).otherwise(few)).drop("_good", "_sure", "_good_n", "_rest_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), position)))


def ranked_codes(universal: DataFrame, regional: DataFrame, queries: DataFrame, kind: str, k: int = 30, minimum: float = 0.60, **limits) -> DataFrame:
    """The whole retrieval for each query: both searches, merging, type rules and selection."""
    key = ["code_system", "code_value"]
    found = combined(vector_search(universal, queries, key, k, minimum), vector_search(regional, queries, key, k, minimum), key)
    ruled = by_type_rules(found.join(queries.select("query", kind), "query"), kind, "code_system")
    return selected_candidates(ruled, "query", "position", "similarity", minimum, **limits)


def lexical_matches(codes: DataFrame, text: str, variants: list[str], key: str, k: int = 20) -> DataFrame:
    """Codes by the share of variants their text contains, any case; ties by key."""
    used = [v.strip().lower() for v in variants if v.strip()][:5]
    if not used:
        raise ValueError("no variant")
    hits = sum((F.lower(text).contains(v).cast("int") for v in used), F.lit(0))
    found = codes.select(key, hits.alias("hits")).where("hits > 0")
    return found.select(key, "hits", (F.col("hits") / len(used)).alias("score")).orderBy(F.desc("hits"), key).limit(k)


#: fixed values: what the place of a variant in the list is worth
VARIANT_WORTH = [1.00, 0.95, 0.90, 0.85, 0.80]


def hybrid_search(codes: DataFrame, text: str, similarity: str, variants: list[str], key: str, k: int = 10, lexical_share: float = 0.7) -> DataFrame:
    """(key, lexical, semantic, score, match_source): the best variant's worth and the similarity over the greatest one."""
    worth = F.greatest(F.lit(0.0), F.lit(0.0), *(F.when(F.lower(text).contains(v.strip().lower()), w).otherwise(0.0) for v,
        w in zip(variants, VARIANT_WORTH, strict=False)))
    rows = codes.select(key, worth.alias("lexical"), F.greatest(F.coalesce(similarity, F.lit(0.0)), F.lit(0.0)).alias("_s"))
    top = rows.agg(F.max("_s").alias("_top"))  # one row
    rows = rows.crossJoin(F.broadcast(top)).withColumn("semantic", F.coalesce(F.try_divide("_s", F.nullif("_top", F.lit(0.0))), F.lit(0.0)))
    source = F.when((F.col("lexical") > 0) & (F.col("semantic") > 0), "both").when(F.col("lexical") > 0, "lexical").otherwise("semantic")
    score = lexical_share * F.col("lexical") + (1 - lexical_share) * F.col("semantic")
    return rows.select(key, "lexical", "semantic", score.alias("score"), source.alias("match_source")).where("score > 0").orderBy(F.desc("score"),
        key).limit(k)


def retrieval_accuracy(entities: DataFrame, found: DataFrame, query: str = "query", code: str = "code_value",
    at: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """One row: entities with known codes, the share that has an expected code among the first k, and that without a result.

    ``entities`` has ``query`` and ``expected`` (array of codes; empty or null: not known); ``found`` has ``query``, ``code`` and ``rank``.
    """
    known = entities.where(F.size(F.coalesce("expected", F.array().cast("array<string>"))) > 0)
    ranks = known.join(found, query, "left").groupBy(query).agg(
        F.min(F.when(F.array_contains("expected", F.col(code).cast("string")), F.col("rank"))).alias("best"), F.count("rank").alias("n")
    )
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return ranks.agg(F.count("*").alias("known"), *(share(F.col("best") <= k).alias(f"at_{k}") for k in at), share(F.col("n") == 0).alias("empty"))


def listed_similarity(pairs: DataFrame, vectors: DataFrame, left: str = "a", right: str = "b", by: str = "model") -> DataFrame:
    """The cosine of each listed pair in each model; pairs without a vector are left out."""
    v = vectors.select("id", by, unit(F.col("embedding")).alias("_v"))
    joined = pairs.join(v.select(F.col("id").alias(left), by, F.col("_v").alias("_a")),
        left).join(v.select(F.col("id").alias(right), by, F.col("_v").alias("_b")), [right, by])
    return joined.withColumn("similarity", F.round(unit_dot(F.col("_a"), F.col("_b")), 6)).drop("_a", "_b")


def best_models(rows: DataFrame, kind: str, model: list[str], similarity: str) -> DataFrame:
    """Per entity kind the model whose mean similarity between different things is least, and that mean."""
    means = rows.groupBy(kind, *model).agg(F.avg(similarity).alias("mean"))
    return means.groupBy(kind).agg(F.min(F.struct("mean", *model)).alias("best")).select(kind, *(F.col("best")[m].alias(m) for m in model),
        F.round(F.col("best")["mean"], 6).alias("mean"))


def share_of(column: str | Column, partition: list[str]) -> Column:
    """A score over the greatest of its partition; null where that is 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.try_divide(c, F.nullif(F.max(c).over(Window.partitionBy(*partition)), F.lit(0)))
