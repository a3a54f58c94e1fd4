"""Reconciling fragments of visits that were read chunk by chunk, and planning batches of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalized_date
from ..functions.dates import visit_dates
from .scan import merged_ranges

GROUP = ["session_id", "group_id"]
# fixed values: how good a source of dates is
SOURCE_RANK = {"ai_extracted": 3, "file_metadata": 2, "upload_date": 1}


def grouped(pendings: DataFrame) -> DataFrame:
    """Fragments with group_id: their cascade, else their own id; and ``pos``, their place in the group by chunk."""
    rows = pendings.withColumn("group_id", F.coalesce(F.nullif("cascade_id", F.lit("")), F.col("pending_id")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*GROUP).orderBy("chunk_number", "pending_id")))


def cascade_errors(rows: DataFrame) -> DataFrame:
    """(session_id, group_id, errors): what keeps a group from being one visit.

    Several visit types; chunks that do not follow each other; a chunk that begins before the one before it ends.
    Sorted windows find the last two, so a group need not fit into a row.
    """
    order = Window.partitionBy(*GROUP).orderBy("pos")
    rows = rows.withColumn("before", F.lag("chunk_number").over(order)).withColumn("until", F.lag("end_page").over(order))
    s = lambda c: F.col(c).cast("string")
    gap = F.when(F.col("chunk_number") != F.col("before") + 1, F.concat(F.lit("Chunk gap: "), s("before"), F.lit(" -> "), s("chunk_number")))
    overlap = F.when(F.col("start_page") < F.col("until"), F.concat(F.lit("Page overlap: Chunk "), s("before"), F.lit(" ends at "), s("until"),
        F.lit(", Chunk "), s("chunk_number"), F.lit(" starts at "), s("start_page")))
    kind = F.coalesce("encounter_type", F.lit("unknown"))
    found = rows.withColumns({"gap": gap, "overlap": overlap, "kind": kind}).groupBy(*GROUP).agg(
        F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("pos", F.col("gap").alias("said")))).alias("gaps"),
        F.collect_list(F.when(F.col("overlap").isNotNull(), F.struct("pos", F.col("overlap").alias("said")))).alias("overlaps"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )
    types = F.when(F.size("kinds") > 1, F.array(F.concat(F.lit("Multiple encounter types: "),
        F.array_join("kinds", ", ")))).otherwise(F.array().cast("array<string>"))
    said = lambda c: F.transform(F.array_sort(c), lambda e: e["said"])
    return found.select(*GROUP, F.concat(types, said("gaps"), said("overlaps")).alias("errors"))


def longest_value(value: str | Column, position: str | Column) -> Column:
    """Aggregate: the longest non-blank string, of equal ones the first."""
    v, p = (F.col(c) if isinstance(c, str) else c for c in (value, position))
    return F.max_by(v, F.when(F.trim(v) != "", F.struct(F.length(v), -p)))


def best_birth_date(value: str, position: str, max_year: int) -> Column:
    """Aggregate: the longest date of birth whose year, if one can be seen, lies in 1900 to ``max_year``; if none does, the
    longest of all (A28)."""
    v, p = F.col(value), F.col(position)
    year = F.regexp_extract(v, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    fine = F.coalesce(year.between(1900, max_year), F.lit(True))
    return F.coalesce(F.max_by(v, F.when((F.trim(v) != "") & fine, F.struct(F.length(v), -p))), longest_value(v, p))


def best_date(date: str, source: str, position: str) -> Column:
    """Aggregate: struct<date, source> of the date from the best source, of equal ones the first."""
    told = F.coalesce(source, F.lit("ai_extracted"))
    rank = F.coalesce(*(F.when(told == s, r) for s, r in SOURCE_RANK.items()), F.lit(0))
    return F.max_by(F.struct(F.col(date).alias("date"), told.alias("source")), F.when(F.col(date) != "", F.struct(rank, -F.col(position))))


def weighted_confidence(confidence: str, weight: Column) -> Column:
    """Aggregate: mean confidence by weight; missing or zero confidence counts as 0.5."""
    c = F.when(F.col(confidence).isNull() | (F.col(confidence) == 0), 0.5).otherwise(F.col(confidence))
    return F.try_divide(F.sum(c * weight), F.sum(weight))


def quality_tier(identity: Column, place: Column, verified: Column | None = None) -> Column:
    """verified, high (identity and place), medium (identity) or low."""
    tier = F.when(identity & place, "high").when(identity, "medium").otherwise("low")
    return tier if verified is None else F.when(verified, "verified").otherwise(tier)


START, END = ["start_page", "start_marker", "start_y"], ["end_page", "end_marker", "end_y"]


def reconciled(pendings: DataFrame, file_date: Column, today: Column, max_year: int) -> tuple[DataFrame, DataFrame]:
    """(visits, abandoned): one visit for each group of fragments without errors, and the groups with theirs.

    Start fields come from the first chunk, end fields from the last, the rest of a visit's facts from the first; names are
    the longest ones, dates the best ones in their normal form, confidence a mean by pages, page ranges merged. A
    date of birth that fails its check asks for a review. ``fragments`` counts what was merged.
    """
    rows = grouped(pendings)
    checked = cascade_errors(rows)
    first = lambda c: F.min_by(c, "pos").alias(c)
    pages = F.coalesce(F.nullif(F.col("end_page") - F.col("start_page") + 1, F.lit(0)), F.lit(1))
    merged = rows.groupBy(*GROUP).agg(
        *map(first, [*START, "encounter_type", "provider_name", "facility_name"]), *(F.max_by(c, "pos").alias(c) for c in END),
        F.bool_or("is_real_world_visit").alias("real"), weighted_confidence("position_confidence", pages).alias("position_confidence"),
        longest_value("patient_full_name", "pos").alias("patient_full_name"),
            best_birth_date("patient_date_of_birth", "pos", max_year).alias("birth_raw"),
        best_date("encounter_start_date", "date_source", "pos").alias("began"), best_date("encounter_end_date", "date_source", "pos").alias("ended"),
        F.min_by(F.struct("patient_full_name", "patient_date_of_birth", "encounter_start_date"), "pos").alias("head"),
            F.count("*").alias("fragments"), F.max("chunk_number").alias("last_chunk"),
    )
    ranges = rows.select(*GROUP, F.explode("page_ranges").alias("r")).select(*GROUP, F.col("r")[0].alias("a"), F.col("r")[1].alias("b"))
    spans = merged_ranges(ranges, GROUP, "a", "b").groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.array("a", "b"))).alias("page_ranges"))
    there = lambda c: F.coalesce(c != "", F.lit(False))
    start, end = (normalized_date(F.col(c)["date"], max_year)["iso"] for c in ("began", "ended"))
    birth = normalized_date(F.col("birth_raw"), max_year, birth=True)
    dates = visit_dates(F.col("real"), start, end, F.coalesce(F.col("began")["source"], F.lit("ai_extracted")), file_date, today)
    tier = quality_tier(
        there(F.col("head.patient_full_name")) & there(F.col("head.patient_date_of_birth")),
        (there(F.col("provider_name")) | there(F.col("facility_name"))) & there(F.col("head.encounter_start_date")),
    )
    full = merged.join(checked, GROUP).join(spans, GROUP, "left").withColumns({"dates": dates, "birth": birth})
    visits = full.where(F.size("errors") == 0).select(
        *GROUP, "fragments", "last_chunk", *START, *END, "encounter_type", "provider_name", "facility_name",
            F.col("real").alias("is_real_world_visit"),
        "position_confidence", "patient_full_name", F.col("birth.iso").alias("birth_date"),
            (F.col("birth.method") == "failed_sanity_check").alias("needs_review"),
        F.col("dates.start").alias("start_date"), F.col("dates.end").alias("end_date"), F.col("dates.source").alias("date_source"),
        F.coalesce("page_ranges", F.array().cast("array<array<int>>")).alias("page_ranges"), tier.alias("quality_tier"),
    )
    return visits, full.where(F.size("errors") > 0).select(*GROUP, "fragments", "errors")


def expanded_pages(ranges: DataFrame, keep: list[str], start: str, end: str) -> DataFrame:
    """A row for each page of a range (J11); a range that ends before it begins has none."""
    return ranges.where(F.col(start) <= F.col(end)).select(*keep, F.explode(F.sequence(start, end)).alias("page"))


def split_page(kind: Column, between: Column, page: Column) -> Column:
    """The page of a split point: the first of the two that it lies between, else its page, else 0."""
    return F.when(kind == "inter_page", F.coalesce(F.get(between, 0), page, F.lit(0))).otherwise(F.coalesce(page, F.lit(0)))


def splits_within(splits: Column, start: Column, end: Column) -> Column:
    """The split points (structs with split_type, between_pages, page) of an array whose page lies in a range (P15p)."""
    return F.filter(splits, lambda s: split_page(s["split_type"], s["between_pages"], s["page"]).between(start, end))


def split_summary(splits: DataFrame, key: str, pages: str) -> DataFrame:
    """Per document: split points in all, between and within pages, mean confidence, pages a split."""
    return splits.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(F.col("split_type") == "inter_page").alias("inter"),
            F.count_if(F.col("split_type") == "intra_page").alias("intra"),
        F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("confidence"),
            F.round(F.try_divide(F.max(pages), F.count("*")), 6).alias("pages_per_split"),
    )


MAX_BATCH, LEAST_BATCH, CEILING = 10, 3, 50


def batches(first: Column, last: Column, splits: Column) -> Column:
    """array<struct<start, end>>: the pages of a visit in batches.

    Up to ten pages, or up to fifty without a split point, are one batch. Without split points a batch has fifty pages.
    Else a batch ends before the split point that is nearest to ten pages on, of equally near ones the first given, if one
    lies from three pages on to two behind the target, and before the target itself otherwise.
    """
    page = lambda v: v.cast("int")
    none = F.array().cast("array<int>")
    splits = F.coalesce(splits.cast("array<int>"), none)
    forced = F.when(last - first > CEILING, F.sequence(page(first + CEILING), page(last - 1), F.lit(CEILING))).otherwise(none)

    def step(acc: Column, _: Column) -> Column:
        target = acc["at"] + MAX_BATCH
        near = F.filter(splits, lambda s: (s >= acc["at"] + LEAST_BATCH) & (s <= F.least(target + 2, page(last))))
        best = F.array_min(F.transform(near, lambda s, i: F.struct(F.abs(s - target).alias("far"), i.alias("place"), s.alias("page"))))["page"]
        cut = F.coalesce(best, target)
        more = target <= last
        return F.struct(F.when(more, cut).otherwise(acc["at"]).alias("at"),
            F.when(more, F.array_append(acc["out"], cut)).otherwise(acc["out"]).alias("out"))

    steps = F.sequence(F.lit(1), F.least(F.lit(101), F.ceil((last - first + 1) / LEAST_BATCH).cast("int") + 1))
    chosen = F.aggregate(steps, F.struct(page(first).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    n = last - first + 1
    cuts = F.when(n <= MAX_BATCH, none).when(F.size(splits) > 0, chosen).when(n > CEILING, forced).otherwise(none)
    starts, ends = F.concat(F.array(page(first)), cuts), F.concat(F.transform(cuts, lambda c: c - 1), F.array(page(last)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def planned_batches(visits: DataFrame, key: str, first: str, last: str, splits: str) -> DataFrame:
    """(key, index, start, end): ``batches`` of every visit, a row each."""
    return visits.select(key, F.posexplode(batches(F.col(first), F.col(last), F.col(splits))).alias("index", "b")).select(key, "index", "b.start",
        "b.end")


def cascades_on(chunk: Column, chunks: Column, flagged: Column, end_page: Column, last_page: Column) -> Column:
    """Whether a visit goes on in the next chunk (D08): never from the last one; if told so or if it reaches the chunk's end."""
    return (chunk < chunks) & (F.coalesce(flagged, F.lit(False)) | (end_page == last_page))


def ready_sessions(chunks: DataFrame, key: str = "session_id", status: str = "status", total: str = "total_chunks") -> DataFrame:
    """Sessions whose chunks are all complete (T10), with their number."""
    done = chunks.groupBy(key).agg(F.count_if(F.col(status) == "completed").alias("completed"), F.max(total).alias("total"))
    return done.where("completed = total")


def current_versions(rows: DataFrame, key: list[str], effective: str, tie: str) -> DataFrame:
    """Adds valid_to, superseded_by and is_current: one current row for each identity key."""
    order = Window.partitionBy(*key).orderBy(effective, tie)
    return rows.withColumn("valid_to", F.lead(effective).over(order)).withColumn("superseded_by", F.lead(tie).over(order)).withColumn(
        "is_current", F.col("superseded_by").isNull()
    )


def chain_heads(rows: DataFrame, key: list[str], effective: str, tie: str) -> DataFrame:
    """Adds ``current``: the newest version at the end of each row's chain of successors, and its distance."""
    order = Window.partitionBy(*key).orderBy(effective, tie)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("current", F.last(tie).over(whole)).withColumn("steps",
        F.count("*").over(Window.partitionBy(*key)) - F.row_number().over(order))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str, keep_old: bool = False) -> DataFrame:
    """The last row by ``order`` of each key, new rows before old ones of the same order; or, with ``keep_old``, new rows only
    where there is no old one (D03, S19, J19)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    sort = [F.col("_new"), F.col(order).desc_nulls_last()] if keep_old else [F.col(order).desc_nulls_last(), F.col("_new").desc()]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*sort))).where("_n = 1").drop("_n", "_new")


def row_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(*key, action, old_values, new_values) of rows that were added, removed or changed, values as JSON."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*key, F.struct(*rest).alias("_new"), F.lit(True).alias("_is"))
    action = F.when(F.col("_was").isNull(), "INSERT").when(F.col("_is").isNull(), "DELETE").otherwise("UPDATE")
    both = a.join(b, key, "full").where(F.col("_was").isNull() | F.col("_is").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(*key, action.alias("action"), F.to_json("_old").alias("old_values"), F.to_json("_new").alias("new_values"))


def soft_deleted(rows: DataFrame, ids: DataFrame, key: str, as_of: Column, by: str) -> tuple[DataFrame, DataFrame]:
    """(rows with archived_at set for those asked for and not archived yet, audit rows of these)."""
    asked = rows.join(ids.select(key).distinct().withColumn("_asked", F.lit(True)), key, "left").withColumn("_hit",
        F.col("_asked").isNotNull() & F.col("archived_at").isNull())
    after = asked.withColumn("archived_at", F.when(F.col("_hit"), as_of).otherwise(F.col("archived_at"))).drop("_asked", "_hit")
    audit = asked.where("_hit").select(key, F.lit("archive").alias("action"), as_of.alias("at"), F.lit(by).alias("by"))
    return after, audit


def narrative_version(current: DataFrame, fresh: DataFrame, key: str, number: str = "version") -> DataFrame:
    """All versions after ``fresh`` texts come in: of each key the current row is retired, its successor points to it."""
    last = current.where("is_current").select(key, F.col("id").alias("supersedes_id"), F.col(number).alias("_n"))
    new = fresh.join(last, key, "left").select(
        "id", key, "content", (F.coalesce("_n", F.lit(0)) + 1).alias(number), F.lit(True).alias("is_current"), "supersedes_id"
    )
    retired = current.join(fresh.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("is_current",
        F.col("is_current") & F.col("_hit").isNull()).drop("_hit")
    return retired.unionByName(new.select(*retired.columns))
