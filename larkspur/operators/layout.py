"""Words and lines of pages: reading order, marked text, and the search for markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cleaned_marker
from ..shared import written
from .similar import edit_pairs

REGIONS = ["top", "upper_middle", "lower_middle", "bottom"]


def line_of(y: Column, tolerance: int = 10) -> Column:
    """The line a word stands on: its y to the nearest multiple, halves up."""
    return (F.floor(y / tolerance + 0.5) * tolerance).cast("long")


def page_text(words: DataFrame, keys: list[str], tolerance: int = 10, gap: int = 20, with_x: bool = True) -> DataFrame:
    """(keys, text): a line of text for each line of words, ``[Y:n]`` before it; with x each word tells its place, and a bar stands
    where the next word begins more than ``gap`` further (W05, W06, S12).

    ``words`` has keys, text, x, y and ``seq``, which breaks ties. A page's words are few, so its text is one row.
    """
    lines = words.withColumn("line", line_of(F.col("y"), tolerance))
    order = Window.partitionBy(*keys, "line").orderBy("x", "seq")
    said = F.col("text")
    if with_x:
        bar = F.when(F.lead("x").over(order) - F.col("x") > gap, " |").otherwise("")
        said = F.concat(said, F.lit(" (x:"), F.col("x").cast("string"), F.lit(")"), bar)
    lines = lines.withColumn("said", said).groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("x", "seq", "said"))).alias("w"))
    lines = lines.select(*keys, "line", F.concat(F.lit("[Y:"), F.col("line").cast("string"), F.lit("] "),
        F.array_join(F.transform("w", lambda p: p["said"]), " ")).alias("said"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda p: p["said"]),
        "\n").alias("text"))


def estimated_text(text: Column, height: int = 2263, width: int = 100) -> Column:
    """The same form for plain text, with places that are guessed from the number of lines and words."""
    lines = F.split(text, "\n")
    step = F.floor(F.lit(height) / (F.size(lines) + 1)).cast("int")
    words = lambda line: F.filter(F.split(F.trim(line), r"\s+"), lambda w: F.length(w) > 0)
    said = lambda line: F.array_join(F.transform(words(line), lambda w, i: F.concat(w, F.lit(" (x:"), (i * width).cast("string"), F.lit(")"))), " | ")
    return F.array_join(F.transform(lines, lambda line, i: F.concat(F.lit("[Y:"), ((i + 1) * step).cast("string"), F.lit("] "), said(line))), "\n")


def reading_order(blocks: Column) -> Column:
    """Blocks (array of struct<id, x, y, h>) of a page in reading order (W04): rows from the top, each from the left.

    A block is in the current row if it begins above the row's lowest end and not more than half the first block's height
    above that block. What a row is depends on its first block, so it is a fold over the blocks of a page.
    """
    ordered = F.array_sort(F.transform(blocks, lambda b, i: F.struct(b["y"].cast("double").alias("y"), i.alias("seq"),
        b["x"].cast("double").alias("x"), b["h"].cast("double").alias("h"), b["id"].alias("id"))))
    zero = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"), F.lit(-1.0).alias("low"),
        F.array().cast("array<struct<row:int,x:double,seq:int,id:bigint>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        same = (acc["row"] >= 0) & (b["y"] < acc["low"]) & (b["y"] >= acc["y"] - acc["h"] * 0.5)
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        low = F.when(same, F.greatest(acc["low"], b["y"] + b["h"])).otherwise(b["y"] + b["h"])
        return F.struct(
            row.alias("row"), F.when(same, acc["y"]).otherwise(b["y"]).alias("y"), F.when(same, acc["h"]).otherwise(b["h"]).alias("h"),
                low.alias("low"),
            F.array_append(acc["out"], F.struct(row.alias("row"), b["x"].alias("x"), b["seq"].alias("seq"),
                b["id"].cast("bigint").alias("id"))).alias("out"),
        )

    return F.transform(F.array_sort(F.aggregate(ordered, zero, step, lambda acc: acc["out"])), lambda b: b["id"])


def block_text(blocks: Column) -> Column:
    """Text of blocks of paragraphs of words of symbols, a line a paragraph."""
    word = lambda w: F.array_join(F.transform(w["symbols"], lambda s: s["text"]), "")
    paragraph = lambda p: F.array_join(F.filter(F.transform(p["words"], word), lambda t: F.length(t) > 0), " ")
    lines = F.flatten(F.transform(blocks, lambda b: F.transform(b["paragraphs"], paragraph)))
    return F.array_join(F.filter(lines, lambda t: F.length(t) > 0), "\n")


def marked_lines(docs: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """(key, *keep, pos, line, page, start_of, end_of): the lines of marked text and the page that each stands on."""
    lines = docs.select(key, *keep, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    mark = lambda word: F.regexp_extract("line", rf"(?i)---\s*PAGE\s*(\d+)\s*{word}\s*---", 1).try_cast("int")
    lines = lines.withColumn("start_of", mark("START")).withColumn("end_of", F.when(F.col("start_of").isNull(), mark("END")))
    return lines.withColumn("page", F.last("start_of", ignorenulls=True).over(Window.partitionBy(key).orderBy("pos")))


def sliced_text(docs: DataFrame, key: str, text: str, first: str, last: str, start_kind: str | None = None, end_kind: str | None = None,
    start_y: str | None = None, end_y: str | None = None, buffer: int = 150) -> DataFrame:
    """(key, text): the pages first to last of marked text with their markers (N38) and, where a boundary lies within a page, without
    the lines that stand more than ``buffer`` beyond it (P16). Lines without a place are kept; a text without such pages is empty.
    """
    keep = [c for c in (first, last, start_kind, end_kind, start_y, end_y) if c]
    lines = marked_lines(docs, key, text, keep)
    y = F.regexp_extract("line", r"^\[Y:(\d+)\]", 1).try_cast("int")
    inside = F.col("page").between(F.col(first), F.col(last))
    kept = F.when(F.col("end_of").isNotNull(), F.col("end_of").between(F.col(first), F.col(last))).otherwise(inside)
    if start_kind and start_y:
        early = (F.col("page") == F.col(first)) & (F.col(start_kind) == "intra_page") & (y < F.col(start_y) - buffer)
        kept = kept & ~F.coalesce(early & F.col("end_of").isNull() & F.col("start_of").isNull(), F.lit(False))
    if end_kind and end_y:
        late = (F.col("page") == F.col(last)) & (F.col(end_kind) == "intra_page") & (y > F.col(end_y) + buffer)
        kept = kept & ~F.coalesce(late & F.col("end_of").isNull() & F.col("start_of").isNull(), F.lit(False))
    line = F.when(F.coalesce(kept, F.lit(False)), F.struct("pos", "line"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda p: p["line"]), "\n").alias("text"))


def in_region(y: Column, region: Column, height: Column) -> Column:
    """Whether a place lies in the quarter of the page that is hinted at; all places do without a hint."""
    quarter = F.array_position(F.array(*map(F.lit, REGIONS)), region) - 1
    return F.coalesce(quarter < 0, F.lit(True)) | y.between(quarter * 0.25 * height, (quarter + 1) * 0.25 * height)


def runs_of_words(words: DataFrame, views: DataFrame, page: str) -> DataFrame:
    """(view, i, said, text, y, low, confidence), written: each run of as many words as ``views`` asks for (n), among the words of its
    region (W07): its place in their order, its text in lower case and as it stands, its top and bottom, and its mean confidence.

    Runs are frames of a window over rows, as long as the least power of two that n does not exceed, so no row holds a page.
    """
    seen = words.join(views, page).where(in_region(F.col("y"), F.col("region"), F.col("page_height")))
    one = F.struct("seq", "text", "y", "height", F.col("confidence").cast("double").alias("confidence"))
    seen = seen.select("view", "n", F.ceil(F.log2("n")).cast("int").alias("_level"), one.alias("_w"))
    order = Window.partitionBy("view").orderBy("_w")
    levels = sorted(r[0] for r in views.select(F.ceil(F.log2("n")).cast("int")).distinct().collect())  # as many as a length has digits
    framed = lambda level: F.slice(F.collect_list("_w").over(order.rowsBetween(0, 2**level - 1)), F.lit(1), F.col("n"))
    found = [seen.where(F.col("_level") == k).select("view", "n", F.row_number().over(order).alias("i"), framed(k).alias("_run")) for k in levels or [0]]
    runs = reduce(DataFrame.unionByName, found).where(F.size("_run") == F.col("n"))
    text = F.array_join(F.transform("_run", lambda w: w["text"]), " ")
    top = F.array_min(F.transform("_run", lambda w: w["y"].cast("double")))
    low = F.array_max(F.transform("_run", lambda w: (w["y"] + w["height"]).cast("double")))
    mean = F.aggregate("_run", F.lit(0.0), lambda s, w: s + w["confidence"]) / F.size("_run")
    return written(runs.select("view", "i", F.lower(text).alias("said"), text.alias("text"), top.alias("y"), low.alias("low"), mean.alias("confidence")))


def context_scores(placed: DataFrame, words: DataFrame, page: str, near: float) -> DataFrame:
    """(_at, _score): how many of the context's words (``_context``, an array) a word of the page within ``near`` of the run's middle
    contains. Each context word and middle meets the page's different words once, by bins of y."""
    width = max(near, 1.0)
    bin_ = lambda y: F.floor(y / width).cast("long")
    each = placed.select("_at", page, (F.col("y") + (F.col("low") - F.col("y")) / 2).alias("_middle"), F.explode("_context").alias("_c"))
    asked = each.select(page, "_middle", "_c").distinct().withColumn("_bin", F.explode(F.sequence(bin_(F.col("_middle")) - 1, bin_(F.col("_middle")) + 1)))
    there = words.select(page, (F.col("y") + F.col("height") / 2).alias("_center"), F.lower("text").alias("_text")).distinct()
    there = there.withColumn("_bin", bin_(F.col("_center")))
    held = asked.join(there, [page, "_bin"]).where((F.abs(F.col("_center") - F.col("_middle")) <= near) & F.contains("_text", "_c"))
    return each.join(held.select(page, "_middle", "_c").distinct(), [page, "_middle", "_c"]).groupBy("_at").agg(F.count("*").alias("_score"))


def marker_matches(words: DataFrame, markers: DataFrame, page: str = "page", threshold: float = 0.85, near: float = 100.0) -> DataFrame:
    """(marker_id, text, y, height, confidence, exact): where each marker stands on its page.

    ``words`` has page, seq, text, y, height, confidence; ``markers`` has marker_id, page, marker, context, region, page_height.
    Runs of as many words as a marker has, whatever their number, within its region, match exactly (any case) or, where none does, with a
    similarity from ``threshold`` on (see ``edit_pairs``: only runs that share a rare q-gram with a marker of their page are compared). Of
    several the one with the most words of the context within ``near`` above or below stays, a context word that repeats counts as
    often as it stands; of equal ones the first. The confidence is the words' mean, times 0.8 for a similar match; a place or
    height that no page has is left out (F72). Markers with less than three characters match nothing. Words stay rows, however many a page
    has; of runs that are alike only the first meets a marker without context.
    """
    m = markers.withColumn("_want", F.lower(cleaned_marker(F.col("marker")))).where(F.length("_want") >= 3)
    m = m.withColumn("n", F.size(F.split("_want", " "))).withColumn("_region", F.coalesce("region", F.lit("")))
    m = m.withColumn("view", F.to_json(F.struct(page, "_region", "page_height", "n")))
    context = F.filter(F.split(F.lower(cleaned_marker(F.coalesce("context", F.lit("")))), r"\s+"), lambda w: w != "")
    m = m.select("marker_id", page, "view", "region", "page_height", "n", "_want", context.alias("_context")).distinct()
    runs = runs_of_words(words, m.select("view", page, "region", "page_height", "n").distinct(), page)
    place = F.struct("i", "text", "y", "low", "confidence")
    first = written(runs.groupBy("view", "said").agg(F.min(place).alias("_run")))
    wanted = m.join(first.select("view", F.col("said").alias("_want"), F.lit(True).alias("exact")), ["view", "_want"], "left")
    wanted = wanted.withColumn("exact", F.coalesce("exact", F.lit(False))).withColumn("_any", F.bool_or("exact").over(Window.partitionBy("marker_id")))
    told = ["marker_id", page, "view", "_context", "exact"]
    wanted = written(wanted.where(F.col("exact") | ~F.col("_any")).select(*told, "_want"))
    rest = wanted.where("NOT exact")
    alike = edit_pairs(rest.select("view", "_want"), first.join(rest.select("view").distinct(), "view", "left_semi"), threshold, ["view"], "_want", "said")
    hits = wanted.where("exact").select(*told, F.col("_want").alias("said")).unionByName(
        rest.join(alike.select("view", F.col("left_text").alias("_want"), F.col("right_text").alias("said")), ["view", "_want"]).select(*told, "said"))
    alone = hits.where("size(_context) = 0").join(first, ["view", "said"]).select("marker_id", "exact", "_run.*", F.lit(0).alias("_score"))
    placed = hits.where("size(_context) > 0").join(runs, ["view", "said"]).withColumn("_at", F.struct("marker_id", "view", "said", "i", "_context"))
    scored = placed.join(context_scores(placed, words, page, near), "_at", "left")
    scored = scored.select("marker_id", "exact", "i", "text", "y", "low", "confidence", F.coalesce("_score", F.lit(0)).alias("_score"))
    best = Window.partitionBy("marker_id").orderBy(F.desc("_score"), "i")
    ranked = alone.unionByName(scored).withColumn("height", F.col("low") - F.col("y")).withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    ranked = ranked.where(F.col("y").between(0, 3300) & F.col("height").between(8, 500))
    sure = F.col("confidence") * F.when(F.col("exact"), 1.0).otherwise(0.8)
    return ranked.select("marker_id", "text", "y", "height", sure.alias("confidence"), "exact")


#: Words that may stand for a place are at most this far from it, those in its marker at most so far.
ANY_WITHIN, HELD_WITHIN = 10, 5


def text_height(words: DataFrame, asked: DataFrame, page: str = "page") -> DataFrame:
    """(ask_id, height): of the words within 5 of a place the first that is in its marker, else the first of any within 10.

    Of a page's words with one y and text only the first can be the answer, and places with one y and marker have the same, so
    different ones meet, by bins of y as wide as the greatest distance.
    """
    bin_ = lambda y: F.floor(y / ANY_WITHIN).cast("long")
    first = F.min(F.struct("seq", "height")).alias("_w")
    w = words.select(page, F.lower("text").alias("_text"), F.col("y").alias("_y"), "seq", "height").groupBy(page, "_y", "_text").agg(first)
    w = w.withColumn("_bin", bin_(F.col("_y")))
    a = asked.select(page, "y", F.lower("marker").alias("_marker")).distinct()
    a = a.withColumn("_bin", F.explode(F.sequence(bin_(F.col("y")) - 1, bin_(F.col("y")) + 1)))
    far, held = F.abs(F.col("_y") - F.col("y")), F.contains("_marker", "_text")
    near = a.join(w, [page, "_bin"]).where(far <= ANY_WITHIN)
    tier = F.when((far <= HELD_WITHIN) & held, 0).otherwise(1)
    best = near.groupBy(page, "y", "_marker").agg(F.min(F.struct(tier.alias("_tier"), "_w"))["_w"]["height"].alias("height"))
    rows = asked.select("ask_id", page, "y", F.lower("marker").alias("_marker"))
    same = [rows[c].eqNullSafe(best[c]) for c in (page, "y", "_marker")]  # a null marker holds no word, but may have words near
    return rows.join(best, reduce(lambda p, q: p & q, same), "left").select("ask_id", "height")


def visual_share(blocks: DataFrame, page: str = "page") -> DataFrame:
    """(page, visual_share, advice): the share of a page's block area that is no text, and how to read the page."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    share = F.coalesce(F.try_divide(F.sum(F.when(F.col("kind") != "text", area).otherwise(0.0)), F.sum(area)), F.lit(0.0))
    return blocks.groupBy(page).agg(F.round(share, 6).alias("visual_share")).withColumn("advice",
        F.when(F.col("visual_share") > 0.2, "vision").otherwise("text"))


def mean_confidence(pages: DataFrame, key: str, words: str, default: float = 0.85) -> DataFrame:
    """(key, confidence): the mean over the words of a page's nested array; ``default`` where there is none."""
    rows = pages.select(key, F.explode_outer(words).alias("w"))
    return rows.groupBy(key).agg(F.coalesce(F.avg("w.confidence"), F.lit(default)).alias("confidence"))


#: Least level of a bin: zones that are shorter than 2^LEAST_LEVEL, or have no length, lie in bins of that width.
LEAST_LEVEL = -20


def bin_of(y: Column, level: Column) -> Column:
    """The number of the bin of width 2^level that a place lies in; powers of two divide exactly."""
    return F.floor(y.cast("double") / F.pow(F.lit(2.0), level.cast("double")))


def zone_candidates(entities: DataFrame, zones: DataFrame) -> DataFrame:
    """Entities beside the zones of their page that share a bin with them.

    A zone lies in bins of the least power of two that its length does not exceed, so in two of them at most; an entity looks into one bin for
    each such level in use. So what meets has about the size of what matches, however many zones and entities a page has.
    Zones that are equal but for their id are one, the least.
    """
    z = zones.where(F.col("y_start") <= F.col("y_end")).groupBy("page", "y_start", "y_end", "schema_type").agg(F.min("zone_id").alias("zone_id"))
    length = (F.col("y_end") - F.col("y_start")).cast("double")
    level = F.when(length > 2.0**LEAST_LEVEL, F.ceil(F.log2(length))).otherwise(LEAST_LEVEL).cast("int")
    z = z.withColumn("_level", level)
    levels = [r[0] for r in z.select("_level").distinct().collect()]  # as many as a double has exponents at most
    at = lambda c: bin_of(F.col(c), F.col("_level"))
    z = z.withColumn("_bin", F.explode(F.sequence(at("y_start"), at("y_end"))))
    used = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    e = entities.where(F.col("y").isNotNull()).withColumn("_level", F.explode(used))
    e = e.withColumn("_bin", bin_of(F.col("y"), F.col("_level")))
    return e.join(z, ["page", "_level", "_bin"])


def zone_of(entities: DataFrame, zones: DataFrame) -> DataFrame:
    """(entity_id, zone_id): the zone of its page that an entity's y lies in; of several the first of its own type, else the first
    (J10, D22). Entities without y, or in no zone, have none; zones that end before they start hold nothing.

    ``entities`` has entity_id, page, y, entity_type; ``zones`` zone_id, page, y_start, y_end, schema_type. They meet by bins of a
    width that follows the zone's length (see ``zone_candidates``).
    """
    hits = zone_candidates(entities, zones).where(F.col("y").between(F.col("y_start"), F.col("y_end")))
    kind = F.when(F.col("schema_type").startswith(F.col("entity_type")), 0).otherwise(1)
    first = hits.groupBy("entity_id").agg(F.min(F.struct(kind.alias("k"), "zone_id"))["zone_id"].alias("zone_id"))
    return entities.select("entity_id").join(first, "entity_id", "left")
