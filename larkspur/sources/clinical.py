"""Clinical documents in XML: sections of any depth, and their tables, lists and paragraphs, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: How XML is read: prefixes of names don't count, text beside elements is in ``said``.
OPTIONS = {"ignoreNamespace": "true", "valueTag": "said", "attributePrefix": "at_", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"}
_ROWS = "struct<tr: array<struct<th: array<string>, td: array<string>>>>"
_TEXT = f"struct<said: string, table: array<struct<thead: {_ROWS}, tbody: {_ROWS}>>, list: array<struct<item: array<string>>>, paragraph: array<string>>"


def _section(depth: int) -> str:
    """The type of a section with ``depth`` levels."""
    inner = f", component: array<struct<section: {_section(depth - 1)}>>" if depth > 1 else ""
    return f"struct<title: string, code: struct<at_code: string>, text: {_TEXT}{inner}>"


def nesting(xml: Column) -> Column:
    """How deep sections lie in each other: the most that are open at a time."""
    tags = F.regexp_extract_all(xml, F.lit(r"<(/?)(?:\w+:)?section(?=[\s>])(?:[^>]*[^/])?>"), F.lit(1))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(s: Column, tag: Column) -> Column:
        now = s["open"] + F.when(tag == "/", -1).otherwise(1)
        return F.struct(now.alias("open"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(tags, start, step, lambda s: s["most"])


def plain(text: Column) -> Column:
    """The text of a cell or item without the markup within it, white space squeezed."""
    marked = text.contains("<")
    bare = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(F.when(marked, bare).otherwise(text), r"\s+", " "))


def sections(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, path, depth, title, code, text): the sections of each document, in ``path`` their numbers from the outermost on.

    The levels that are read follow the deepest nesting there is, so none is left out. ``text`` holds the parsed text, see ``tables`` and
    ``passages``. Documents that are null, no XML, or have no body give no rows. What is parsed is written, as each level reads it.
    """
    depth = docs.agg(F.max(nesting(F.col(xml)))).first()[0] or 0
    if not depth:
        nothing = {"path": F.array().cast("array<int>"), "depth": F.lit(0), "title": F.lit(""), "code": F.lit(""), "text": F.lit(None).cast(_TEXT)}
        return docs.select(key).limit(0).select(key, *(c.alias(n) for n, c in nothing.items()))
    schema = f"struct<component: struct<structuredBody: struct<component: array<struct<section: {_section(depth)}>>>>>"
    parsed = written(docs.select(key, F.from_xml(F.col(xml), schema, OPTIONS).alias("d")))
    level = parsed.select(key, F.array().cast("array<int>").alias("path"), F.col("d.component.structuredBody.component").alias("c"))
    found = []
    for n in range(1, depth + 1):
        each = level.select(key, "path", F.posexplode("c").alias("i", "c")).where("c.section IS NOT NULL")
        each = each.select(key, F.array_append("path", F.col("i") + 1).alias("path"), F.col("c.section").alias("s"))
        told = {"depth": F.lit(n), "title": plain(F.col("s.title")), "code": F.col("s.code.at_code"), "text": F.col("s.text")}
        found.append(each.select(key, "path", *(c.alias(name) for name, c in told.items())))
        if n < depth:
            level = each.select(key, "path", F.col("s.component").alias("c"))
    return reduce(DataFrame.unionByName, found)


def tables(found: DataFrame, key: str) -> DataFrame:
    """(key, path, table, row, cell, header, value): the cells of the tables of ``sections``, all numbered from 1; ``header`` is that of the
    cell's column in the first row of headers, null where there is none."""
    each = found.select(key, "path", F.posexplode("text.table").alias("t", "table"))
    heads = F.get("table.thead.tr", 0)["th"].alias("_heads")
    each = each.select(key, "path", (F.col("t") + 1).alias("table"), heads, F.posexplode("table.tbody.tr").alias("r", "tr"))
    cells = each.select(key, "path", "table", (F.col("r") + 1).alias("row"), "_heads", F.posexplode("tr.td").alias("c", "value"))
    header = plain(F.get("_heads", F.col("c"))).alias("header")
    return cells.select(key, "path", "table", "row", (F.col("c") + 1).alias("cell"), header, plain(F.col("value")).alias("value"))


def passages(found: DataFrame, key: str) -> DataFrame:
    """(key, path, kind, n, text): paragraphs, list items and bare text of ``sections``, each kind numbered from 1; blank ones are left out."""
    lists = F.coalesce("text.list", F.array().cast("array<struct<item: array<string>>>"))
    items = F.flatten(F.transform(lists, lambda x: F.coalesce(x["item"], F.array().cast("array<string>"))))
    kinds = {"paragraph": F.col("text.paragraph"), "item": items, "text": F.array(F.col("text.said"))}
    each = [found.select(key, "path", F.lit(k).alias("kind"), F.posexplode(v).alias("n", "text")) for k, v in kinds.items()]
    rows = reduce(DataFrame.unionByName, each).withColumns({"n": F.col("n") + 1, "text": plain(F.col("text"))})
    return rows.where("length(text) > 0")
