"""Spans of regular expressions in text as Column expressions, near linear in the number of spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that a fold collects before it sets them aside: each step of ``aggregate`` copies its whole state, so the state of
#: the inner fold holds no more than these, and that of the outer one is copied once for so many items.
CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(
    items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], shape: str
) -> Column:
    """array<shape> of ``emit(state, item)`` for each item, where the state is ``step`` folded over the items before it.

    What is emitted is copied with the state, so plain numbers are best; callers put them beside the items.
    """
    none, sets = F.array().cast(f"array<{shape}>"), F.array().cast(f"array<array<{shape}>>")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.array_append(acc["out"], emit(acc["state"], x)).alias("out"))

    def all_of(bound: Column) -> Column:
        def chunk(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(bound, i * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return let(inner, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["done"], r["out"]).alias("done")))

        chunks = F.sequence(F.lit(0), F.floor(F.size(bound) / CHUNK).cast("int"))
        return F.aggregate(chunks, F.struct(zero.alias("state"), sets.alias("done")), chunk, lambda acc: F.flatten(acc["done"]))

    return let(items, all_of)


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<match, gap>>: the leftmost matches, each with what stands between it and the one before."""
    asked = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, gaps = F.regexp_extract_all(text, asked, F.lit(0)), F.split(text, pattern, -1)
    return let(found, lambda f: F.zip_with(f, F.slice(gaps, 1, F.size(f)), lambda m, g: F.struct(m.alias("match"), g.alias("gap"))))


def located(text: Column, pattern: str, context: int) -> Column:
    """array<struct<start, end, match, before>> in code points; ``before`` is up to ``context`` of the characters before a match, back to
    where the gap before the last match begins."""
    starts = lambda found: running(found, F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["match"]), lambda at, x: at + F.length(x["gap"]), "int")

    def with_starts(found: Column, starts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start, last = F.get(starts, i), F.get(found, i - 1)
            said = [start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match")]
            if context:
                before = F.concat(F.coalesce(last["gap"], F.lit("")), F.coalesce(last["match"], F.lit("")), x["gap"])
                said.append(F.right(before, F.lit(context)).alias("before"))
            return F.struct(*said)

        return F.transform(found, one)

    return let(matches(text, pattern), lambda found: let(starts(found), lambda at: with_starts(found, at)))


def replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """``text`` with each span (struct with start, end; sorted by start) replaced by ``put(span)``; of overlapping ones
    the first stands and the text that a later one covers beyond it goes too.

    The rest of the text is cut off once a chunk, so that no step walks the text from its beginning.
    """
    none = F.array().cast("array<string>")

    def all_of(bound: Column) -> Column:
        def chunk(acc: Column, i: Column) -> Column:
            def one(r: Column, s: Column) -> Column:
                piece = F.concat(F.substring(acc["rest"], r["at"] - acc["at"] + 1, s["start"] - r["at"]), put(s))
                return F.struct(F.greatest(r["at"], s["end"]).alias("at"), F.when(s["start"] >= r["at"], F.array_append(r["out"], piece)).otherwise(r["out"]).alias("out"))

            inner = F.aggregate(F.slice(bound, i * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return let(inner, lambda r: F.struct(
                r["at"].alias("at"), F.substring(acc["rest"], r["at"] - acc["at"] + 1, F.length(acc["rest"])).alias("rest"),
                F.array_append(acc["done"], F.array_join(r["out"], "")).alias("done")))

        chunks = F.sequence(F.lit(0), F.floor(F.size(bound) / CHUNK).cast("int"))
        begin = F.struct(F.lit(0).alias("at"), text.alias("rest"), none.alias("done"))
        return F.aggregate(chunks, begin, chunk, lambda acc: F.concat(F.array_join(acc["done"], ""), acc["rest"]))

    return let(spans, all_of)
