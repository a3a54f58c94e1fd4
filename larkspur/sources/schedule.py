"""A set of CSV tables that refer to each other: loading, checks of keys, and joins along the references."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """The columns of a table's key, and by table name the columns that refer to that table's key, in its order."""

    key: tuple[str, ...]
    parents: dict[str, tuple[str, ...]] = field(default_factory=dict)


# fixed values: keys and references of the sixteen tables of a medicines schedule
_S = "schedule_code"
SCHEDULE = {
    "schedules": Table((_S,)),
    "organisations": Table(("organisation_id", _S), {"schedules": (_S,)}),
    "programs": Table(("program_code", _S), {"schedules": (_S,)}),
    "dispensing-rules": Table(("dispensing_rule_mnem", _S), {"schedules": (_S,)}),
    "containers": Table(("container_code", _S), {"schedules": (_S,)}),
    "copayments": Table((_S,), {"schedules": (_S,)}),
    "fees": Table(("program_code", _S), {"programs": ("program_code", _S)}),
    "markup-bands": Table(("program_code", "dispensing_rule_mnem", "markup_band_code", "limit", _S), {"programs": ("program_code", _S), "dispensing-rules": ("dispensing_rule_mnem", _S)}),
    "program-dispensing-rules": Table(("program_code", "dispensing_rule_mnem", _S), {"programs": ("program_code", _S), "dispensing-rules": ("dispensing_rule_mnem", _S)}),
    "container-organisation-relationships": Table(("container_code", "organisation_id", _S), {"containers": ("container_code", _S), "organisations": ("organisation_id", _S)}),
    "item-organisation-relationships": Table(("pbs_code", "organisation_id", _S), {"organisations": ("organisation_id", _S)}),
    "extemporaneous-ingredients": Table(("pbs_code", _S), {"schedules": (_S,)}),
    "extemporaneous-preparations": Table(("pbs_code", _S), {"schedules": (_S,)}),
    "extemporaneous-tariffs": Table(("pbs_code", _S), {"schedules": (_S,)}),
    "standard-formula-preparations": Table(("pbs_code", _S), {"schedules": (_S,)}),
    "extemporaneous-prep-sfp-relationships": Table(("sfp_pbs_code", "ex_prep_pbs_code", _S), {"standard-formula-preparations": ("sfp_pbs_code", _S), "extemporaneous-preparations": ("ex_prep_pbs_code", _S)}),
}


#: Rows that a task of a key check counts, about, and the number of shares, by a hash of the key, whose rows are counted before.
ROWS, SHARES = 1 << 21, 4096


def load(spark: SparkSession, folder: str, spec: dict[str, Table] = SCHEDULE) -> dict[str, DataFrame]:
    """Each table of ``spec`` from its headered CSV under ``folder``, all columns as strings; an error where a key or reference column is missing."""
    found = {}
    for name, table in spec.items():
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{name}.csv")
        missing = {*table.key, *(c for columns in table.parents.values() for c in columns)} - set(df.columns)
        if missing:
            raise ValueError(f"{name} has no {', '.join(sorted(missing))}")
        found[name] = df
    return found


def _told(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def _full(columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def _share(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SHARES))


def _shares(met: list[tuple[DataFrame, list[str]]]) -> list[dict[int, int]]:
    """Of each DataFrame, by its key, the rows that each of SHARES shares has; in one pass over all."""
    rows = reduce(DataFrame.union, (df.select(F.lit(i).alias("i"), _share(key).alias("share")) for i, (df, key) in enumerate(met)))
    sizes = [{} for _ in met]
    for r in rows.groupBy("i", "share").agg(F.count("*").alias("n")).collect():
        sizes[r.i][r.share] = r.n
    return sizes


def _counted(met: DataFrame, key: list[str], counts: list[Column], sizes: dict[int, int]) -> DataFrame:
    """``met`` grouped by ``key``, in tasks of about ROWS rows however many rows there are; ``sizes`` are its shares.

    A grouping deals its keys to a fixed number of tasks and merges small ones by compressed bytes, so what a task holds would grow with the
    table. Here the number of tasks follows the rows. Where a share is far above the others, many rows have the same key: its rows are
    grouped as usual, as each task then counts its own rows before they are dealt out.
    """
    total = sum(sizes.values())
    if total <= ROWS:
        return met.groupBy(*key).agg(*counts)
    often = [s for s, n in sizes.items() if n > max(ROWS, 4 * total / SHARES)]
    tasks = max(-(-total // ROWS), int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seldom = met.where(~_share(key).isin(often)) if often else met
    found = seldom.repartition(tasks, *key).groupBy(*key).agg(*counts)
    return found.union(met.where(_share(key).isin(often)).groupBy(*key).agg(*counts)) if often else found


def key_errors(tables: dict[str, DataFrame], spec: dict[str, Table] = SCHEDULE) -> DataFrame:
    """(table, problem, key, n): keys with a null part, keys that repeat, and references whose row is missing (S03), with their rows.

    A reference with a null part refers to nothing and is no error. The keys of a table and the references to it are counted in one grouping
    and need no join: Spark would move an anti join below the counts, where it meets and sorts all rows. Only references of another type than
    the key are joined to it, as they are told as they stand.
    """
    types = lambda name, columns: [tables[name].schema[c].dataType for c in columns]
    references, found = {name: [] for name in spec}, []
    for name, table in spec.items():
        for parent, columns in table.parents.items():
            if types(name, columns) == types(parent, spec[parent].key):
                references[parent].append((name, columns))
                continue
            asked = tables[name].where(_full(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
            have = tables[parent].select(*(F.col(p).alias(c) for p, c in zip(spec[parent].key, columns, strict=True))).distinct()
            lost = asked.join(have, list(columns), "left_anti")
            found.append(lost.select(F.lit(name).alias("table"), F.lit(f"no row in {parent}").alias("problem"), _told(columns).alias("key"), "n"))
    met = []
    for name, table in spec.items():
        key = [f"_k{i}" for i in range(len(table.key))]
        named = lambda columns: (F.col(c).alias(k) for c, k in zip(columns, key, strict=True))
        rows = tables[name].select(*named(table.key), F.lit(0).alias("_from"))
        for i, (child, columns) in enumerate(references[name], 1):
            rows = rows.union(tables[child].where(_full(columns)).select(*named(columns), F.lit(i).alias("_from")))
        met.append((rows, key))
    for name, (rows, key), sizes in zip(spec, met, _shares(met), strict=True):
        counts = [F.count_if(F.col("_from") == i).alias(f"_n{i}") for i in range(len(references[name]) + 1)]
        own, none = F.col("_n0"), ~_full(tuple(key))
        problems = [(name, F.when(none & (own > 0), "null key").when(own > 1, "repeated key"), own)]
        for i, (child, _) in enumerate(references[name], 1):
            problems.append((child, F.when((own == 0) & (F.col(f"_n{i}") > 0), f"no row in {name}"), F.col(f"_n{i}")))
        told = F.array(*(F.struct(F.lit(t).alias("table"), p.alias("problem"), n.alias("n")) for t, p, n in problems))
        wrong = _counted(rows, key, counts, sizes).where(none | (own != 1)).select(_told(tuple(key)).alias("key"), F.inline(told))
        found.append(wrong.where("problem IS NOT NULL").select("table", "problem", "key", "n"))
    return reduce(DataFrame.unionByName, found)


def with_parents(tables: dict[str, DataFrame], name: str, spec: dict[str, Table] = SCHEDULE) -> DataFrame:
    """Rows of a table beside those that they refer to, and beside what these refer to (S03): a struct for each, by its name; null where
    the row is missing. Of a parent's rows that repeat a key the least counts, so no row of the table is multiplied."""

    def nested(at: str) -> DataFrame:
        rows = tables[at]
        for parent, columns in spec[at].parents.items():
            of = nested(parent)
            one = of.groupBy(*spec[parent].key).agg(F.min(F.struct(*of.columns)).alias(parent))
            one = one.select(parent, *(F.col(p).alias(f"_{c}") for p, c in zip(spec[parent].key, columns, strict=True)))
            on = reduce(lambda a, b: a & b, (rows[c] == one[f"_{c}"] for c in columns))
            rows = rows.join(one, on, "left").drop(*(f"_{c}" for c in columns))
        return rows

    return nested(name)
