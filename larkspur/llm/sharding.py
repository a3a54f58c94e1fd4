"""K-d tree sharding: rows are split at weighted medians until each leaf is one shard of near equal bytes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, read, shown_id

#: Buckets of a node's histogram; each pass narrows a node to the keys of one bucket.
BUCKETS = 1024
#: Every coordinate is a metadata value (below 2**32) above so many hash bits that break its ties.
TIE_BITS = 30
#: Equal texts of at most this part of a shard's bytes stay together; larger groups can be split anywhere.
WHOLE = 1 / 32
#: Rows of a shard that are numbered together.
SLOT_ROWS = 100_000


@dataclass
class Node:
    """A part of the tree: a leaf is one shard; else keys up to ``last`` in ``dim`` go left."""

    first: int
    shards: int
    dim: int | None = None
    last: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.dim is None else self.left.leaves() + self.right.leaves()

    def pick(self, of: Callable[[Node], Column]) -> Column:
        """``of`` the leaf that a row falls into: nested comparisons, as deep as the tree, over stored columns only."""
        if self.dim is None:
            return of(self)
        return F.when(F.col(f"at{self.dim}") <= self.last, self.left.pick(of)).otherwise(self.right.pick(of))

    def shard(self) -> Column:
        """The first shard of that leaf."""
        return self.pick(lambda leaf: F.lit(leaf.first))


def coordinates(docs: DataFrame, shards: int, overhead: int, id_col: str, text_col: str, labels: tuple[str, ...]) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, at0, at1, ...), written, and the number of dimensions: size, id and each label.

    Equal texts share the coordinates of their smallest row, and a hash of the text breaks ties, so they are one
    point; in a group of more than WHOLE of a shard's bytes a hash of the id breaks ties as well, so it can be split
    anywhere. Groups are counted before their shuffle; rows meet them by a join that adaptive execution can split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = {c.lower(): c for c in docs.columns}
    named = [columns[c] for c in labels if c in columns]
    own = [f"label{i}" for i in range(len(named))]
    rows = cut(
        docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_key"),
            *(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(2**32)).alias(o) for c, o in zip(named, own, strict=True)),
        )
    )
    told = F.col("doc_id") != NULL_ID
    whole = rows.agg(F.sum("size").alias("bytes"), F.min(F.when(told, F.col("doc_id"))).alias("lo"), F.max("doc_id").alias("hi")).first()
    lo = whole["lo"] or 0
    spread = float(max(1, (whole["hi"] or 0) - lo))
    whole_bytes = max(1.0, (whole["bytes"] or 0) / shards * WHOLE)
    same = ["text_key", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", *own)).alias("lead")).where("n > 1")
    joined = rows.join(groups, same, "left")
    lead = lambda c: F.coalesce(F.col("lead")[c], F.col(c))
    large = F.coalesce("n", F.lit(1)) * F.col("size") > whole_bytes
    piece = F.when(large, F.xxhash64("doc_id")).otherwise(F.lit(0).cast("long"))
    tie = F.pmod(F.xxhash64("text_key", "text_crc32", piece), F.lit(1 << TIE_BITS))
    id_value = F.when(lead("doc_id") == NULL_ID, F.lit(0).cast("long")).otherwise(((lead("doc_id").cast("double") - float(lo)) / spread * (2**32 - 1)).cast("long"))
    values = [F.col("size"), id_value, *map(lead, own)]
    at = [(F.shiftleft(F.greatest(F.lit(0), F.least(v, F.lit(2**32 - 1))).cast("long"), TIE_BITS) + tie).alias(f"at{i}") for i, v in enumerate(values)]
    return cut(joined.select("doc_id", "size", "text_crc32", *at)), len(values)


def split_level(points: DataFrame, root: Node, dims: int, whole: list[int]) -> bool:
    """Split every open leaf of the tree along its widest dimension, at the weighted median; False if none has rows.

    One aggregation gives the box and bytes of all open nodes; then histograms of BUCKETS buckets over what is left
    of each node's keys narrow its median to one key. What reaches the driver is a row for each node and bucket.
    """
    open_nodes = {leaf.first: leaf for leaf in root.leaves() if leaf.shards > 1}
    if not open_nodes:
        return False
    ends = [f(f"at{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    state, last, cuts = {}, {}, {}
    for r in points.groupBy(root.shard().alias("node")).agg(F.sum("size").alias("bytes"), *ends).collect():
        if (leaf := open_nodes.get(r["node"])) is not None:
            dim = cuts[r["node"]] = max(range(dims), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / whole[i], -i))
            # dimension, least and largest key that the median may have, bytes that go left less those before the least key
            state[r["node"]] = dim, r[f"lo{dim}"], r[f"hi{dim}"], r["bytes"] * (leaf.shards // 2) / leaf.shards
    found = bool(state)
    while state:
        none, now = F.lit(None).cast("long"), dict(state)

        def key(leaf: Node) -> Column:
            return F.col(f"at{now[leaf.first][0]}") if leaf.first in now else none  # noqa: B023

        def bucket(leaf: Node) -> Column:
            if leaf.first not in now:  # noqa: B023
                return none
            _, lo, hi, _ = now[leaf.first]  # noqa: B023
            return F.when(key(leaf).between(lo, hi), F.floor((key(leaf) - lo) / ((hi - lo) // BUCKETS + 1)))  # noqa: B023

        inside = points.select(root.shard().alias("node"), root.pick(bucket).alias("bucket"), root.pick(key).alias("key"), "size")
        bars = inside.groupBy("node", "bucket").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        after = {}
        told: dict[int, list] = {n: [] for n in state}
        for r in bars.collect():  # BUCKETS rows a node and one for what lies outside
            if r["bucket"] is not None:
                told[r["node"]].append(r)
        for n, (dim, _, _, goal) in state.items():
            before, rows = 0, sorted(told[n], key=lambda r: r["bucket"])
            for r in rows:
                if before + r["bytes"] > goal or r is rows[-1]:
                    break
                before += r["bytes"]
            if r["lo"] == r["hi"]:  # one key: it goes to the side that comes nearer to the goal
                last[n] = r["lo"] if (goal - before) * 2 > r["bytes"] else r["lo"] - 1
            else:
                after[n] = dim, r["lo"], r["hi"], goal - before
        state = after
    for leaf in open_nodes.values():  # a node without rows is split as well, so that the tree has all shards
        leaf.left, leaf.right = Node(leaf.first, leaf.shards // 2), Node(leaf.first + leaf.shards // 2, leaf.shards - leaf.shards // 2)
        leaf.dim, leaf.last = cuts.get(leaf.first, 0), last.get(leaf.first, 0)
    return found


def kd_shards(
    docs: DataFrame, shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text",
    labels: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: sizes (UTF-8 bytes of the text plus ``overhead``) are near equal over the shards. A node
    that stands for k > 1 shards is split along its widest dimension, in proportion k//2 to the rest, at the
    weighted median; the dimensions are size, id and each label column (by hash), each scaled by its range in
    the whole table. Medians are exact and distributed: histograms of all nodes of a level at once, narrowed
    until one key is left. The tree is data on the driver (a node for each shard) and one expression of nested
    comparisons in the plan. Only a narrow table (id, size, checksum, coordinates) is read by the passes; the
    texts are read once.

    Equal texts are one point and stay in one shard as long as they have at most WHOLE of a shard's bytes; a larger
    group can be split anywhere. So a label, source or group of copies that holds a third of all rows
    is split like any other, and shards differ by little more than WHOLE plus the largest text.

    Slots count from 0 without gaps within a shard; they are given in parts of about SLOT_ROWS rows, placed by
    the counts of the parts. Null text has no bytes; null ids and labels are values of their own; rows that repeat
    an id stay separate rows. ``grown_shard`` is null under this law. An empty table gives an empty result.
    """
    points, dims = coordinates(docs, shards, overhead, id_col, text_col, labels)
    ends = [f(f"at{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    box = points.agg(F.count("*").alias("n"), *ends).first()
    whole = [max(1, (box[f"hi{i}"] or 0) - (box[f"lo{i}"] or 0)) for i in range(dims)]
    root = Node(0, shards)
    while split_level(points, root, dims, whole):
        pass
    parts = 1 + box["n"] // (shards * SLOT_ROWS)
    placed = points.select("doc_id", "size", "text_crc32", root.shard().alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(8 * parts)).cast("int").alias("part"))
    by_shard = Window.partitionBy("shard").orderBy("part")  # a row a part
    starts = placed.groupBy("shard", "part").count().select("shard", "part", (F.sum("count").over(by_shard) - F.col("count")).alias("start"))
    in_part = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    return placed.withColumn("n", F.row_number().over(in_part)).join(starts, ["shard", "part"]).select(
        shown_id(), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(read(spark, sf_dir, "documents"), shards=40)
