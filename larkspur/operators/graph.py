"""Reachability and components over edges, in rounds that grow with the logarithm of a path's length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import dropped, written

#: Tables of visited nodes that are read together; then they are written as one.
TOGETHER = 16


class Shortcuts:
    """Edges, and the jumps of 2, 4, 8, ... steps along each node's least and along its greatest successor: one more length with
    each ``longer``.

    A jump leads where edges lead, so reachability is that of the edges, while a path that keeps to one of the two takes as many hops
    as its length has binary digits; where paths fork otherwise, hops are single steps. Jumps that end leave no row;
    those around a cycle stop at the number of nodes.
    """

    def __init__(self, edges: DataFrame):
        self.tables = [written(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())]
        self.jump: DataFrame | None = None
        self.length, self.most = 1, self.tables[0].select("a").distinct().count()

    def longer(self) -> None:
        if self.length >= self.most:
            return
        base = self.jump
        if base is None:
            ends = self.tables[0].groupBy("a").agg(F.array_distinct(F.array(F.min("b"), F.max("b"))).alias("ends"))
            base = ends.select("a", F.posexplode("ends").alias("way", "b"))
            # a node with one successor is on both ways
            base = base.unionByName(ends.where("size(ends) = 1").select("a", F.lit(1).alias("way"), F.col("ends")[0].alias("b")))
        following = base.select("way", F.col("a").alias("b"), F.col("b").alias("c"))
        after = written(base.join(following, ["way", "b"]).select("a", "way", F.col("c").alias("b")).where("a <> b"))
        self.jump, self.length = after, 2 * self.length
        self.tables.append(after)
        if after.isEmpty():
            self.most = 0

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, [t.select("a", "b") for t in self.tables])

    def close(self) -> None:
        for table in self.tables:
            dropped(table)


class Visited:
    """(*by, node) rows that were reached, and those reached last."""

    def __init__(self, rows: DataFrame, by: str):
        self.by = by
        self.fresh = written(rows.select(by, "node").where(f"{by} IS NOT NULL AND node IS NOT NULL").distinct())
        self.tables = [self.fresh]

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, self.tables)

    def step(self, edges: DataFrame) -> DataFrame:
        """Go on from the last nodes over edges (a, b), and leave out nodes that were seen, so cycles end."""
        ahead = self.fresh.join(edges.select(F.col("a").alias("node"), "b"), "node").select(self.by, F.col("b").alias("node")).distinct()
        self.fresh = written(ahead.join(self.all(), [self.by, "node"], "left_anti"))
        self.tables.append(self.fresh)
        if len(self.tables) > TOGETHER:
            self.keep(self.all())
        return self.fresh

    def keep(self, rows: DataFrame) -> None:
        """``rows`` as the only visited ones, written as one table; the last ones are those that are also fresh."""
        whole = written(rows)
        fresh = written(self.fresh.join(whole, [self.by, "node"], "left_semi"))
        self.close()
        self.tables, self.fresh = [whole], fresh

    def close(self) -> None:
        for table in self.tables:
            dropped(table)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): every node that edges (a, b) lead to from each start, itself included.

    A round goes on from the nodes that were new in the last one, over edges and over jumps whose length doubles with each
    round (see ``Shortcuts``): a chain of 10 000 edges takes some 15 rounds. No depth is set, and cycles end. Rounds are written and
    those of the jumps removed; the driver learns whether a round was empty. Edges with a null end, and null starts, are left out.
    The result is as large as what is asked for: all starts mean the whole closure. ``paths_exist`` answers pairs without it.
    """
    ways = Shortcuts(edges)
    seen = Visited(starts.select("start", F.col("start").alias("node")), "start")
    while not seen.fresh.isEmpty():
        ways.longer()
        seen.step(ways.all())
    ways.close()
    return seen.all()


def paths_exist(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose edges lead from a to b, a itself included.

    Both ends move at once and a pair is answered where they meet; each round moves the side that has fewer new nodes, over
    edges and doubling jumps. Pairs that are answered, or one of whose sides has nowhere to go, are dropped from both sides,
    so no closure is built. Pairs with a null end have no path.
    """
    asked = written(pairs.select("a", "b").distinct().where("a IS NOT NULL AND b IS NOT NULL").withColumn("pair", F.monotonically_increasing_id()))
    ways = Shortcuts(edges)
    sides = [Visited(asked.select("pair", F.col(c).alias("node")), "pair") for c in ("a", "b")]
    met = [written(asked.where("a = b").select("pair"))]
    while True:
        done = reduce(DataFrame.union, met)
        counts = []
        for side in sides:
            side.fresh = side.fresh.join(done, "pair", "left_anti")
            counts.append(side.fresh.count())
        if not all(counts):
            break
        ways.longer()
        on = counts.index(min(counts))
        way = ways.all() if on == 0 else ways.all().select(F.col("b").alias("a"), F.col("a").alias("b"))
        fresh = sides[on].step(way)
        met.append(written(fresh.join(sides[1 - on].all(), ["pair", "node"], "left_semi").select("pair").distinct()))
        # a pair with a side that is at its end has no other answer
        going = fresh.select("pair").distinct()
        sides[1 - on].fresh = written(sides[1 - on].fresh.join(going, "pair", "left_semi"))
        if len(met) > TOGETHER:
            whole = written(reduce(DataFrame.union, met).distinct())
            for table in met:
                dropped(table)
            met = [whole]
    ways.close()
    for side in sides:
        side.close()
    return asked.join(reduce(DataFrame.union, met).distinct(), "pair", "left_semi").select("a", "b")


def refused_edges(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Those of the proposed edges (a, b) that would close a cycle with the edges there are (G02): b already leads to a."""
    closing = paths_exist(edges, proposed.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return proposed.join(closing.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), written: root is the least node that they connect it with.

    Each round hangs every node on its least smaller neighbour, follows these to their ends by doubling, and goes on with the
    edges between ends: at least half of the nodes that still have edges are gone after two rounds. Edges with a null end are left out.
    """
    known = edges.where("a IS NOT NULL AND b IS NOT NULL")
    roots = written(known.select(F.col("a").alias("node")).union(known.select("b")).distinct().withColumn("root", F.col("node")))
    links = written(known.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not links.isEmpty():
        up = written(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            after = written(up.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
            moved = not after.where("moved").isEmpty()
            dropped(up)
            up = after.drop("moved")
            if not moved:
                break
        step = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        now = written(roots.join(step, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
        for c in ("a", "b"):
            links = links.join(up.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        fewer = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        for table in (roots, up):
            dropped(table)
        roots, links = now, fewer
    return roots
