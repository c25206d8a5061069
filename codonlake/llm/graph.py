"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm.session import discard, stash


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) of an edge list (u, v); the component is its smallest node.

    Alternates large-star and small-star steps until the edge list stays the same. Every edge
    moves to the smallest known neighbour by a join on the node, never by gathering a node's
    neighbours: the smallest neighbours are aggregated before the shuffle, and the join of a node
    with many edges is one that adaptive execution splits. Each step is written to the shared
    folder. Loops and null ends are left out; a node without an edge to another one isn't returned.
    The number of steps grows with the logarithm of the number of nodes.
    """
    now = stash(
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        mid = stash(large, "large")
        low = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            mid.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        new = stash(small, "small")
        discard(mid)
        discard(now)
        now, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    else:
        raise RuntimeError("components: too many rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


class Classes:
    """Classes of nodes that links merge one batch after another; each batch costs what it merges."""

    def __init__(self) -> None:
        self.rows: DataFrame | None = None  # (node, class)

    def merge(self, links: DataFrame) -> None:
        """Add links (a, b)."""
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.rows is None:
            known, between = ends.withColumn("class", F.col("node")), links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        else:
            old = self.rows
            known = old.unionByName(ends.join(old, "node", "left_anti").withColumn("class", F.col("node")))
            u, v = (old.select(F.col("node").alias(n), F.col("class").alias(c)) for n, c in (("a", "u"), ("b", "v")))
            between = links.join(u, "a", "left").join(v, "b", "left").select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v"))
        found = components(between)
        new = stash(known.join(found.select(F.col("node").alias("class"), "component"), "class", "left").select("node", F.coalesce("component", "class").alias("class")), "classes")
        discard(self.rows)
        self.rows = new

    def of(self, rows: DataFrame, node: str, out: str) -> DataFrame:
        """``rows`` with the class of the column ``node`` (itself where it has no link)."""
        if self.rows is None:
            return rows.withColumn(out, F.col(node))
        mine = self.rows.select(F.col("node").alias(node), F.col("class").alias("__class"))
        return rows.join(mine, node, "left").withColumn(out, F.coalesce("__class", node)).drop("__class")
