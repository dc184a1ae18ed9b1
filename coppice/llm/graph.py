"""Connected components of a link table, distributed: large star and small star in turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, spread_join


#: Links from which on joins on nodes are spread; fewer fit a task, whatever node they have in common.
SPREAD = 1_000_000


def _met(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """Each edge with the smallest neighbour of its node a; one node may have most of n edges."""
    return spread_join(edges, low, "a", "b", parts=16) if n >= SPREAD else edges.join(low, "a")


def _largest(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour that is larger than a node goes to the node's smallest neighbour (itself with them)."""
    both = edges.unionAll(edges.selectExpr("b AS a", "a AS b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _met(both, low, n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _smallest(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return _met(down, low, n).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) of every node of links(a, b); a loop links nothing.

    Each round is two aggregations and two joins on the links; their number
    grows with the logarithm of a component's diameter.  A node may have most of the
    links: joins on nodes of many links are spread.  Lineage is cut by reliable checkpoints.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        edges = checkpointed(_smallest(_largest(edges, state[0]), state[0]))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
