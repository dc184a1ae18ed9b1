"""Scoring by masks: rows of a group as bits, a frontier of (group, tree, node, mask) walked level by level."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import NODE_SCHEMA, Forest
from .cases import WORD, condition, stage_columns

#: A node table up to this many nodes is broadcast (about 100 bytes a node); larger forests take the walker.
BROADCAST_NODES = 200_000


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds __word and __bit: the place of a row in its group, in words of 63 rows."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return rows.withColumn("__place", place).withColumns(
        {"__word": (F.col("__place") / WORD).cast("int"), "__bit": (F.col("__place") % WORD).cast("int")}
    ).drop("__place")


def predicate_masks(rows: DataFrame, group: str, order: Sequence[str], forest: Forest, features: Sequence[str]) -> DataFrame:
    """group, word, predicate, mask: the rows of the word that go left at each distinct predicate."""
    masks = _masks(numbered(rows, group, order), group, forest, features)
    return masks.select(group, F.col("__word").alias("word"), F.posexplode("__masks").alias("predicate", "mask"))


def _masks(rows: DataFrame, group: str, forest: Forest, features: Sequence[str]) -> DataFrame:
    """Per group and word, the masks of all predicates as an array; partial aggregation before the shuffle."""
    names = [f"__f{k}" for k in range(len(features))]
    held = rows.select(group, "__word", "__bit", *[
        F.coalesce(F.col(f).cast("double"), F.lit(math.nan)).alias(h) for f, h in zip(features, names, strict=True)])
    aggregates = [
        F.expr(f"bit_or(CASE WHEN {condition(forest, p, names[p[0]])} THEN shiftleft(1L, __bit) ELSE 0L END)").alias(f"__m{k}")
        for k, p in enumerate(forest.predicates)
    ]
    full = F.expr("bit_or(shiftleft(1L, __bit))").alias("__full")
    masked = held.groupBy(group, "__word").agg(full, *aggregates)
    masks = F.array(*[f"__m{k}" for k in range(len(aggregates))]) if aggregates else F.array().cast("array<bigint>")
    return masked.select(group, "__word", "__full", masks.alias("__masks"))


def walk(rows: DataFrame, group: str, forest: Forest, features: Sequence[str]) -> DataFrame:
    """Every visit of a node by rows of a group: group, word, level, mask, is_leaf, leaf_fixed, predicate.

    From numbered rows. Each level adds to the visits the children whose mask is not
    empty, so the walk is one narrow pass after the aggregation of masks.
    """
    if forest.n_nodes > BROADCAST_NODES or forest.sum_plan.kind == "wide":
        raise ValueError("this forest takes the walker")
    nodes = F.broadcast(rows.sparkSession.createDataFrame(forest.node_rows(), NODE_SCHEMA).select(
        "tree", "node", "is_leaf", "left_id", "right_id", "leaf_fixed", "predicate"))
    visits = _masks(rows, group, forest, features).select(
        group, "__word", "__masks", F.col("__full").alias("__mask"), F.explode(F.sequence(F.lit(0), F.lit(len(forest.trees) - 1))).alias("tree"),
        F.lit(0).alias("node"), F.lit(0).alias("level"), F.lit(True).alias("__live"))

    def visit(node: str, mask: str, level: str, live: bool):
        return F.struct(F.expr(node).alias("node"), F.expr(mask).alias("mask"), F.expr(level).alias("level"), F.lit(live).alias("live"))

    itself = visit("node", "__mask", "level", False)
    after = F.array(itself, visit("left_id", "__masks[predicate] & __mask", "level + 1", True),
                    visit("right_id", "__mask & ~__masks[predicate]", "level + 1", True))
    for _ in range(forest.depth):
        at = visits.join(nodes, ["tree", "node"])
        at = at.select(group, "__word", "__masks", "tree", F.explode(F.when(F.expr("__live AND NOT is_leaf"), after).otherwise(F.array(itself))).alias("__v"))
        visits = at.filter("__v.mask <> 0").select(
            group, "__word", F.when(F.col("__v.live"), F.col("__masks")).alias("__masks"), F.col("__v.mask").alias("__mask"), "tree",
            F.col("__v.node").alias("node"), F.col("__v.level").alias("level"), F.col("__v.live").alias("__live"))
    return visits.drop("__masks", "__live").join(nodes, ["tree", "node"])


def score(rows: DataFrame, group: str, order: Sequence[str], forest: Forest, features: Sequence[str]) -> DataFrame:
    """The rows with tree_sum, raw_margin and output; order has to be total inside a group."""
    placed = numbered(rows, group, order)
    if not forest.trees:
        return placed.withColumns(stage_columns(forest, F.lit(0).cast("bigint"))).drop("__word", "__bit")
    leaves = walk(placed, group, forest, features).filter("is_leaf")
    kind = "DECIMAL(38,0)" if forest.sum_plan.kind == "decimal" else "BIGINT"
    bits = F.expr(f"filter(sequence(0, {WORD - 1}), b -> (shiftright(__mask, b) & 1L) <> 0L)")
    sums = leaves.select(group, "__word", F.explode(bits).alias("__bit"), F.col("leaf_fixed").cast(kind).alias("__leaf")).groupBy(
        group, "__word", "__bit").agg(F.sum("__leaf").cast(kind).alias("__sum"))
    return placed.join(sums, [group, "__word", "__bit"]).withColumns(stage_columns(forest, F.col("__sum"))).drop("__sum", "__word", "__bit")


def counters(rows: DataFrame, group: str, order: Sequence[str], forest: Forest, features: Sequence[str], constant: set[int]) -> DataFrame:
    """Logical work of the masked walk: level, constant and varying split events, leaf events, rows at leaves."""
    varying = [k for k, p in enumerate(forest.predicates) if p[0] not in constant]
    is_varying = F.coalesce(F.col("predicate").isin(varying), F.lit(False))
    leaf_rows = F.coalesce(F.sum(F.when(F.col("is_leaf"), F.bit_count("__mask"))), F.lit(0)).cast("bigint")
    return walk(numbered(rows, group, order), group, forest, features).groupBy(F.col("level").cast("bigint").alias("level")).agg(
        F.count_if(~F.col("is_leaf") & ~is_varying).alias("constant_events"), F.count_if(~F.col("is_leaf") & is_varying).alias("varying_events"),
        F.count_if("is_leaf").alias("leaf_events"), leaf_rows.alias("leaf_rows"))
