"""Views of a forest: nodes, trees, feature ranges, tree order, shared prefixes and expected walks.

All are of the model's size, which LoadOptions bounds, not of the data's.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import NODE_SCHEMA, Forest


def nodes(spark: SparkSession, forest: Forest) -> DataFrame:
    """One row for each node (see NODE_SCHEMA)."""
    return spark.createDataFrame(forest.node_rows(), NODE_SCHEMA)


def trees(spark: SparkSession, forest: Forest) -> DataFrame:
    """tree, its first node's place among all nodes, its nodes, leaves, listed categories, and whether its order of nodes is that of a table."""
    per_tree = nodes(spark, forest).groupBy("tree").agg(
        F.count("*").alias("n_nodes"), F.count_if("is_leaf").alias("n_leaves"), F.coalesce(F.sum(F.size("categories")), F.lit(0)).cast("bigint").alias("n_categories"))
    start = F.coalesce(F.sum("n_nodes").over(Window.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per_tree.withColumn("node_start", start.cast("bigint"))


def feature_ranges(spark: SparkSession, forest: Forest) -> DataFrame:
    """For each feature and kind of split the contiguous range of predicate numbers, and how many splits take them."""
    splits = nodes(spark, forest).where("not is_leaf").withColumn("categorical", F.col("op") == "in")
    return splits.groupBy("feature", "categorical").agg(
        F.min("predicate").cast("bigint").alias("first"), F.max("predicate").cast("bigint").alias("last"), F.count_distinct("predicate").alias("n_predicates"), F.count("*").alias("n_splits"))


def heavy_path(forest: Forest, tree: int) -> list[int]:
    """Predicates of the splits on the path that takes the heavier child at each of them, left on ties."""
    out, at = [], forest.trees[tree][0]
    node = 0
    while at.op is not None:
        out.append(forest.predicate_ids[at.predicate])
        node = at.left if forest.heavy_left(tree, node) else at.right
        at = forest.trees[tree][node]
    return out


def tree_order(spark: SparkSession, forest: Forest) -> DataFrame:
    """place, tree and path: trees sorted by the predicates of their heavy paths, so that trees that start alike are neighbours."""
    rows = [(k, heavy_path(forest, k)) for k in range(len(forest.trees))]
    frame = spark.createDataFrame(rows, "tree INT, path ARRAY<INT>")
    return frame.select((F.row_number().over(Window.orderBy("path", "tree")) - 1).cast("bigint").alias("place"), F.col("tree").cast("bigint").alias("tree"), F.size("path").cast("bigint").alias("n_splits"))


def prefix_groups(spark: SparkSession, forest: Forest, constant: Iterable[int]) -> DataFrame:
    """Trees whose heavy paths start with the same constant split, and the length of the constant prefix that all of them share.

    Of sorted paths the first and the last share what all share.  saved_steps are
    the steps of an entity's walk that evaluating a prefix once saves.
    """
    held = set(constant)
    fixed = [p[0] in held for p in forest.predicates]
    rows = []
    for k in range(len(forest.trees)):
        path = heavy_path(forest, k)
        upto = next((j for j, p in enumerate(path) if not fixed[p]), len(path))
        if upto:
            rows.append((k, path[:upto]))
    grouped = spark.createDataFrame(rows, "tree INT, path ARRAY<INT>").groupBy(F.col("path")[0].cast("bigint").alias("predicate")).agg(
        F.count("*").alias("n_trees"), F.min("path").alias("low"), F.max("path").alias("high"))
    alike = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
    depth = F.coalesce(F.nullif(F.array_position(alike, False), F.lit(0)) - 1, F.size(alike).cast("bigint"))
    return grouped.select("predicate", "n_trees", depth.alias("depth")).withColumn("saved_steps", (F.col("n_trees") - 1) * F.col("depth"))


def walk_masses(spark: SparkSession, forest: Forest, varying: Iterable[int], split: bool) -> DataFrame:
    """tree, node, mass, is_leaf and is_varying: the weight of a group that reaches each node, level by level.

    At constant splits a group goes as the training weight went, halves where it has
    none; at varying ones too, or, with split, its whole weight goes both ways.
    """
    table = nodes(spark, forest)
    weight = table.select("tree", F.col("node").alias("child"), "weight")
    left, right = weight.select("tree", F.col("child").alias("left_id"), F.col("weight").alias("wl")), weight.select("tree", F.col("child").alias("right_id"), F.col("weight").alias("wr"))
    share = F.when(F.col("wl") + F.col("wr") > 0, F.col("wl") / (F.col("wl") + F.col("wr"))).otherwise(0.5)
    is_varying = F.coalesce(F.col("feature").isin(sorted(varying)), F.lit(False))
    known = table.join(left, ["tree", "left_id"], "left").join(right, ["tree", "right_id"], "left").select(
        "tree", "node", "is_leaf", "left_id", "right_id", is_varying.alias("is_varying"), share.alias("share"))
    level = known.where("node = 0").withColumn("mass", F.lit(1.0))
    out = level
    for _ in range(forest.depth):
        both = F.col("is_varying") & F.lit(split)
        children = F.array(
            F.struct(F.col("left_id").alias("node"), F.when(both, F.col("mass")).otherwise(F.col("mass") * F.col("share")).alias("mass")),
            F.struct(F.col("right_id").alias("node"), F.when(both, F.col("mass")).otherwise(F.col("mass") * (1 - F.col("share"))).alias("mass")))
        level = level.where("not is_leaf").select("tree", F.explode(children).alias("c")).select("tree", "c.node", "c.mass").join(known, ["tree", "node"])
        out = out.unionByName(level)
    return out.select("tree", "node", "mass", "is_leaf", "is_varying")


def walk_shares(spark: SparkSession, forest: Forest, varying: Iterable[int]) -> DataFrame:
    """For groups that never and that always split at varying features: the shares of walk steps that stop at a varying split (phi) or a leaf (lambda)."""
    out = None
    for mode, split in (("never_split", False), ("always_split", True)):
        masses = walk_masses(spark, forest, varying, split)
        one = masses.agg(F.sum(F.when(F.col("is_leaf"), F.col("mass"))).alias("leaf"), F.coalesce(F.sum(F.when(F.col("is_varying"), F.col("mass"))), F.lit(0.0)).alias("stops"), F.sum("mass").alias("steps"))
        one = one.select(F.lit(mode).alias("mode"), (F.col("stops") / F.col("steps")).alias("phi"), (F.col("leaf") / F.col("steps")).alias("lambda"), ((F.col("stops") + F.col("leaf")) / F.col("steps")).alias("events_per_step"))
        out = one if out is None else out.unionByName(one)
    return out


def model_stats(spark: SparkSession, forest: Forest, varying: Iterable[int]) -> DataFrame:
    """One row: trees, nodes, share of splits on varying features, expected steps to a leaf for each tree."""
    table = nodes(spark, forest)
    splits = table.where("not is_leaf")
    share = splits.agg(F.avg(F.col("feature").isin(sorted(varying)).cast("double")).alias("varying_share"))
    steps = walk_masses(spark, forest, varying, False).agg((F.sum(F.when(~F.col("is_leaf"), F.col("mass"))) / len(forest.trees)).alias("steps_leaf"))
    sizes = table.agg(F.count_distinct("tree").alias("n_trees"), F.count("*").alias("n_nodes"), F.count_if("is_leaf").alias("n_leaves"), F.count_distinct("predicate").alias("n_predicates"))
    return sizes.join(share).join(steps)
