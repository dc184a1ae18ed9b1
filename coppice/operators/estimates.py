"""Estimates of a run: crossed bootstraps of ratios and nested medians, flags, work per row.

Draws are relations: a draw of n units with replacement is a table of weights that
follows from n, the seed and the draw's number, so all methods and all cells of one
shape share their draws (paired), and any task can make its own again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import uniform


def unit_weights(shapes: DataFrame, draws: int, seed: int) -> DataFrame:
    """n, draw, unit and weight (drawn at least once) for each distinct n of shapes(n)."""
    picks = shapes.select("n").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("pick", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    unit = F.floor(uniform(seed, "n", "draw", "pick") * F.col("n")).cast("bigint")
    return picks.select("n", "draw", unit.alias("unit")).groupBy("n", "draw", "unit").agg(F.count("*").alias("weight"))


def _numbered(df: DataFrame, cell: Sequence[str], column: str, name: str) -> DataFrame:
    """Places of the distinct values of a column in each cell, and their number."""
    units, keys = df.select(*cell, column).distinct(), Window.partitionBy(*cell)
    return units.withColumn(name, F.row_number().over(keys.orderBy(column)) - 1).withColumn(f"n_{name}", F.count("*").over(keys))


def _interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    bounds = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return df.groupBy(*keys).agg(bounds.alias("__b")).select(*keys, F.col("__b")[0].alias("low"), F.col("__b")[1].alias("high"))


def crossed_ratio(df: DataFrame, cell: Sequence[str], entity: str, round_: str, top: Column, bottom: Column, draws: int, seed: int) -> DataFrame:
    """sum(top) / sum(bottom) of each cell with a 95% interval; entities and rounds are redrawn as crossed clusters.

    Rows are summed by entity and round first; a draw then weighs those sums.
    """
    cell = list(cell)
    totals = df.groupBy(*cell, entity, round_).agg(F.sum(top).cast("double").alias("__a"), F.sum(bottom).cast("double").alias("__b"))
    placed = totals.join(_numbered(df, cell, entity, "__e"), [*cell, entity]).join(_numbered(df, cell, round_, "__r"), [*cell, round_])
    by_entity = unit_weights(placed.select(F.col("n___e").alias("n")), draws, seed).select(F.col("n").alias("n___e"), "draw", F.col("unit").alias("__e"), F.col("weight").alias("__we"))
    by_round = unit_weights(placed.select(F.col("n___r").alias("n")), draws, seed + 1).select(F.col("n").alias("n___r"), "draw", F.col("unit").alias("__r"), F.col("weight").alias("__wr"))
    first = placed.join(by_entity, ["n___e", "__e"]).groupBy(*cell, "n___r", "__r", "draw").agg(F.sum(F.col("__a") * F.col("__we")).alias("__a"), F.sum(F.col("__b") * F.col("__we")).alias("__b"))
    drawn = first.join(by_round, ["n___r", "__r", "draw"]).groupBy(*cell, "draw").agg((F.sum(F.col("__a") * F.col("__wr")) / F.sum(F.col("__b") * F.col("__wr"))).alias("ratio"))
    whole = df.groupBy(*cell).agg((F.sum(top).cast("double") / F.sum(bottom)).alias("ratio"))
    return whole.join(_interval(drawn, cell, "ratio"), cell, "left")


def clustered_ratio(df: DataFrame, cell: Sequence[str], cluster: str, top: Column, bottom: Column, draws: int, seed: int) -> DataFrame:
    """sum(top) / sum(bottom) of each cell with a 95% interval over redrawn clusters."""
    cell = list(cell)
    totals = df.groupBy(*cell, cluster).agg(F.sum(top).cast("double").alias("__a"), F.sum(bottom).cast("double").alias("__b"))
    placed = totals.join(_numbered(df, cell, cluster, "__e"), [*cell, cluster])
    weights = unit_weights(placed.select(F.col("n___e").alias("n")), draws, seed).select(F.col("n").alias("n___e"), "draw", F.col("unit").alias("__e"), F.col("weight").alias("__we"))
    drawn = placed.join(weights, ["n___e", "__e"]).groupBy(*cell, "draw").agg((F.sum(F.col("__a") * F.col("__we")) / F.sum(F.col("__b") * F.col("__we"))).alias("ratio"))
    whole = df.groupBy(*cell).agg((F.sum(top).cast("double") / F.sum(bottom)).alias("ratio"))
    return whole.join(_interval(drawn, cell, "ratio"), cell, "left")


def _upper_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """The value at place total // 2 of each key's values, each repeated as often as it weighs."""
    same = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    group = Window.partitionBy(*keys)
    ranked = same.withColumns({"__upto": F.sum("__w").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__half": F.floor(F.sum("__w").over(group) / 2)})
    return ranked.where("__upto > __half").groupBy(*keys).agg(F.min(value).alias(name))


def nested_median_ratios(df: DataFrame, cell: str, method: str, block: str, entity: str, round_: str, value: str, reference: str, draws: int, seed: int) -> DataFrame:
    """Each method's latency (the median over blocks of medians in blocks) and its ratio to the reference's, with a 95% interval.

    A draw weighs entities in blocks and, by their rounds, the blocks, alike for all
    methods of a cell; a draw that leaves a method or the reference no sample is left out.
    """
    rows = df.withColumn("__one", F.lit(1).cast("bigint"))
    once = _upper_median(_upper_median(rows, [cell, method, block], value, "__one", "__m").withColumn("__one", F.lit(1).cast("bigint")), [cell, method], "__m", "__one", "latency")
    placed = df.join(_numbered(df, [cell], entity, "__e"), [cell, entity]).join(_numbered(df, [cell], round_, "__r"), [cell, round_])
    by_entity = unit_weights(placed.select(F.col("n___e").alias("n")), draws, seed).select(F.col("n").alias("n___e"), "draw", F.col("unit").alias("__e"), F.col("weight").alias("__we"))
    by_round = unit_weights(placed.select(F.col("n___r").alias("n")), draws, seed + 1).select(F.col("n").alias("n___r"), "draw", F.col("unit").alias("__r"), F.col("weight").alias("__wr"))
    inner = _upper_median(placed.join(by_entity, ["n___e", "__e"]), [cell, method, block, "n___r", "__r", "draw"], value, "__we", "__m")
    drawn = _upper_median(inner.join(by_round, ["n___r", "__r", "draw"]), [cell, method, "draw"], "__m", "__wr", "latency")
    base = drawn.where(F.col(method) == reference).select(cell, "draw", F.col("latency").alias("base"))
    ratios = drawn.join(base, [cell, "draw"]).withColumn("ratio", F.col("latency").cast("double") / F.col("base"))
    base_once = once.where(F.col(method) == reference).select(cell, F.col("latency").alias("base"))
    whole = once.join(base_once, cell).select(cell, method, "latency", (F.col("latency").cast("double") / F.col("base")).alias("ratio"))
    return whole.join(_interval(ratios, [cell, method], "ratio"), [cell, method], "left")


def wide_intervals(estimates: DataFrame, keys: Sequence[str], percent: float) -> DataFrame:
    """For each key, the contrast whose interval's half-width is the largest percentage of its ratio, of those above percent, and how many are."""
    half = 100 * (F.col("high") - F.col("low")) / 2 / F.col("ratio")
    wide = estimates.where("low is not null").withColumn("half_percent", half).where(F.col("half_percent") > percent)
    rest = [c for c in estimates.columns if c not in (*keys, "low", "high", "ratio")]
    widest = F.max_by(F.struct(*rest, "half_percent"), F.struct("half_percent", *rest)) if rest else F.max(F.struct("half_percent"))
    return wide.groupBy(*keys).agg(widest.alias("__w"), F.count("*").alias("n_wide")).select(*keys, "__w.*", "n_wide")


def work_terms(version: str = "version", trees: str = "trees") -> dict[str, Column]:
    """Counters of a run in the terms of all versions: version 2 has them as they are, 3 to 7 count steps and events.

    In version 3 single rows write a leaf of every tree besides.
    """
    v = F.col(version)
    leaves = F.col("leaf_events") + F.when(v == 3, F.col("single_rows") * F.col(trees)).otherwise(0)
    later = v.between(3, 7)
    return {
        "constant_steps": F.when(v == 2, F.col("constant_steps")).when(later, F.col("walk_steps") + F.col("prefix_steps") - F.col("varying_events") - leaves),
        "varying_splits": F.when(v == 2, F.col("varying_splits")).when(later, F.col("varying_events")),
        "leaf_hits": F.when(v == 2, F.col("leaf_hits")).when(later, leaves),
        "unsplit_skips": F.when(v == 2, F.col("unsplit_skips")).when(later, F.col("varying_events") - F.col("splits")),
    }


def work_per_row(constant_steps: Column, varying_splits: Column, predicate_rows: Column, rows: Column, groups: Column, trees: Column | int, levels: Column | int) -> Column:
    """A row's steps as a share of the trees * levels steps of a full walk: shared steps by group, and a leaf of each tree."""
    trees, levels = (F.lit(x) if isinstance(x, int) else x for x in (trees, levels))
    width = rows / groups
    return ((constant_steps + varying_splits + predicate_rows) / groups + width * trees) / width / (trees * levels)
