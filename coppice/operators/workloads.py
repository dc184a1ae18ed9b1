"""Generators of grouped rows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import quantiles, seeded, uniform
from ..model import Forest


def panel(entities: DataFrame, horizon: int, base: str) -> DataFrame:
    """One row per entity and step t of 0..horizon-1, with six features of time; base is the entity's covariate x0."""
    share = F.col("t") / F.lit(float(horizon))
    left = F.lit(horizon - 1) - F.col("t")
    return entities.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumns({
        "t_frac": share, "t_frac_sq": share * share, "t_left": left, "left_frac": left / F.lit(float(horizon)),
        "base_frac": F.col(base) * share, "t_sine": F.sin(F.lit(math.pi) * share)})


def shuffled_sessions(rows: DataFrame, session: str, item: str, seed: int) -> DataFrame:
    """Adds place: a seeded permutation inside each session."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(seeded(seed, item), item)) - 1)


def cohorts(rows: DataFrame, session: str, item: str, sizes: Sequence[int], seed: int) -> DataFrame:
    """Sessions with at least max(sizes) rows; for each size n their first n rows, nested, by seeded order. Adds width, place."""
    group = Window.partitionBy(session)
    held = rows.withColumns({"__all": F.count("*").over(group), "place": F.row_number().over(group.orderBy(seeded(seed, item), item)) - 1})
    held = held.filter(F.col("__all") >= max(sizes)).drop("__all")
    wide = held.withColumn("width", F.explode(F.array(*[F.lit(n) for n in sizes])))
    return wide.filter("place < width")


def whatifs(base: DataFrame, key: str, columns: Sequence[str], variants: int, seed: int) -> DataFrame:
    """Variant 0 is the base; others scale each column by 2**u, u in [-1, 1) drawn by seed; zeros stay zero."""
    wide = base.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    scaled = {c: F.when(F.col("variant") == 0, F.col(c)).otherwise(
        F.col(c) * F.pow(F.lit(2.0), uniform(seed + k, key, "variant") * 2 - 1)) for k, c in enumerate(columns)}
    return wide.withColumns(scaled)


def donor_whatifs(base: DataFrame, donors: DataFrame, key: str, donor_key: str, columns: Sequence[str], variants: int, pool: int, seed: int) -> DataFrame:
    """Variant 0 is the base; variant v > 0 takes all columns jointly from a donor drawn by seed.

    The pool holds the first `pool` donors in seeded order; a top-k, so the frame joined is bounded by it.
    """
    drawn = donors.orderBy(seeded(seed, donor_key), donor_key).limit(pool)
    listed = drawn.agg(F.collect_list(F.struct(seeded(seed, donor_key).alias("__s"), donor_key, *columns)).alias("__all"))
    listed = listed.select(F.posexplode(F.array_sort("__all")).alias("__at", "__donor"))
    wide = base.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    wide = wide.withColumn("__at", F.floor(uniform(seed + 1, key, "variant") * pool).cast("int"))
    joined = wide.join(F.broadcast(listed), "__at", "left")
    own = {c: F.when(F.col("variant") == 0, F.col(c)).otherwise(F.col(f"__donor.{c}")) for c in columns}
    return joined.withColumns(own).drop("__at", "__donor")


def ranked_features(usage: Mapping[int, int], pool: Sequence[int], k: int) -> list[int]:
    """The k features of a pool that most splits take, smaller numbers first on ties; those that no split takes are left out."""
    return sorted((f for f in pool if usage.get(f, 0) > 0), key=lambda f: (-usage[f], f))[:k]


def split_usage(forest: Forest) -> dict[int, int]:
    """Splits of each feature."""
    return dict(Counter(n.feature for tree in forest.trees for n in tree if n.op is not None))


def grid_levels(donors: DataFrame, column: str, n: int) -> list[float]:
    """n levels of a column: its quantiles at (k + 1/2) / n, each a value that occurs. n values come to the driver."""
    found = quantiles(donors, column, [(k + 0.5) / n for k in range(n)], inverted_cdf=True)
    return [r["value"] for r in found.orderBy("at").collect()]


def whatif_grid(base: DataFrame, levels: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every base row at every combination of the given levels; they replace the columns."""
    out = base
    for column, values in levels.items():
        out = out.withColumn(column, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return out


def rows_as_groups(rows: DataFrame, key: Column) -> DataFrame:
    """Each row is its own group; group_id is its key."""
    return rows.withColumn("group_id", key)


def zero_fraction(base: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of base rows where a perturbed column is zero, so that scaling leaves it."""
    any_zero = F.greatest(*[(F.col(c) == 0).cast("int") for c in columns]) if len(columns) > 1 else (F.col(columns[0]) == 0).cast("int")
    return base.agg(F.count("*").alias("n_groups"), F.avg(any_zero).alias("zero_fraction"))


def varying_for_share(usage: Mapping[int, int], target: float) -> tuple[int, ...]:
    """The features whose splits are nearest to the target share of all; smaller, then earlier sets win ties."""
    if len(usage) > 20:
        raise ValueError("at most 20 candidates")
    total = sum(usage.values()) or 1
    sets = (c for n in range(len(usage) + 1) for c in combinations(sorted(usage), n))
    return min(sets, key=lambda c: (abs(sum(usage[f] for f in c) / total - target), len(c), c))


def draw(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement by seeded order."""
    return df.orderBy(seeded(seed, key), key).limit(n)
