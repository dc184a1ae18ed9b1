"""Preparing entity data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import first_in_order, quantiles, seeded, uniform


def fit_codes(train: DataFrame, column: str) -> DataFrame:
    """column, code: distinct values of the training rows in order, numbered from 0."""
    values = train.select(column).where(F.col(column).isNotNull()).distinct()
    return values.withColumn("code", F.dense_rank().over(Window.orderBy(column)) - 1)


def encode(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Adds code; values not seen in training get null."""
    return df.join(codes, column, "left")


def split_entities(df: DataFrame, key: str, test_share: float, seed: int) -> DataFrame:
    """Adds is_test, equal for all rows of an entity; no shuffle."""
    return df.withColumn("is_test", uniform(seed, key) < test_share)


def quantile_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: edges, distinct interpolated quantiles at 1/bins, 2/bins, ... below 1."""
    found = quantiles(df, column, [k / bins for k in range(1, bins)])
    return found.agg(F.array_sort(F.collect_set("value")).alias("edges"))


def digitize(column: Column, edges: Column) -> Column:
    """Number of edges at or below the value, at most the last bin."""
    return F.least(F.size(F.filter(edges, lambda e: e <= column)), F.size(edges)).cast("bigint")


def survival_rows(df: DataFrame, step: str, event: str) -> DataFrame:
    """A row per step from 0 to the entity's last; label 1 only at the last step of an event."""
    return df.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(step)))).withColumn(
        "label", F.when((F.col("t") == F.col(step)) & F.col(event), 1).otherwise(0))


def usable_sessions(rows: DataFrame, session: str, low: int, high: int, constant: Sequence[str]) -> DataFrame:
    """Rows of sessions of low..high rows whose session-level columns don't vary (nulls don't count)."""
    checks = [F.min(c).alias(f"__lo_{c}") for c in constant] + [F.max(c).alias(f"__hi_{c}") for c in constant]
    sizes = rows.groupBy(session).agg(F.count("*").alias("__n"), *checks)
    kept = sizes.filter(F.col("__n").between(low, high))
    moving = F.lit(False)
    for c in constant:
        moving = moving | F.coalesce(F.col(f"__lo_{c}") != F.col(f"__hi_{c}"), F.lit(False))
    in_size = rows.join(kept.select(session), session, "left_semi")
    return in_size.join(kept.filter(moving).select(session), session, "left_anti")


def fill_below(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the training minimum less one; a column without training values gets -1."""
    lows = train.agg(*[F.coalesce(F.min(F.nanvl(F.col(c).cast("double"), F.lit(None))) - 1, F.lit(-1.0)).alias(f"__lo_{c}") for c in columns])
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.col(f"__lo_{c}")) for c in columns}
    # lows is one row
    return df.join(F.broadcast(lows)).withColumns(filled).drop(*[f"__lo_{c}" for c in columns])


def replicate(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Rows of round(n * share) entities drawn by seeded order; no task ranks more than a small range of the entities."""
    entities = df.select(key).distinct().withColumn("__all", F.lit(0))
    quota = entities.groupBy("__all").agg(F.floor(F.count("*") * F.lit(share) + 0.5).alias("quota"))
    chosen = first_in_order(entities, ["__all"], seeded(seed, key), key, quota)
    return df.join(chosen.select(key), key, "left_semi")


def clean_name(column: Column) -> Column:
    """Characters that LightGBM forbids in names become underscores."""
    return F.regexp_replace(column, r'[^A-Za-z0-9_]+', "_")


def cell_parts(cell: Column) -> Column:
    """A cell's name, `dataset/nt500_md4_h16/framework/workload`, as a struct; parts that are absent are null."""
    def part(pattern: str, kind: str = "string") -> Column:
        found = F.regexp_extract(cell, pattern, 1)
        return F.when(found != "", found).cast(kind)

    return F.struct(
        part("^([^/]+)/").alias("dataset"), part("/nt([0-9]+)", "bigint").alias("n_trees"), part("_md([0-9]+)", "bigint").alias("depth"),
        part("_h([0-9]+)", "bigint").alias("horizon"), part("^[^/]+/[^/]+/([^/]+)/").alias("framework"), part("^[^/]+/[^/]+/[^/]+/([^/]+)").alias("workload"))


def threshold_bin(column: Column, thresholds: Sequence[float], inclusive: bool = False) -> Column:
    """Number of distinct thresholds below a value (at or below it with inclusive); missing values are above all, as Spark orders NaN.

    A balanced search by nested comparisons, inside generated code.
    """
    edges = sorted(set(thresholds))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low).cast("bigint")
        middle = (low + high) // 2
        above = column >= edges[middle] if inclusive else column > edges[middle]
        return F.when(above, search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(edges))
