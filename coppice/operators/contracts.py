"""Checks of what the grouping configuration promises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import GroupingConfig


def constant_violations(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Groups where a column is not constant (missing equals missing): group, feature.

    min and max decide, with partial aggregation; distinct counts are not needed.
    """
    def value(c):
        return F.nanvl(F.col(c).cast("double"), F.lit(None))

    checks = [((F.min(value(c)) < F.max(value(c))) | ((F.count(value(c)) > 0) & (F.count(value(c)) < F.count("*")))).alias(c) for c in columns]
    found = df.groupBy(group).agg(*checks)
    broken = F.explode(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns])).alias("feature")
    return found.select(group, broken).filter("feature is not null")


def monotone_violations(df: DataFrame, group: str, order: Sequence[str], column: str, increasing: bool = True) -> DataFrame:
    """Per group: steps against the promised direction between neighbouring present values, and missing values."""
    value = F.nanvl(F.col(column).cast("double"), F.lit(None))
    before = F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    against = value < before if increasing else value > before
    return df.select(group, against.alias("__bad"), value.isNull().alias("__none")).groupBy(group).agg(
        F.count_if("__bad").alias("n_violations"), F.count_if("__none").alias("n_missing"))


def check_call(df: DataFrame, features: Sequence[str], group: str, config: GroupingConfig) -> None:
    """Raises unless all columns are there and no group is wider than promised."""
    if lacking := [f for f in features if f not in df.columns]:
        raise ValueError(f"no columns {lacking}")
    if len(features) != config.n_features:
        raise ValueError(f"{len(features)} columns for {config.n_features} features")
    if config.max_group_width is not None:
        wide = df.groupBy(group).count().filter(F.col("count") > config.max_group_width)
        if not wide.isEmpty():
            raise ValueError(f"a group is wider than {config.max_group_width}")
