"""Analysis of run tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import first_in_order, nearest_rank, seeded


def nested_median(df: DataFrame, keys: Sequence[str], block: str, value: str) -> DataFrame:
    """Median over blocks of the medians in blocks, both by nearest rank."""
    inner = nearest_rank(df, [*keys, block], value, [50])
    return nearest_rank(inner.select(*keys, block, value), keys, value, [50]).drop("percent")


def run_starts(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Adds run: the number of the run of equal neighbouring values, from 0."""
    window = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce(~F.lag(value).over(window).eqNullSafe(F.col(value)), F.lit(False)) & (F.row_number().over(window) > 1)
    return df.withColumn("__new", changed.cast("bigint")).withColumn(
        "run", F.sum("__new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def offsets(df: DataFrame, group: str, width: int = 65_536) -> DataFrame:
    """Group sizes and start offsets in the order of integer group keys.

    A running sum inside ranges of width keys, and one over the ranges, of which there are few.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("__range", F.floor(F.col(group) / width))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("__range").agg(F.sum("n").alias("__total")).select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__range").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("__inside", inside).join(ranges, "__range").select(group, "n", (F.col("__base") + F.col("__inside")).alias("start"))


def two_modes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Splits each cell's positive values at the largest gap of their logarithms: low_top, high_bottom, ratio; ties to the lowest gap."""
    window = Window.partitionBy(*keys).orderBy(value)
    gaps = df.filter(F.col(value) > 0).select(*keys, value).distinct().withColumn("__next", F.lead(value).over(window))
    gaps = gaps.filter("__next is not null").withColumn("__ratio", F.col("__next") / F.col(value))
    best = F.max_by(F.struct(F.col(value).alias("low_top"), F.col("__next").alias("high_bottom"), F.col("__ratio").alias("ratio")), F.struct("__ratio", -F.col(value)))
    return gaps.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def drift(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Every record against the first of its key: value / first value."""
    first = df.groupBy(*keys).agg(F.min_by(value, time).alias("first_value"))
    return df.join(first, list(keys)).withColumn("drift", F.col(value) / F.col("first_value"))


def precision_audit(df: DataFrame, keys: Sequence[str], exact: Column, a: Column, b: Column) -> DataFrame:
    """Whether a or b is closer to the exact value: closer, tie, farther; largest, median and largest relative error of each."""
    da, db = F.abs(a - exact), F.abs(b - exact)
    size = F.greatest(F.abs(exact), F.lit(1e-300))
    return df.groupBy(*keys).agg(
        F.count_if(da < db).alias("closer"), F.count_if(da == db).alias("tie"), F.count_if(da > db).alias("farther"),
        F.max(da).alias("max_a"), F.max(db).alias("max_b"),
        F.percentile(da, 0.5).alias("median_a"), F.percentile(db, 0.5).alias("median_b"), F.max(da / size).alias("relative_a"), F.max(db / size).alias("relative_b"))


def mismatch(a: Column, b: Column, tolerance: float | None = None) -> Column:
    """Bitwise unless a tolerance is given; a NaN on one side only is a mismatch."""
    if tolerance is None:
        return ~a.eqNullSafe(b)
    nan_a, nan_b = F.isnan(a), F.isnan(b)
    return (nan_a != nan_b) | (~nan_a & ~nan_b & (F.abs(a - b) > tolerance))


def stratified_sample(sizes: DataFrame, key: str, size: str, per_stratum: int, seed: int) -> DataFrame:
    """Groups in strata by the power of two of their size; of each stratum the first per_stratum by seeded order."""
    strata = sizes.withColumn("stratum", F.floor(F.log2(F.col(size).cast("double"))).cast("bigint"))
    quotas = strata.groupBy("stratum").agg(F.lit(per_stratum).alias("quota"))
    return first_in_order(strata, ["stratum"], seeded(seed, key), key, quotas)


def pack_batches(groups: DataFrame, shard: str, key: str, size: str, budget: int) -> DataFrame:
    """Greedy batches in key order inside each shard: a group opens a new batch when it would pass the row budget.

    Each step depends on the last; rows come sorted and stream through Arrow batches, so a shard is never held whole.
    """
    ordered = groups.select(shard, key, size).repartition(shard).sortWithinPartitions(shard, key)

    def fill(batches):
        at, batch, used = None, 0, 0
        for frame in batches:
            numbers = []
            for s, n in zip(frame[shard].tolist(), frame[size].tolist(), strict=True):
                if s != at:
                    at, batch, used = s, 0, 0
                elif used and used + n > budget:
                    batch, used = batch + 1, 0
                used += n
                numbers.append(batch)
            yield frame.assign(batch=pd.Series(numbers, dtype="int64", index=frame.index))

    schema = ordered.withColumn("batch", F.lit(0).cast("bigint")).schema
    return ordered.mapInPandas(fill, schema)


def fsum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Correctly rounded sums of doubles, a group per task; for tests on small groups."""
    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[:1][list(keys)].assign(total=math.fsum(frame[value]))

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(total, f"{kinds}, total DOUBLE")
