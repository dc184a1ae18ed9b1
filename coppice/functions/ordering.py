"""Seeded orders and nearest ranks as columns and frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *columns: Column | str) -> Column:
    """A text that orders rows as by a draw: MD5 of seed and columns. Not NumPy's order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def uniform(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) of 32 bits by seed and columns."""
    return F.conv(F.substring(seeded(seed, *columns), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """keys, percent, value at rank round(p/100*(n-1)), halves away from zero; nulls don't count.

    Equal values are counted before the shuffle and ranks run over distinct
    values in a spillable window, so no group is collected.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"__upto": upto, "__all": F.sum("__n").over(group)})
    asked = ranked.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    rank = F.floor(F.col("percent") * (F.col("__all") - 1) / 100 + 0.5)
    return asked.filter((rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__n"))).select(*keys, "percent", value)


def first_in_order(df: DataFrame, keys: Sequence[str], order: Column, tie: str, quotas: DataFrame) -> DataFrame:
    """Of each key's rows the first `quota` (from quotas: keys and quota) in the order of a seeded text, ties by the column tie.

    Texts are MD5 in hex, so their first three digits deal a key's rows evenly over
    4,096 ranges. Counts tell which range a quota ends in; only its rows are ranked.
    """
    keys = list(keys)
    placed = df.withColumn("__order", order).withColumn("__range", F.substring("__order", 1, 3))
    ranges = placed.groupBy(*keys, "__range").agg(F.count("*").alias("__n")).join(quotas, keys)
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
    room = ranges.withColumn("__room", F.col("quota") - (upto - F.col("__n"))).where("__room > 0").select(*keys, "__range", "__room", "__n")
    held = placed.join(room, [*keys, "__range"])
    ended = held.where("__room < __n")
    rank = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy("__order", tie))
    last = ended.withColumn("__rank", rank).where("__rank <= __room").drop("__rank")
    return held.where("__room >= __n").unionByName(last).select(*df.columns)


#: Ranges that quantiles cuts a column into.
RANGES = 256


def quantiles(df: DataFrame, column: str, at: Sequence[float], inverted_cdf: bool = False) -> DataFrame:
    """at and value: exact quantiles of a column; nulls don't count, no rows without values.

    With linear interpolation, or the least value that a share of at is not above (inverted_cdf).

    Approximate quantiles cut the column into ranges, counts of which tell where each
    rank lies; only the values of these ranges are ranked. Equal values are counted first.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("__n"))
    cuts = counts.agg(F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)], 10_000).alias("c")).first()["c"] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    placed = counts.withColumn("__range", F.size(F.filter(edges, lambda e: e < F.col("value"))))
    ranges = Window.orderBy("__range")  # RANGES rows at most
    sizes = placed.groupBy("__range").agg(F.sum("__n").alias("__in")).withColumns({
        "__base": F.sum("__in").over(ranges.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__in"), "__all": F.sum("__in").over(Window.partitionBy())})
    place = F.greatest(F.ceil(F.col("at") * F.col("__all")) - 1, F.lit(0)) if inverted_cdf else F.col("at") * (F.col("__all") - 1)
    asked = sizes.withColumn("at", F.explode(F.array(*[F.lit(float(p)) for p in at]))).withColumns({"__low": F.floor(place), "__high": F.ceil(place), "__share": place - F.floor(place)})
    wanted = asked.where("(__low between __base and __base + __in - 1) or (__high between __base and __base + __in - 1)")
    here = placed.join(wanted.select("__range", "__base").distinct(), "__range")
    upto = F.sum("__n").over(Window.partitionBy("__range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__base")
    ranked = here.withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col("__n")).drop("__base")
    hits = ranked.join(wanted, "__range").groupBy("at").agg(
        F.max(F.when(F.expr("__low >= __from and __low < __upto"), F.col("value"))).alias("__a"), F.max(F.when(F.expr("__high >= __from and __high < __upto"), F.col("value"))).alias("__b"), F.first("__share").alias("__share"))
    return hits.select("at", (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__share")).alias("value"))
