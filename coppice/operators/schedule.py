"""Timing schedules: seeded generators, batches, method orders, samples of groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import first_in_order, seeded

_WORD = (1 << 64) - 1
# SplitMix64's and 64-bit FNV-1a's constants.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


class SplitMix:
    """SplitMix64."""

    def __init__(self, seed: int):
        self.state = seed & _WORD

    def word(self) -> int:
        self.state = (self.state + GOLDEN) & _WORD
        z = self.state
        z = ((z ^ z >> 30) * MIX_A) & _WORD
        z = ((z ^ z >> 27) * MIX_B) & _WORD
        return z ^ z >> 31

    def unit(self) -> float:
        """In [0, 1), 53 bits."""
        return (self.word() >> 11) / (1 << 53)

    def below(self, n: int) -> int:
        """Even in 0..n-1: words of the last, incomplete stretch are drawn again."""
        limit = _WORD - _WORD % n
        while (word := self.word()) >= limit:
            pass
        return word % n

    def shuffled(self, values: Sequence) -> list:
        out = list(values)
        for last in range(len(out) - 1, 0, -1):
            other = self.below(last + 1)
            out[last], out[other] = out[other], out[last]
        return out


def name_seed(seed: int, name: str) -> int:
    """A seed for a named cell: the run's seed and the name's FNV-1a hash."""
    hashed = FNV_START
    for byte in name.encode():
        hashed = ((hashed ^ byte) * FNV_PRIME) & _WORD
    return seed ^ hashed


@dataclass(frozen=True)
class Schedule:
    """Batches of places of groups, and the order of methods in round 0."""

    batches: tuple[tuple[int, ...], ...]
    methods: tuple[int, ...]

    @classmethod
    def of(cls, n_groups: int, n_methods: int, n_batches: int, seed: int, in_file_order: bool = False) -> "Schedule":
        """Groups in one seeded order (or their own) in batches of equal size, the first ones a group larger where they must be."""
        if n_groups < 1 or n_methods < 1:
            raise ValueError("a schedule needs a group and a method")
        rng = SplitMix(seed)
        order = list(range(n_groups)) if in_file_order else rng.shuffled(range(n_groups))
        n = min(max(n_batches, 1), n_groups)
        cuts = [k * (n_groups // n) + min(k, n_groups % n) for k in range(n + 1)]
        return cls(tuple(tuple(order[a:b]) for a, b in zip(cuts, cuts[1:])), tuple(rng.shuffled(range(n_methods))))

    @property
    def cycle(self) -> int:
        """Rounds after which every method has had the same mean place."""
        return min(len(self.methods), 2)

    def order_of(self, round_no: int) -> tuple[int, ...]:
        """Forward in even rounds, backward in odd ones."""
        return self.methods[:: -1 if round_no % 2 else 1]

    def phases(self, spark: SparkSession, names: Sequence[str], rounds: int) -> DataFrame:
        """round, position, method, batch in the order they are timed, and the batch that the phase warms up on."""
        rows = [(r, p, names[m], b, len(self.batches) - 1) for r in range(rounds) for p, m in enumerate(self.order_of(r)) for b in range(len(self.batches))]
        return spark.createDataFrame(rows, "round BIGINT, position BIGINT, method STRING, batch BIGINT, warm_batch BIGINT")


def systematic_sample(groups: DataFrame, key: str, size: str, cap: int, min_groups: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(groups with `timed`, strata): a sample of groups with the same probability for each, by size.

    The fraction is cap rows of all, or what min_groups groups need.  Strata are powers
    of two of the size; their quotas are rounded one after the other with one seeded
    uniform, so that any first strata together take their expected number within one.
    In a stratum the first by a seeded order are taken, without sorting it in one task.
    """
    strata = groups.withColumn("stratum", F.floor(F.log2(F.greatest(F.col(size), F.lit(1)).cast("double"))).cast("bigint"))
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("pool"), F.sum(size).cast("bigint").alias("pool_rows"))
    everything = Window.partitionBy()  # over strata, 64 at most
    rows, n = F.sum("pool_rows").over(everything), F.sum("pool").over(everything)
    fraction = F.when(F.lit(cap <= 0) | (rows <= cap), 1.0).otherwise(F.least(F.greatest(F.lit(float(cap)) / rows, F.lit(float(max(min_groups, 1))) / n), F.lit(1.0)))
    upto = F.sum("pool").over(everything.orderBy("stratum").rowsBetween(Window.unboundedPreceding, 0))
    shift = SplitMix(seed).unit()
    quota = F.floor(upto * F.col("fraction") + shift) - F.floor((upto - F.col("pool")) * F.col("fraction") + shift)
    designed = sizes.withColumn("fraction", fraction).withColumn("sampled", F.least(quota, F.col("pool")).cast("bigint"))
    taken = first_in_order(strata, ["stratum"], seeded(seed, key), key, designed.select("stratum", F.col("sampled").alias("quota")))
    timed = strata.join(taken.select(key, F.lit(True).alias("timed")), key, "left").withColumn("timed", F.coalesce("timed", F.lit(False)))
    return timed, designed


def design_faults(groups: DataFrame, size: str, strata: DataFrame) -> DataFrame:
    """Strata of a sample's record (stratum, pool, sampled, fraction) that the groups (size, timed) contradict.

    counts: pool or sampled differ; drift: up to here the strata take a group or more
    beyond their expected number.
    """
    seen = groups.groupBy(F.floor(F.log2(F.greatest(F.col(size), F.lit(1)).cast("double"))).cast("bigint").alias("stratum")).agg(
        F.count("*").alias("seen"), F.count_if("timed").alias("seen_timed"))
    both = strata.join(seen, "stratum", "full").select(
        "stratum", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pool", "sampled", "seen", "seen_timed")), F.coalesce("fraction", F.lit(0.0)).alias("fraction"))
    before = Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, 0)  # strata, 64 at most
    drift = F.abs(F.sum("sampled").over(before) - F.sum(F.col("pool") * F.col("fraction")).over(before)) >= 1 + 1e-9
    return both.select("stratum", ((F.col("pool") != F.col("seen")) | (F.col("sampled") != F.col("seen_timed"))).alias("counts"), drift.alias("drift"))
