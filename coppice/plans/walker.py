"""Scoring large or wide forests: a NumPy walk over Arrow batches, one level of all trees at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Forest
from .cases import finish

#: Rows walked at once; bounds memory at BLOCK * trees * 24 bytes.
BLOCK = 1024
#: Bits of a digit of wide sums; int64 holds sums of 2**34 of them.
DIGIT = 29


class Arrays:
    """The forest as flat arrays; categories as sorted keys of node and category."""

    def __init__(self, forest: Forest):
        starts = np.cumsum([0, *(len(t) for t in forest.trees)])
        self.roots, self.depth, self.single = starts[:-1].astype(np.int64), forest.depth, forest.single
        flat = [(n, s) for t, s in zip(forest.trees, starts.tolist(), strict=False) for n in t]
        self.leaf = np.array([n.op is None for n, _ in flat], bool)
        self.feature = np.array([max(n.feature, 0) for n, _ in flat], np.int64)
        self.threshold = np.array([n.threshold for n, _ in flat], np.float64)
        self.strict = np.array([n.op == "<" for n, _ in flat], bool)
        self.member = np.array([n.op == "in" for n, _ in flat], bool)
        self.some_strict, self.some_member = bool(self.strict.any()), bool(self.member.any())
        self.default = np.array([n.default_left for n, _ in flat], bool)
        self.left = np.array([s + n.left if n.op else j for j, (n, s) in enumerate(flat)], np.int64)
        self.right = np.array([s + n.right if n.op else j for j, (n, s) in enumerate(flat)], np.int64)
        self.value = np.array([n.value for n, _ in flat], np.float64)
        lists = [n.categories for n, _ in flat]
        self.list_start = np.cumsum([0, *map(len, lists)])
        self.categories = np.array([c for cs in lists for c in cs], np.int64)
        self.plan, self.scale = forest.sum_plan.kind, forest.sum_plan.scale
        if self.plan == "long":
            self.fixed = np.array([forest.fixed(n.value) if n.op is None else 0 for n, _ in flat], np.int64)[:, None]
        else:
            self._digits([n.value if n.op is None else 0.0 for n, _ in flat])

    def _digits(self, values: list[float]) -> None:
        """Leaves as integers of 2**-scale in signed digits of DIGIT bits, nodes by digits, so that int64 sums of them are exact."""
        exact = [Fraction(v) for v in values]
        self.scale = max((v.denominator.bit_length() - 1 for v in exact), default=0)
        whole = [int(v * (1 << self.scale)) for v in exact]
        n = max((abs(v).bit_length() for v in whole), default=0) // DIGIT + 1
        mask = (1 << DIGIT) - 1
        self.fixed = np.array([[(abs(v) >> DIGIT * k & mask) * (1 if v >= 0 else -1) for k in range(n)] for v in whole], np.int64).reshape(len(whole), n)

    def rounded(self, sums: np.ndarray) -> np.ndarray:
        """Doubles nearest to exact sums, given as rows of digits."""
        if self.plan == "long":
            return sums[:, 0].astype(np.float64) * 2.0**-self.scale + 0.0
        whole, out = 1 << self.scale, np.empty(len(sums))
        for k, digits in enumerate(sums.tolist()):
            total = sum(d << DIGIT * j for j, d in enumerate(digits))
            try:
                out[k] = total / whole
            except OverflowError:
                out[k] = math.inf if total > 0 else -math.inf
        return out

    def _members(self, nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
        inside = (x >= 0) & (x < 2.0**32)
        codes = np.where(inside, x, 0).astype(np.int64)
        low, high = self.list_start[nodes], self.list_start[nodes + 1]
        end = high.copy()
        while (open_ := low < high).any():  # a binary search in every list at once
            middle = (low + high) // 2
            below = open_ & (self.categories[np.where(open_, middle, 0)] < codes)
            low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
        found = low < end
        return inside & found & (self.categories[np.where(found, low, 0)] == codes if len(self.categories) else False)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Node numbers of the leaves, rows by trees."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            v = x[rows, self.feature[at]]
            at = np.where(self.goes_left(at, v), self.left[at], self.right[at])
        return at

    def goes_left(self, nodes: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether values go left at nodes; both of one shape, or values with one more axis."""
        wide = (lambda a: a[..., None]) if v.ndim > nodes.ndim else (lambda a: a)
        t = wide(self.threshold[nodes])
        missing = np.isnan(v)
        with np.errstate(invalid="ignore"):
            left = (v < t) | (v == t) & ~wide(self.strict[nodes]) if self.some_strict else v <= t
        if len(self.categories) or self.some_member:
            where = np.broadcast_to(wide(self.member[nodes]), v.shape) & ~missing
            if where.any():
                left[where] = self._members(np.broadcast_to(wide(nodes), v.shape)[where], v[where])
        if missing.any():
            left = np.where(missing, wide(self.default[nodes]), left)
        return left

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves of every row, rounded once."""
        at = self.leaves(self.typed(x))
        if not at.shape[1]:
            return np.zeros(len(x))
        return self.rounded(np.stack([self.fixed[:, k][at].sum(axis=1) for k in range(self.fixed.shape[1])], axis=1))

    def typed(self, x: np.ndarray) -> np.ndarray:
        """Values as the model's type has them."""
        if not self.single:
            return x
        with np.errstate(over="ignore"):
            return x.astype(np.float32).astype(np.float64)


def matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """n columns of a batch from the first on, rows by features."""
    out = np.empty((batch.num_rows, n))
    for k in range(n):
        out[:, k] = batch.column(first + k).to_numpy(zero_copy_only=False)
    return out


def with_sums(batch: pa.RecordBatch, kept: Sequence[str], sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sums, pa.float64())], [*kept, "tree_sum"])


def score(df: DataFrame, forest: Forest, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The key columns, tree_sum, raw_margin and output of every row; no shuffle.

    The forest travels in the task closure, which Spark ships as a broadcast; its
    size is bounded by LoadOptions.max_nodes.
    """
    if len(features) != forest.n_features:
        raise ValueError(f"{len(features)} feature columns for {forest.n_features} features")
    arrays, n, kept = Arrays(forest), len(features), list(key)
    held = df.select(*kept, *[F.coalesce(F.col(f).cast("double"), F.lit(math.nan)).alias(f"__f{k}") for k, f in enumerate(features)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, len(kept), n)
            parts = [arrays.sums(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]
            yield with_sums(batch, kept, np.concatenate(parts) if parts else np.empty(0))

    schema = held.select(*kept, F.lit(0.0).alias("tree_sum")).schema
    return held.mapInArrow(walk, schema).withColumns(finish(forest, F.col("tree_sum")))
