"""Scoring runs of rows that share an entity: what is constant is walked once a run.

A run is consecutive rows of one group, up to 64 of them; its rows are the bits of a
mask.  All trees of all runs of a batch are walked together, a level at a time, as
items (run, node, mask).  A constant split moves an item, whatever its number of
rows; a varying split compares the rows of the item and divides its mask.  Leaves
are added to the rows of their masks as exact integers.

Rows come as they are: no shuffle is made.  Where a group lies in several batches or
is not contiguous it is more runs, with the same result.  The sorted output of a join
by the group's key, or rows made by expanding entities, have long runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Forest
from .cases import finish
from .walker import Arrays, matrix, with_sums

WIDTH = 64
#: Items (runs times trees) walked at once; bounds memory at about ITEMS * WIDTH * 40 bytes.
ITEMS = 16_384
_BITS = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)


def run_starts(group: np.ndarray) -> np.ndarray:
    """Where runs of equal values start; longer ones are cut every WIDTH rows."""
    n = len(group)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.flatnonzero((np.arange(n) - first) % WIDTH == 0)


class Walk:
    """The walk of the runs of one forest under one set of constant features."""

    def __init__(self, forest: Forest, constant: set[int]):
        self.forest = Arrays(forest)
        #: Whether doubles hold all sums of integers exactly.
        self.small = self.forest.plan == "long" and sum(max(abs(forest.fixed(n.value)) for n in t if n.op is None) for t in forest.trees) < 1 << 53
        self.constant = np.array([k in constant for k in range(forest.n_features)], bool)[self.forest.feature] & ~self.forest.leaf

    def sums(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sum of the leaves of every row, rounded once; x by row, starts of runs that cover all rows."""
        f = self.forest
        if not len(f.roots):
            return np.zeros(len(x))
        x, out = f.typed(x), []
        ends, step = np.append(starts[1:], len(x)), max(1, ITEMS // len(f.roots))
        for k in range(0, len(starts), step):
            out.append(self._block(x[starts[k] : ends[min(k + step, len(starts)) - 1]], starts[k : k + step] - starts[k], ends[k : k + step] - starts[k]))
        return f.rounded(np.concatenate(out) if out else np.zeros((0, f.fixed.shape[1]), np.int64))

    def _block(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        f, n, trees = self.forest, len(starts), len(self.forest.roots)
        sizes = ends - starts
        wide = int(sizes.max())
        # rows of each run by place; places after its end repeat its last row and have no bit
        held = x[np.minimum(starts[:, None] + np.arange(wide), ends[:, None] - 1)].transpose(2, 0, 1).copy()
        first = x[starts]
        full = np.where(sizes == WIDTH, ~np.uint64(0), _BITS[sizes % WIDTH] - np.uint64(1))
        run, node = np.repeat(np.arange(n), trees), np.tile(f.roots, n)
        self._settle(run, node, first)
        whole = np.stack([f.fixed[:, k][node].reshape(n, trees).sum(axis=1) for k in range(f.fixed.shape[1])])  # 0 but at leaves
        split = np.flatnonzero(~f.leaf[node])
        run, node = run[split], node[split]
        mask, done = full[run], []
        while len(node):
            left = self._mask(node, held[f.feature[node], run])
            below, above = mask & left, mask & ~left
            some, others = np.flatnonzero(below), np.flatnonzero(above)
            run = np.concatenate([run[some], run[others]])
            mask = np.concatenate([below[some], above[others]])
            node = np.concatenate([f.left[node[some]], f.right[node[others]]])
            self._settle(run, node, first)
            leaf = f.leaf[node]
            done.append((run[leaf], node[leaf], mask[leaf]))
            run, node, mask = run[~leaf], node[~leaf], mask[~leaf]
        inside = np.arange(wide) < sizes[:, None]
        if not done:
            return np.repeat(whole.T, sizes, axis=0)
        run, node, mask = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(run, kind="stable")
        run, node, bits = run[order], node[order], np.unpackbits(mask[order].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=wide)
        return np.stack([(w[:, None] + self._by_row(run, f.fixed[node, k], bits, n))[inside] for k, w in enumerate(whole)], axis=1)

    def _settle(self, run: np.ndarray, node: np.ndarray, first: np.ndarray) -> None:
        """Moves nodes on, in place, to leaves and varying splits."""
        f = self.forest
        moving = np.flatnonzero(self.constant[node])
        while len(moving):
            here = node[moving]
            after = np.where(f.goes_left(here, first[run[moving], f.feature[here]]), f.left[here], f.right[here])
            node[moving] = after
            moving = moving[self.constant[after]]

    def _by_row(self, run: np.ndarray, values: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
        """For each run and place, the sum of the values of its items that have its bit."""
        heads = np.searchsorted(run, np.arange(n + 1))
        if not self.small:
            out = np.zeros((n, bits.shape[1]), np.int64)
            some = np.flatnonzero(heads[1:] > heads[:-1])
            if len(some):
                out[some] = np.add.reduceat(bits * values[:, None], heads[some], axis=0)
            return out
        out, marks, values = np.zeros((n, bits.shape[1])), bits.astype(np.float64), values.astype(np.float64)
        for k in range(n):
            a, b = heads[k], heads[k + 1]
            if b > a:
                np.dot(values[a:b], marks[a:b], out=out[k])
        return out.astype(np.int64)

    def _mask(self, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The rows of each item that go left, as bits."""
        left = self.forest.goes_left(nodes, values)
        packed = np.zeros((len(nodes), 8), np.uint8)
        bits = np.packbits(left, axis=1, bitorder="little")
        packed[:, : bits.shape[1]] = bits
        return packed.view(np.uint64)[:, 0]


def score(df: DataFrame, forest: Forest, features: Sequence[str], constant: set[int], group: str, kept: Sequence[str]) -> DataFrame:
    """The kept columns, tree_sum, raw_margin and output of every row.

    Constant features are read from the first row of a run; contracts.constant_violations
    tells whether groups keep that promise.
    """
    if len(features) != forest.n_features:
        raise ValueError(f"{len(features)} feature columns for {forest.n_features} features")
    walk, n, kept = Walk(forest, constant), len(features), list(kept)
    key = F.coalesce(F.xxhash64(group), F.lit(0)).alias("__group")
    held = df.select(*kept, key, *[F.coalesce(F.col(f).cast("double"), F.lit(math.nan)).alias(f"__f{k}") for k, f in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = run_starts(batch.column(len(kept)).to_numpy())
            yield with_sums(batch, kept, walk.sums(matrix(batch, len(kept) + 1, n), starts))

    schema = held.select(*kept, F.lit(0.0).alias("tree_sum")).schema
    return held.mapInArrow(run, schema).withColumns(finish(forest, F.col("tree_sum")))
