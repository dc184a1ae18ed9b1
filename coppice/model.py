"""The forest: validated trees, their relational form and a plain evaluator."""

from __future__ import annotations

import hashlib
import json
import math
import struct
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property
from pathlib import Path

from .config import LoadOptions
from .errors import LimitExceeded, MalformedModel, ModelIOError, Unsupported


def f32(x: float) -> float:
    """x rounded to float32; values beyond its range become infinite."""
    try:
        return struct.unpack("<f", struct.pack("<f", x))[0]
    except OverflowError:
        return math.copysign(math.inf, x)


@dataclass(frozen=True)
class Node:
    """A split (op '<', '<=' or 'in'; members and smaller values go left) or a leaf (op None)."""

    op: str | None = None
    feature: int = -1
    threshold: float = math.nan
    categories: tuple[int, ...] = ()
    default_left: bool = False
    left: int = -1
    right: int = -1
    value: float = 0.0
    weight: float = 1.0

    @property
    def predicate(self) -> tuple:
        """Splits that decide alike share it; sorts by feature, numeric before categorical, then threshold."""
        return (self.feature, self.op == "in", 0.0 if self.op == "in" else self.threshold, self.categories, self.default_left, self.op)


@dataclass(frozen=True)
class SumPlan:
    """How leaves add up exactly: 'long' or 'decimal' as integers of 2**-scale, else 'wide'."""

    kind: str
    scale: int


@dataclass(frozen=True)
class Forest:
    """A scalar tree ensemble. Trees are tuples of nodes, the root first."""

    trees: tuple[tuple[Node, ...], ...]
    n_features: int
    single: bool = False
    base_score: float = 0.0
    averaged: bool = False
    link: str = "identity"
    alpha: float = 1.0
    options: LoadOptions = LoadOptions()

    def __post_init__(self):
        o = self.options
        if self.n_features < 1:
            raise MalformedModel(f"{self.n_features} features")
        if self.n_features > o.max_features or len(self.trees) > o.max_trees or self.n_nodes > o.max_nodes:
            raise LimitExceeded("features, trees or nodes")
        if sum(len(n.categories) for t in self.trees for n in t) > o.max_categories:
            raise LimitExceeded("categories")
        if self.link not in ("identity", "sigmoid"):
            raise Unsupported(f"postprocessor {self.link}")
        if not math.isfinite(self.base_score) or not (math.isfinite(self.alpha) and self.alpha > 0):
            raise MalformedModel(f"base score {self.base_score}, alpha {self.alpha}")
        object.__setattr__(self, "alpha", f32(self.alpha))
        object.__setattr__(self, "trees", tuple(tuple(self._normal(n) for n in t) for t in self.trees))
        for k, tree in enumerate(self.trees):
            if _depth(tree, k) > o.max_depth:
                raise LimitExceeded(f"tree {k} is too deep")

    def _normal(self, n: Node) -> Node:
        """Rounds to the model's type and rejects what has no meaning in it."""
        if not (math.isfinite(n.weight) and n.weight >= 0):
            raise MalformedModel(f"weight {n.weight}")
        if n.op is None:
            value = f32(n.value) if self.single else float(n.value)
            if not math.isfinite(value):
                raise MalformedModel(f"leaf {n.value}")
            return Node(value=value, weight=n.weight)
        if not 0 <= n.feature < self.n_features:
            raise MalformedModel(f"feature {n.feature}")
        if n.op == "in":
            if not all(0 <= c < 1 << 32 for c in n.categories):
                raise MalformedModel("category out of range")
            return Node("in", n.feature, math.nan, tuple(sorted(set(n.categories))), n.default_left, n.left, n.right, 0.0, n.weight)
        t = n.threshold
        if math.isnan(t):
            raise MalformedModel("threshold NaN")
        if n.op not in ("<", "<=") or (self.single and n.op == "<="):
            raise Unsupported(f"comparison {n.op}")
        if self.single:
            if math.isinf(f32(t)) and not math.isinf(t):
                raise MalformedModel(f"threshold {t} is beyond float32")
            t = f32(t)
        elif n.op == "<" and t == -math.inf:
            raise MalformedModel("nothing is below the threshold")
        return Node(n.op, n.feature, t, (), n.default_left, n.left, n.right, 0.0, n.weight)

    # --- loading ---

    @classmethod
    def load(cls, path: str, options: LoadOptions = LoadOptions()) -> "Forest":
        """By extension: .json and .bin are Treelite's forms, .txt is LightGBM's text. Paths with a scheme are read by Spark."""
        suffix = Path(path).suffix
        if suffix not in (".json", ".bin", ".txt"):
            raise Unsupported(f"extension {suffix!r}")
        if "://" in path:
            return cls.from_bytes(_remote(path, options), suffix[1:], options)
        try:
            size = Path(path).stat().st_size
            if size > options.max_file_bytes:
                raise LimitExceeded(f"{size} bytes")
            raw = Path(path).read_bytes()
        except OSError as e:
            raise ModelIOError(str(e)) from e
        return cls.from_bytes(raw, suffix[1:], options)

    @classmethod
    def from_bytes(cls, raw: bytes, form: str, options: LoadOptions = LoadOptions()) -> "Forest":
        """form is 'json', 'bin' or 'txt'."""
        from .sources import lightgbm_text, treelite_binary, treelite_json

        if len(raw) > options.max_file_bytes:
            raise LimitExceeded(f"{len(raw)} bytes")
        readers = {"json": treelite_json.read, "bin": treelite_binary.read, "txt": lightgbm_text.read}
        if form not in readers:
            raise Unsupported(f"format {form!r}")
        return readers[form](raw, options)

    # --- facts ---

    @property
    def n_nodes(self) -> int:
        return sum(map(len, self.trees))

    @property
    def divisor(self) -> float:
        return float(max(len(self.trees), 1)) if self.averaged else 1.0

    @cached_property
    def depth(self) -> int:
        return max((_depth(t, k) for k, t in enumerate(self.trees)), default=0)

    @cached_property
    def predicates(self) -> list[tuple]:
        """Distinct split predicates in their order."""
        return sorted({n.predicate for t in self.trees for n in t if n.op})

    @cached_property
    def predicate_ids(self) -> dict[tuple, int]:
        return {p: k for k, p in enumerate(self.predicates)}

    @cached_property
    def sum_plan(self) -> SumPlan:
        """The narrowest integers that hold every sum of one leaf per tree."""
        values = [Fraction(n.value) for t in self.trees for n in t if n.op is None]
        scale = max((v.denominator.bit_length() - 1 for v in values), default=0)
        bound = sum(max((abs(Fraction(n.value)) for n in t if n.op is None), default=Fraction(0)) for t in self.trees)
        bits = int(bound * (1 << scale)).bit_length()
        if scale > 900 or bits >= 126:
            return SumPlan("wide", 0)
        return SumPlan("long" if bits < 63 else "decimal", scale)

    def fixed(self, value: float) -> int:
        return int(Fraction(value) * (1 << self.sum_plan.scale))

    @cached_property
    def headroom_bits(self) -> int:
        """Bits left in 126 for sums of one leaf per tree."""
        values = [Fraction(n.value) for t in self.trees for n in t if n.op is None]
        scale = max((v.denominator.bit_length() - 1 for v in values), default=0)
        bound = sum(max(abs(Fraction(n.value)) for n in t if n.op is None) for t in self.trees)
        return 126 - int(bound * (1 << scale)).bit_length()

    def heavy_left(self, tree: int, node: int) -> bool:
        """Whether the left child weighs at least as much as the right one."""
        t = self.trees[tree]
        return t[t[node].left].weight >= t[t[node].right].weight

    def node_rows(self) -> list[tuple]:
        """Rows of the node table (see NODE_SCHEMA)."""
        plan, rows = self.sum_plan, []
        for k, tree in enumerate(self.trees):
            for j, n in enumerate(tree):
                leaf = n.op is None
                fixed = str(self.fixed(n.value)) if leaf and plan.kind != "wide" else None
                rows.append((k, j, leaf, None if leaf else n.feature, n.op, None if leaf or n.op == "in" else n.threshold,
                             list(n.categories) if n.op == "in" else None, n.default_left, None if leaf else n.left,
                             None if leaf else n.right, n.value if leaf else None, fixed, n.weight,
                             None if leaf else self.predicate_ids[n.predicate]))
        return rows

    def header(self) -> dict:
        return {"version": 1, "n_features": self.n_features, "single": self.single, "base_score": self.base_score,
                "averaged": self.averaged, "link": self.link, "alpha": self.alpha, "n_trees": len(self.trees)}

    def fingerprint(self) -> str:
        """SHA-256 over header and nodes."""
        return hashlib.sha256(json.dumps([self.header(), self.node_rows()]).encode()).hexdigest()

    # --- evaluation of single rows, for tests ---

    def leaves(self, row) -> list[float]:
        return [_leaf(t, row, self.single) for t in self.trees]

    def stages(self, row) -> tuple[float, float, float]:
        """tree_sum (exact, rounded once), raw_margin and output of one row."""
        exact = sum(map(Fraction, self.leaves(row)), Fraction(0))
        total = float(exact) if exact else 0.0
        margin = total / self.divisor + self.base_score
        if self.link == "identity":
            return total, margin, margin
        z = -(self.alpha * margin)
        return total, margin, 1.0 / (1.0 + math.exp(z)) if z < 709 else 0.0


def _remote(path: str, options: LoadOptions) -> bytes:
    """A file that the session's file systems know; its size is checked before it is read."""
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ModelIOError(f"no Spark session to read {path}")
    try:
        file = spark.read.format("binaryFile").load(path)
        size = file.select("length").first()[0]
        if size > options.max_file_bytes:
            raise LimitExceeded(f"{size} bytes")
        return bytes(file.select("content").first()[0])
    except (PySparkException, TypeError) as e:
        raise ModelIOError(str(e)) from e


NODE_SCHEMA = (
    "tree INT, node INT, is_leaf BOOLEAN, feature INT, op STRING, threshold DOUBLE, categories ARRAY<BIGINT>, "
    "default_left BOOLEAN, left_id INT, right_id INT, leaf_value DOUBLE, leaf_fixed STRING, weight DOUBLE, predicate INT"
)


def _leaf(tree: tuple[Node, ...], row, single: bool) -> float:
    n = tree[0]
    while n.op is not None:
        x = row[n.feature]
        x = math.nan if x is None else float(x)
        if single and not math.isnan(x):
            x = f32(x)
        if math.isnan(x):
            left = n.default_left
        elif n.op == "in":
            left = 0 <= x < 1 << 32 and int(x) in n.categories
        else:
            left = x < n.threshold if n.op == "<" else x <= n.threshold
        n = tree[n.left if left else n.right]
    return n.value


def _depth(tree: tuple[Node, ...], k: int) -> int:
    """Depth of a tree; raises unless every node but the root has exactly one parent and is reached."""
    if not tree:
        raise MalformedModel(f"tree {k} is empty")
    seen, level, depth = {0}, [0], -1
    while level:
        depth, following = depth + 1, []
        for j in level:
            if tree[j].op is None:
                continue
            for child in (tree[j].left, tree[j].right):
                if not 0 <= child < len(tree) or child in seen:
                    raise MalformedModel(f"tree {k}: node {j} has child {child}")
                seen.add(child)
                following.append(child)
        level = following
    if len(seen) != len(tree):
        raise MalformedModel(f"tree {k}: unreachable nodes")
    return depth
