"""Forests built by rule, for queries, tests and benches."""

from __future__ import annotations

import math
import random
from dataclasses import replace

from .model import Forest, Node


def random_forest(seed: int, n_trees: int, depth: int, ranges: list[tuple[float, float] | int], **settings) -> Forest:
    """Leaves are multiples of 1/1024. A range makes numeric splits, a whole number that many categories."""
    rng = random.Random(seed)
    op = "<" if settings.get("single") else "<="

    def grow(nodes: list[Node], level: int) -> int:
        at = len(nodes)
        nodes.append(Node(value=rng.randint(-4096, 4096) / 1024))
        if level == depth or (level > 1 and rng.random() < 0.15):
            return at
        feature = rng.randrange(len(ranges))
        kind = ranges[feature]
        default, weight = rng.random() < 0.5, float(rng.randint(1, 1000))
        if isinstance(kind, int):
            chosen = tuple(c for c in range(kind) if rng.random() < 0.5)
            split = Node("in", feature, math.nan, chosen, default, weight=weight)
        else:
            split = Node(op, feature, round(rng.uniform(*kind), 2), (), default, weight=weight)
        left = grow(nodes, level + 1)
        right = grow(nodes, level + 1)
        nodes[at] = replace(split, left=left, right=right)
        return at

    trees = []
    for _ in range(n_trees):
        nodes: list[Node] = []
        grow(nodes, 0)
        trees.append(tuple(nodes))
    return Forest(tuple(trees), len(ranges), **settings)


def scaled_leaves(forest: Forest, every: int, factor: float) -> Forest:
    """Every n-th tree's leaves times factor; with 2**-96 the sum takes the wide plan."""
    trees = tuple(tuple(replace(n, value=n.value * factor) if n.op is None and k % every == 0 else n for n in t) for k, t in enumerate(forest.trees))
    return replace(forest, trees=trees)


def shifted_categories(forest: Forest, by: int) -> Forest:
    """All categories raised by a number, which makes long lists of them."""
    trees = tuple(tuple(replace(n, categories=tuple(c + by for c in n.categories)) for n in t) for t in forest.trees)
    return replace(forest, trees=trees)


ORDER_FEATURES = ["o_totalprice", "priority", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_CONSTANT = {0, 1}
ORDER_RANGES = [(1000.0, 500000.0), 6, (1.0, 50.0), (900.0, 105000.0), (0.0, 0.1), (0.0, 0.08)]
EVENT_FEATURES = ["n_events", "max_value", "value", "type_code", "k"]
EVENT_CONSTANT = {0, 1}
EVENT_RANGES = [(40.0, 90.0), (100.0, 500.0), (0.0, 120.0), 5, 100]


def orders_forest() -> Forest:
    return random_forest(7, 12, 5, ORDER_RANGES, base_score=0.125, link="sigmoid", alpha=0.25)


def averaged_forest() -> Forest:
    return random_forest(11, 8, 5, ORDER_RANGES, base_score=3.0, averaged=True)


def single_forest() -> Forest:
    return random_forest(13, 8, 5, ORDER_RANGES, single=True, base_score=-0.75)


def events_forest() -> Forest:
    return random_forest(17, 10, 4, EVENT_RANGES, base_score=0.5, link="sigmoid", alpha=0.5)


def large_forest() -> Forest:
    return random_forest(19, 60, 6, ORDER_RANGES, base_score=0.25)


#: A panel: five features of an entity, four of the step.
PANEL_FEATURES = ["c_acctbal", "c_nationkey", "segment", "n_digits", "key_share", "t", "t_left", "t_frac_sq", "t_sine"]
PANEL_CONSTANT = {0, 1, 2, 3, 4}
PANEL_RANGES = [(-1000.0, 10000.0), 25, 5, (1.0, 7.0), (0.0, 1.0), (0.0, 32.0), (0.0, 32.0), (0.0, 1.0), (0.0, 1.0)]


def panel_forest() -> Forest:
    return random_forest(29, 100, 6, PANEL_RANGES, base_score=-0.5)


#: The shape of the published sentinel cell: 500 trees of depth 4, 16 steps an entity, 6 features of the step beside 14 covariates.
SENTINEL_STEPS = 16
SENTINEL_FEATURES = [*(f"x{k}" for k in range(14)), "t_frac", "t_frac_sq", "t_left", "left_frac", "base_frac", "t_sine"]
SENTINEL_CONSTANT = set(range(14))


def sentinel_forest() -> Forest:
    return random_forest(31, 500, 4, [*[(0.0, 1.0)] * 16, (0.0, 16.0), *[(0.0, 1.0)] * 3], base_score=0.25, link="sigmoid", alpha=0.5)
