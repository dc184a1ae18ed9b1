"""LightGBM's text form."""

from __future__ import annotations

import math
import re

from ..config import LoadOptions
from ..errors import MalformedModel, Unsupported
from ..model import Forest, Node, f32

# Objectives of the format and the bits of decision_type.
IDENTITY = {"regression", "regression_l1", "huber", "fair", "quantile", "mape", "lambdarank", "rank_xendcg", "custom", "none", ""}
CATEGORICAL_BIT, DEFAULT_LEFT_BIT, MISSING_SHIFT, MISSING_NAN = 1, 2, 2, 2


def read(raw: bytes, options: LoadOptions) -> Forest:
    try:
        return _forest(raw.decode(), options)
    except (KeyError, ValueError, IndexError, OverflowError) as e:
        raise MalformedModel(f"{type(e).__name__}: {e}") from e


def _pairs(block: str) -> dict[str, str]:
    return dict(line.split("=", 1) for line in block.splitlines() if "=" in line)


def _forest(text: str, options: LoadOptions) -> Forest:
    body, end, _ = text.partition("\nend of trees")
    head, *blocks = re.split(r"^Tree=\d+[ \t\r]*$", body, flags=re.M)
    if not head.startswith("tree") or not end:
        raise MalformedModel("no header or no end of trees")
    header = _pairs(head)
    if int(header["num_class"]) != 1 or int(header["num_tree_per_iteration"]) != 1:
        raise Unsupported("more than one class")
    link, alpha = _link(header.get("objective", ""))
    averaged = re.search(r"^average_output\s*$", head, re.M) is not None
    return Forest(tuple(_tree(_pairs(b)) for b in blocks), int(header["max_feature_idx"]) + 1, False, 0.0, averaged, link, alpha, options)


def _link(objective: str) -> tuple[str, float]:
    name, *settings = objective.split() or [""]
    if "sqrt" in settings:
        raise Unsupported("objective with sqrt")
    if name in IDENTITY:
        return "identity", 1.0
    if name == "cross_entropy":
        return "sigmoid", 1.0
    if name == "binary":
        given = dict(s.split(":", 1) for s in settings if ":" in s)
        if "sigmoid" not in given:
            raise MalformedModel("binary objective without sigmoid")
        return "sigmoid", f32(float(given["sigmoid"]))
    raise Unsupported(f"objective {name}")


def _tree(t: dict[str, str]) -> tuple[Node, ...]:
    """Splits come first, leaves after them; a negative child -1-k of the file is leaf k."""
    if int(t.get("is_linear", "0")):
        raise Unsupported("linear leaves")

    def numbers(name, kind=float):
        return [kind(x) for x in t.get(name, "").split()]

    n_leaves = int(t["num_leaves"])
    values, leaf_weights = numbers("leaf_value"), numbers("leaf_count")
    if len(values) != n_leaves or n_leaves < 1:
        raise MalformedModel("leaf_value")
    leaf_weights = leaf_weights or [1.0] * n_leaves
    leaves = [Node(value=v, weight=w) for v, w in zip(values, leaf_weights, strict=True)]
    n = n_leaves - 1
    if not n:
        return tuple(leaves)
    feature, kinds = numbers("split_feature", int), numbers("decision_type", int)
    lefts, rights, thresholds = numbers("left_child", int), numbers("right_child", int), numbers("threshold")
    weights = numbers("internal_count") or [1.0] * n
    if {len(feature), len(kinds), len(lefts), len(rights), len(thresholds), len(weights)} != {n}:
        raise MalformedModel("split arrays")
    starts, words, used = numbers("cat_boundaries", int), numbers("cat_threshold", int), set()

    def place(child):
        return child if child >= 0 else n + (-1 - child)

    splits = []
    for j in range(n):
        left, right = place(lefts[j]), place(rights[j])
        if kinds[j] & CATEGORICAL_BIT:
            at = int(thresholds[j])
            if at in used or at != thresholds[j] or at < 0:
                raise MalformedModel("categorical split")
            used.add(at)
            mine = words[starts[at] : starts[at + 1]]
            members = tuple(32 * k + b for k, w in enumerate(mine) for b in range(32) if w >> b & 1)
            splits.append(Node("in", feature[j], math.nan, members, False, left, right, 0.0, weights[j]))
        else:
            by_bit = kinds[j] >> MISSING_SHIFT & 3 == MISSING_NAN
            default_left = bool(kinds[j] & DEFAULT_LEFT_BIT) if by_bit else 0.0 <= thresholds[j]
            splits.append(Node("<=", feature[j], thresholds[j], (), default_left, left, right, 0.0, weights[j]))
    return (*splits, *leaves)
