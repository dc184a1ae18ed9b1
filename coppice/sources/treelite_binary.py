"""Treelite's version-4 checkpoint: little-endian scalars, arrays with a u64 length before them."""

from __future__ import annotations

import math

import numpy as np

from ..config import LoadOptions
from ..errors import MalformedModel, Unsupported
from ..model import Forest, Node
from .treelite_json import checked_scalar

# Field order, codes and versions of the format.
MODEL = [
    ("num_feature", "i4"), ("task_type", "u1"), ("average_tree_output", "?"), ("num_target", "i4"), ("num_class", ["i4"]),
    ("leaf_vector_shape", ["i4"]), ("target_id", ["i4"]), ("class_id", ["i4"]), ("postprocessor", "str"),
    ("sigmoid_alpha", "f4"), ("ratio_c", "f4"), ("base_scores", ["f8"]), ("attributes", "str"), ("extensions", "i4"),
]
TREE = [
    ("num_nodes", "i4"), ("has_categorical_split", "?"), ("node_type", ["i1"]), ("cleft", ["i4"]), ("cright", ["i4"]),
    ("split_index", ["i4"]), ("default_left", ["?"]), ("leaf_value", ["T"]), ("threshold", ["T"]), ("cmp", ["i1"]),
    ("category_list_right_child", ["?"]), ("leaf_vector", ["T"]), ("leaf_vector_begin", ["u8"]), ("leaf_vector_end", ["u8"]),
    ("category_list", ["u4"]), ("category_list_begin", ["u8"]), ("category_list_end", ["u8"]), ("data_count", ["u8"]),
    ("data_count_present", ["?"]), ("sum_hess", ["f8"]), ("sum_hess_present", ["?"]), ("gain", ["f8"]), ("gain_present", ["?"]),
    ("tree_extensions", "i4"), ("node_extensions", "i4"),
]
TYPES = {2: "float32", 3: "float64"}
TASKS = ["kBinaryClf", "kRegressor", "kMultiClf", "kLearningToRank", "kIsolationForest"]
COMPARISONS = {2: "<", 3: "<="}
LEAF, NUMERICAL, CATEGORICAL = 0, 1, 2
MAJOR, MINORS = 4, range(8)


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.type = raw, 0, "f8"

    def take(self, kind: str, n: int) -> np.ndarray:
        kind = np.dtype("u1" if kind == "?" else "<" + (self.type if kind == "T" else kind))
        end = self.at + n * kind.itemsize
        if end > len(self.raw):
            raise MalformedModel("the file ends early")
        found = np.frombuffer(self.raw, kind, n, self.at)
        self.at = end
        return found

    def field(self, kind):
        if isinstance(kind, list):
            found = self.take(kind[0], int(self.take("u8", 1)[0]))
        elif kind == "str":
            return self.take("u1", int(self.take("u8", 1)[0])).tobytes().decode()
        else:
            found = self.take(kind, 1)
        if "?" in kind and (found > 1).any():
            raise MalformedModel("a flag is neither 0 nor 1")
        return found if isinstance(kind, list) else found[0].item()


def read(raw: bytes, options: LoadOptions) -> Forest:
    r = _Reader(raw)
    major, minor, _ = r.take("i4", 3).tolist()
    if major != MAJOR or minor not in MINORS:
        raise Unsupported(f"version {major}.{minor}")
    types = [TYPES.get(t) for t in r.take("u1", 2).tolist()]
    r.type = "f4" if types[0] == "float32" else "f8"
    n_trees = r.field("u8")
    try:
        model = {"threshold_type": types[0], "leaf_output_type": types[1]} | {name: r.field(kind) for name, kind in MODEL}
    except UnicodeDecodeError as e:
        raise MalformedModel(str(e)) from e
    if not 0 <= model["task_type"] < len(TASKS):
        raise MalformedModel("task type")
    model["task_type"] = TASKS[model["task_type"]]
    checked_scalar(model)
    if len(model["target_id"]) != n_trees or len(model["class_id"]) != n_trees or model["extensions"]:
        raise MalformedModel("trees or extensions")
    trees = tuple(_tree({name: r.field(kind) for name, kind in TREE}) for _ in range(n_trees))
    if r.at != len(raw):
        raise MalformedModel("bytes after the last tree")
    return Forest(trees, model["num_feature"], types[0] == "float32", float(model["base_scores"][0]),
                  bool(model["average_tree_output"]), model["postprocessor"], model["sigmoid_alpha"], options)


def _tree(t: dict) -> tuple[Node, ...]:
    n = t["num_nodes"]
    per_node = ("node_type", "cleft", "cright", "split_index", "default_left", "leaf_value", "threshold", "cmp",
                "category_list_right_child", "category_list_begin", "category_list_end")
    optional = ("data_count", "data_count_present", "sum_hess", "sum_hess_present", "gain", "gain_present", "leaf_vector_begin", "leaf_vector_end")
    if n < 1 or any(len(t[f]) != n for f in per_node) or any(len(t[f]) not in (0, n) for f in optional):
        raise MalformedModel("array lengths of a tree")
    if len(t["leaf_vector"]):
        raise Unsupported("vector leaves")
    if t["tree_extensions"] or t["node_extensions"]:
        raise Unsupported("extensions")
    return tuple(_node(t, j) for j in range(n))


def _node(t: dict, j: int) -> Node:
    weight = 1.0
    for name in ("sum_hess", "data_count"):
        if len(t[name]) and len(t[name + "_present"]) and t[name + "_present"][j]:
            weight = float(t[name][j])
    if t["cleft"][j] == -1:
        return Node(value=float(t["leaf_value"][j]), weight=weight)
    left, right, default_left = int(t["cleft"][j]), int(t["cright"][j]), bool(t["default_left"][j])
    feature = int(t["split_index"][j])
    if t["node_type"][j] == NUMERICAL:
        if t["cmp"][j] not in COMPARISONS:
            raise Unsupported(f"comparison {t['cmp'][j]}")
        return Node(COMPARISONS[t["cmp"][j]], feature, float(t["threshold"][j]), (), default_left, left, right, 0.0, weight)
    if t["node_type"][j] != CATEGORICAL:
        raise MalformedModel("node type")
    begin, end = int(t["category_list_begin"][j]), int(t["category_list_end"][j])
    if not begin <= end <= len(t["category_list"]):
        raise MalformedModel("category list")
    if t["category_list_right_child"][j]:
        left, right, default_left = right, left, not default_left
    return Node("in", feature, math.nan, tuple(t["category_list"][begin:end].tolist()), default_left, left, right, 0.0, weight)


def write(forest: Forest) -> bytes:
    """The checkpoint of a forest."""
    kind = "f4" if forest.single else "f8"
    code = 2 if forest.single else 3
    out = [np.array([MAJOR, 4, 0], "<i4").tobytes(), bytes([code, code]), np.array([len(forest.trees)], "<u8").tobytes()]

    def put(fields, values):
        for name, k in fields:
            v = values.get(name, [] if isinstance(k, list) else 0)
            if k == "str":
                v = v.encode()
                out.append(np.array([len(v)], "<u8").tobytes() + v)
                continue
            inner = k[0] if isinstance(k, list) else k
            dtype = "u1" if inner == "?" else "<" + (kind if inner == "T" else inner)
            if isinstance(k, list):
                out.append(np.array([len(v)], "<u8").tobytes())
            out.append(np.array(v if isinstance(k, list) else [v], dtype).tobytes())

    zeros = [0] * len(forest.trees)
    put(MODEL, {"num_feature": forest.n_features, "task_type": 0 if forest.link == "sigmoid" else 1,
                "average_tree_output": forest.averaged, "num_target": 1, "num_class": [1], "leaf_vector_shape": [1, 1],
                "target_id": zeros, "class_id": zeros, "postprocessor": forest.link, "sigmoid_alpha": forest.alpha,
                "ratio_c": 1.0, "base_scores": [forest.base_score], "attributes": "{}"})
    for tree in forest.trees:
        ends = np.cumsum([len(n.categories) for n in tree]).tolist()
        put(TREE, {
            "num_nodes": len(tree), "has_categorical_split": any(n.op == "in" for n in tree),
            "node_type": [LEAF if n.op is None else CATEGORICAL if n.op == "in" else NUMERICAL for n in tree],
            "cleft": [n.left for n in tree], "cright": [n.right for n in tree], "split_index": [n.feature for n in tree],
            "default_left": [n.default_left for n in tree], "leaf_value": [n.value for n in tree],
            "threshold": [0.0 if n.op in (None, "in") else n.threshold for n in tree],
            "cmp": [{"<": 2, "<=": 3}.get(n.op, 0) for n in tree], "category_list_right_child": [False] * len(tree),
            "category_list": [c for n in tree for c in n.categories],
            "category_list_begin": [0, *ends[:-1]], "category_list_end": ends,
            "sum_hess": [n.weight for n in tree], "sum_hess_present": [True] * len(tree),
        })
    return b"".join(out)
