"""Treelite's JSON form."""

from __future__ import annotations

import json
import math

from ..config import LoadOptions
from ..errors import MalformedModel, Unsupported
from ..model import Forest, Node

# Field names and words of the format.
MODEL_FIELDS = {
    "threshold_type", "leaf_output_type", "num_feature", "task_type", "average_tree_output", "num_target",
    "num_class", "leaf_vector_shape", "target_id", "class_id", "postprocessor", "sigmoid_alpha", "ratio_c",
    "base_scores", "attributes", "trees",
}
TREE_FIELDS = {"num_nodes", "has_categorical_split", "nodes", "root_id"}
SPLIT_FIELDS = {
    "node_id", "split_feature_id", "default_left", "node_type", "comparison_op", "threshold", "category_list",
    "category_list_right_child", "left_child", "right_child", "data_count", "sum_hess", "gain",
}
LEAF_FIELDS = {"node_id", "leaf_value", "data_count", "sum_hess", "gain"}
TASKS = {"kBinaryClf", "kRegressor", "kLearningToRank", "kIsolationForest"}
TYPES = {"float32": True, "float64": False}
LINKS = {"identity", "sigmoid"}


def read(raw: bytes, options: LoadOptions) -> Forest:
    try:
        model = json.loads(raw)
    except (ValueError, RecursionError) as e:
        raise MalformedModel(str(e)) from e
    try:
        return _forest(model, options)
    except (KeyError, TypeError, AttributeError, ValueError, OverflowError) as e:
        raise MalformedModel(f"{type(e).__name__}: {e}") from e


def _forest(model: dict, options: LoadOptions) -> Forest:
    _known(model, MODEL_FIELDS, "model")
    checked_scalar(model)
    trees = []
    for k, tree in enumerate(model["trees"]):
        _known(tree, TREE_FIELDS, f"tree {k}")
        if tree["num_nodes"] != len(tree["nodes"]) or not tree["nodes"]:
            raise MalformedModel(f"tree {k}: num_nodes")
        trees.append(_tree(tree, k))
    if len(model["target_id"]) != len(trees) or len(model["class_id"]) != len(trees):
        raise MalformedModel("target_id and class_id have one entry per tree")
    return Forest(tuple(trees), model["num_feature"], model["threshold_type"] == "float32", float(model["base_scores"][0]),
                  bool(model["average_tree_output"]), model["postprocessor"], float(model["sigmoid_alpha"]), options)


def checked_scalar(model: dict) -> None:
    """Raises Unsupported unless the model gives one number per row by a known link."""
    if model["threshold_type"] not in TYPES or model["leaf_output_type"] != model["threshold_type"]:
        raise Unsupported(f"types {model['threshold_type']} and {model['leaf_output_type']}")
    if model["task_type"] not in TASKS:
        raise Unsupported(f"task {model['task_type']}")
    if model["num_target"] != 1 or list(model["num_class"]) != [1] or list(model["leaf_vector_shape"]) != [1, 1]:
        raise Unsupported("only one target, one class and scalar leaves")
    if any(model["target_id"]) or any(model["class_id"]):
        raise Unsupported("trees of other targets or classes")
    if len(model["base_scores"]) != 1:
        raise MalformedModel("one base score")
    if model["postprocessor"] not in LINKS:
        raise Unsupported(f"postprocessor {model['postprocessor']}")


def _known(item: dict, fields: set, what: str) -> None:
    if not isinstance(item, dict) or set(item) - fields:
        raise MalformedModel(f"{what}: unknown fields")


def _tree(tree: dict, k: int) -> tuple[Node, ...]:
    """Nodes numbered from the root on; the ids of the file are any distinct numbers."""
    by_id = {n["node_id"]: n for n in tree["nodes"]}
    if len(by_id) != len(tree["nodes"]):
        raise MalformedModel(f"tree {k}: node ids repeat")
    children = {n[c] for n in tree["nodes"] if "leaf_value" not in n for c in ("left_child", "right_child")}
    root = tree.get("root_id")
    if root is None:
        roots = [i for i in by_id if i not in children]
        if len(roots) != 1:
            raise MalformedModel(f"tree {k}: no single root")
        root = roots[0]
    if root not in by_id:
        raise MalformedModel(f"tree {k}: root {root}")
    place = {i: p for p, i in enumerate([root, *(i for i in by_id if i != root)])}
    return tuple(_node(by_id[i], place) for i in place)


def _node(n: dict, place: dict) -> Node:
    weight = float(n.get("data_count", n.get("sum_hess", 1.0)))
    if "leaf_value" in n:
        _known(n, LEAF_FIELDS, "leaf")
        if isinstance(n["leaf_value"], list):
            raise Unsupported("vector leaves")
        return Node(value=float(n["leaf_value"]), weight=weight)
    _known(n, SPLIT_FIELDS, "split")
    left, right, default_left = place[n["left_child"]], place[n["right_child"]], n["default_left"]
    if not isinstance(default_left, bool):
        raise MalformedModel("default_left")
    if n["node_type"] == "numerical_test_node":
        return Node(n["comparison_op"], n["split_feature_id"], float(n["threshold"]), (), default_left, left, right, 0.0, weight)
    if n["node_type"] != "categorical_test_node":
        raise MalformedModel(f"node type {n['node_type']}")
    if n["category_list_right_child"]:  # members go right: swap, and missing values with them
        left, right, default_left = right, left, not default_left
    return Node("in", n["split_feature_id"], math.nan, tuple(n["category_list"]), default_left, left, right, 0.0, weight)


def write(forest: Forest) -> str:
    """The JSON form of a forest."""
    kind = "float32" if forest.single else "float64"
    trees = []
    for tree in forest.trees:
        nodes = []
        for j, n in enumerate(tree):
            if n.op is None:
                nodes.append({"node_id": j, "leaf_value": n.value, "sum_hess": n.weight})
                continue
            split = {"node_id": j, "split_feature_id": n.feature, "default_left": n.default_left, "left_child": n.left,
                     "right_child": n.right, "sum_hess": n.weight}
            if n.op == "in":
                split |= {"node_type": "categorical_test_node", "category_list_right_child": False, "category_list": list(n.categories)}
            else:
                split |= {"node_type": "numerical_test_node", "comparison_op": n.op, "threshold": n.threshold}
            nodes.append(split)
        trees.append({"num_nodes": len(nodes), "has_categorical_split": any(n.op == "in" for n in tree), "nodes": nodes, "root_id": 0})
    return json.dumps({
        "threshold_type": kind, "leaf_output_type": kind, "num_feature": forest.n_features,
        "task_type": "kBinaryClf" if forest.link == "sigmoid" else "kRegressor", "average_tree_output": forest.averaged,
        "num_target": 1, "num_class": [1], "leaf_vector_shape": [1, 1], "target_id": [0] * len(trees),
        "class_id": [0] * len(trees), "postprocessor": forest.link, "sigmoid_alpha": forest.alpha, "ratio_c": 1.0,
        "base_scores": [forest.base_score], "attributes": "{}", "trees": trees,
    })
