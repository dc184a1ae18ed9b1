"""Loading, normalising and evaluating models on the driver."""

import json
import math

import pytest

from coppice import models
from coppice.config import ConfigBuilder, GroupingConfig, LoadOptions
from coppice.errors import LimitExceeded, MalformedConfig, MalformedModel, ModelIOError, Unsupported
from coppice.model import Forest, Node, f32
from coppice.sources import treelite_binary, treelite_json

RANGES = [(-1.0, 1.0), 40, (0.0, 5.0)]
STUMP = (Node("<=", 0, 1.0, left=1, right=2, default_left=True), Node(value=0.25), Node(value=-0.5))


@pytest.mark.parametrize("single", [False, True])
def test_round_trips_through_json_and_binary(single):
    forest = models.random_forest(3, 5, 4, RANGES, single=single, base_score=0.5, link="sigmoid", alpha=2.5)
    for form, raw in (("json", treelite_json.write(forest).encode()), ("bin", treelite_binary.write(forest))):
        back = Forest.from_bytes(raw, form)
        assert back.fingerprint() == forest.fingerprint()


def test_missing_goes_by_default_and_signed_zeros_are_equal():
    assert Forest((STUMP,), 1).stages([math.nan])[0] == 0.25
    zero = (Node("<", 0, -0.0, left=1, right=2), Node(value=1.0), Node(value=2.0))
    assert Forest((zero,), 1).stages([0.0])[0] == 2.0
    assert Forest((zero,), 1).stages([-0.0])[0] == 2.0


@pytest.mark.parametrize("x, inside", [(1.99, True), (-0.5, False), (40.0, True), (2.0**32, False), (math.inf, False), (2.0, False), (None, False)])
def test_category_edges(x, inside):
    tree = (Node("in", 0, categories=(40, 1, 1), left=1, right=2), Node(value=1.0), Node(value=2.0))
    assert Forest((tree,), 1).stages([x])[0] == (1.0 if inside else 2.0)


def test_float32_rounds_input_and_threshold():
    tree = (Node("<", 0, 1.0 + 2**-30, left=1, right=2), Node(value=1.0), Node(value=2.0))
    assert Forest((tree,), 1, single=True).stages([1.0])[0] == 2.0
    assert f32(1e300) == math.inf


def test_sums_are_exact():
    leaves = [(Node(value=v),) for v in (2.0**60, 1.0, -(2.0**60))]
    forest = Forest(tuple(leaves), 1)
    assert forest.stages([0.0])[0] == 1.0 and forest.sum_plan.kind == "long"
    assert Forest((*leaves, (Node(value=2.0**-40),)), 1).sum_plan.kind == "decimal"
    assert Forest((*leaves, (Node(value=2.0**-96),)), 1).sum_plan.kind == "wide"


def test_averaging_divides_before_the_base():
    forest = Forest((STUMP, STUMP, STUMP), 1, averaged=True, base_score=3.0)
    assert forest.stages([0.0]) == (0.75, 3.25, 3.25)


@pytest.mark.parametrize("tree", [
    (Node("<=", 0, 1.0, left=1, right=1), Node()), (Node("<=", 0, 1.0, left=0, right=1), Node()),
    (Node("<=", 0, 1.0, left=1, right=9), Node(), Node()), (Node(), Node()), (),
    (Node("<=", 0, math.nan, left=1, right=2), Node(), Node()), (Node(value=math.inf),),
    (Node("<", 0, -math.inf, left=1, right=2), Node(), Node()), (Node("<=", 3, 1.0, left=1, right=2), Node(), Node()),
])
def test_malformed_trees(tree):
    with pytest.raises(MalformedModel):
        Forest((tree,), 1)


def test_members_on_the_right_swap_sides_and_default():
    model = json.loads(treelite_json.write(Forest(((Node("in", 0, categories=(1,), left=1, right=2), Node(value=1.0), Node(value=2.0)),), 1)))
    model["trees"][0]["nodes"][0] |= {"category_list_right_child": True, "default_left": True}
    forest = Forest.from_bytes(json.dumps(model).encode(), "json")
    assert [forest.stages([x])[0] for x in (1.0, 5.0, math.nan)] == [2.0, 1.0, 1.0]


def test_json_rejections():
    good = json.loads(treelite_json.write(Forest((STUMP,), 1)))
    for change, error in (({"surplus": 1}, MalformedModel), ({"num_class": [3]}, Unsupported), ({"task_type": "kMultiClf"}, Unsupported),
                          ({"postprocessor": "softmax"}, Unsupported), ({"leaf_output_type": "float32"}, Unsupported),
                          ({"base_scores": [0.0, 1.0]}, MalformedModel), ({"sigmoid_alpha": -1.0}, MalformedModel)):
        with pytest.raises(error):
            Forest.from_bytes(json.dumps(good | change).encode(), "json")


def test_truncated_binary_at_every_length():
    raw = treelite_binary.write(Forest((STUMP,), 1))
    for n in range(len(raw)):
        with pytest.raises((MalformedModel, Unsupported)):
            Forest.from_bytes(raw[:n], "bin")
    with pytest.raises(MalformedModel):
        Forest.from_bytes(raw + b"\0", "bin")


LIGHTGBM = """tree
num_class=1
num_tree_per_iteration=1
max_feature_idx=1
objective={objective}

Tree=0
num_leaves=3
num_cat=1
split_feature=0 1
threshold=0 0.5
decision_type=1 {kind}
left_child=-1 -2
right_child=1 -3
leaf_value=1 2 4
cat_boundaries=0 2
cat_threshold=2 1

end of trees
"""


def test_lightgbm_text():
    def load(objective="regression", kind=2):
        return Forest.from_bytes(LIGHTGBM.format(objective=objective, kind=kind).encode(), "txt")

    forest = load()
    assert [forest.stages([x, 9.0])[0] for x in (1.0, 32.0, 2.0, math.nan)] == [1.0, 1.0, 4.0, 4.0]
    assert load(kind=2).stages([7.0, math.nan])[0] == 2.0  # no missing type: as zero
    assert load(kind=8).stages([7.0, math.nan])[0] == 4.0  # missing type NaN, default right
    assert load("binary sigmoid:0.1").alpha == f32(0.1)
    for objective in ("multiclass", "poisson", "regression sqrt"):
        with pytest.raises(Unsupported):
            load(objective)


def test_files_and_limits(tmp_path):
    (tmp_path / "m.json").write_text(treelite_json.write(Forest((STUMP,), 1)))
    assert Forest.load(str(tmp_path / "m.json")).n_nodes == 3
    with pytest.raises(Unsupported):
        Forest.load(str(tmp_path / "m.onnx"))
    with pytest.raises(ModelIOError):
        Forest.load(str(tmp_path / "none.json"))
    with pytest.raises(LimitExceeded):
        Forest.load(str(tmp_path / "m.json"), LoadOptions(max_nodes=2))


def test_configurations():
    built = ConfigBuilder().n_features(3).varying(2, 1).increasing(1).build()
    assert built == GroupingConfig.from_json(built.to_json()) and built.constant_features == (0,)
    for bad in ({"n_features": 2, "varying_features": [2]}, {"n_features": 2, "varying_features": [1, 1]}, {"n_features": 2},
                {"n_features": 2, "varying_features": [1], "mono_inc_features": [0]}, {"n_features": True, "varying_features": []},
                {"n_features": 2, "varying_features": [1], "mono_inc_features": [1], "mono_dec_features": [1]}):
        with pytest.raises(MalformedConfig):
            GroupingConfig.from_json(json.dumps(bad))
    with pytest.raises(LimitExceeded):
        GroupingConfig.from_json(" " * 70_000)
