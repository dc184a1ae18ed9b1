"""Grouped walks, exact digits, schedules, estimates, views of forests and the command line."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice import cli, models
from coppice.config import GroupingConfig, LoadOptions
from coppice.functions.ordering import first_in_order, quantiles, seeded
from coppice.model import Forest, Node
from coppice.errors import LimitExceeded, MalformedModel, ModelIOError
from coppice.operators import estimates, prep, schedule, structure, workloads
from coppice.plans import cases
from coppice.plans.grouped import Walk, run_starts
from coppice.plans.options import Options
from coppice.plans.predictor import Predictor
from coppice.plans.walker import Arrays
from coppice.sources import run_tables, tables, treelite_json

RANGES = [(0.0, 1.0), 6, (0.0, 1.0), (0.0, 1.0), 40, (0.0, 1.0)]


def grouped_rows(seed, constant):
    rng = np.random.default_rng(seed)
    group = np.repeat(np.arange(40), rng.integers(1, 150, 40))
    x = rng.random((len(group), 6))
    x[:, 1], x[:, 4] = rng.integers(-1, 7, len(group)), rng.integers(0, 45, len(group))
    x[rng.random(x.shape) < 0.05] = np.nan
    for c in constant:
        x[:, c] = x[np.searchsorted(group, group), c]
    return group, x


@pytest.mark.parametrize("kind", ["long", "single", "decimal", "wide", "far", "categories"])
def test_walks_of_rows_and_of_runs_equal_the_evaluator(kind):
    forest = models.random_forest(3, 9, 5, RANGES, single=kind == "single")
    forest = {"decimal": models.scaled_leaves(forest, 2, 2.0**-60), "wide": models.scaled_leaves(forest, 2, 2.0**-140), "far": models.scaled_leaves(forest, 2, 2.0**-1000),
              "categories": models.shifted_categories(forest, 20)}.get(kind, forest)
    group, x = grouped_rows(1, {0, 1, 2})
    want = np.array([forest.stages(r)[0] for r in x])
    assert (Arrays(forest).sums(x) == want).all()
    for constant in ({0, 1, 2}, set(), {1}):
        assert (Walk(forest, constant).sums(x, run_starts(group)) == want).all()
    assert (Walk(forest, set(range(6))).sums(x, np.arange(len(x))) == want).all()


def test_wide_sums_round_once_and_may_overflow():
    big, small = 1.7e308, 5e-324
    forest = Forest(tuple((Node(value=v),) for v in (big, small, -big, 0.1, 0.2)), 1)
    assert Arrays(forest).sums(np.zeros((2, 1))).tolist() == [math.fsum([big, small, -big, 0.1, 0.2])] * 2
    assert Arrays(Forest(((Node(value=big),), (Node(value=big),), (Node(value=1e-300),)), 1)).sums(np.zeros((1, 1))).tolist() == [math.inf]


def test_runs_are_cut_at_changes_and_at_the_width():
    assert run_starts(np.array([3] * 130 + [4] + [3] * 2)).tolist() == [0, 64, 128, 130, 131]
    assert run_starts(np.zeros(0)).tolist() == []


def test_options_change_nothing(spark):
    forest = models.random_forest(5, 6, 4, [(-1.0, 1.0), 10, (0.0, 5.0)], base_score=0.125)
    rng = random.Random(2)
    rows = [(k, k % 7, rng.uniform(0, 5)) for k in range(60)]
    entities = {g: (rng.uniform(-1, 1), float(rng.randrange(10))) for g in range(7)}
    lines = spark.createDataFrame(rows, "id BIGINT, g BIGINT, c DOUBLE")
    frame = spark.createDataFrame([(g, *x) for g, x in entities.items()], "g BIGINT, a DOUBLE, b DOUBLE")
    predictor = Predictor(forest, GroupingConfig(3, (2,)), ["a", "b", "c"])
    want = {k: forest.stages((*entities[g], c))[0] for k, g, c in rows}
    labels = []
    for options in Options.ablations():
        labels.append(options.label)
        assert {r.id: r.tree_sum for r in predictor.predict_pushed(frame, lines, "g", options).collect()} == want
        assert {r.id: r.tree_sum for r in predictor.predict(lines.join(frame, "g"), "cases", options=options).collect()} == want
    assert labels[0] == "all-on" and len(set(labels)) == len(labels)
    assert {r.id: r.tree_sum for r in predictor.predict(lines.join(frame, "g"), "grouped", group="g").collect()} == want


def test_sums_of_trees_stay_out_of_whole_stage_codegen(spark):
    df = spark.createDataFrame([(0.5, 1.0, 0.1, 0.2, 3.0, 0.3)], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, f DOUBLE")
    scored = cases.score(df, models.random_forest(3, 9, 5, RANGES), list("abcdef"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    sums = [line for line in plan.split("\n") if "Project" in line and "CASE WHEN" in line]
    assert sums and not any("*(" in line for line in sums)


def test_generator_and_hash_are_the_published_ones():
    rng = schedule.SplitMix(0)
    assert [rng.word() for _ in range(3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    assert schedule.name_seed(0, "") == 0xCBF29CE484222325 and schedule.name_seed(0, "a") == 0xAF63DC4C8601EC8C
    assert sorted(schedule.SplitMix(5).shuffled(range(50))) == list(range(50))
    assert {schedule.SplitMix(k).below(3) for k in range(50)} == {0, 1, 2}


def test_schedules_are_balanced(spark):
    for n, methods, batches in ((1, 1, 4), (10, 3, 4), (7, 2, 7), (5, 4, 1)):
        s = schedule.Schedule.of(n, methods, batches, 9)
        assert sorted(g for b in s.batches for g in b) == list(range(n)) and len(s.batches) == min(batches, n)
        assert max(map(len, s.batches)) - min(map(len, s.batches)) <= 1
        places = [sum(s.order_of(r).index(m) for r in range(s.cycle)) for m in range(methods)]
        assert len(set(places)) == 1
    assert schedule.Schedule.of(5, 2, 2, 3, in_file_order=True).batches == ((0, 1, 2), (3, 4))
    with pytest.raises(ValueError):
        schedule.Schedule.of(0, 1, 1, 0)
    assert schedule.Schedule.of(4, 2, 2, 1).phases(spark, ["a", "b"], 3).count() == 12


@pytest.mark.parametrize("cap,least,seed", [(0, 1, 0), (100, 1, 1), (300, 1, 2), (5, 30, 3), (10**9, 1, 4)])
def test_samples_keep_one_probability(spark, cap, least, seed):
    rng = random.Random(seed)
    groups = spark.createDataFrame([(k, rng.choice((1, 2, 3, 5, 9, 40))) for k in range(200)], "g BIGINT, n BIGINT")
    timed, strata = schedule.systematic_sample(groups, "g", "n", cap, least, seed)
    assert timed.count() == 200
    rows = strata.collect()
    fraction = rows[0].fraction
    assert abs(sum(r.sampled for r in rows) - 200 * fraction) < 1 and timed.where("timed").count() == sum(r.sampled for r in rows) >= min(least, 200)
    assert schedule.design_faults(timed, "n", strata).where("counts or drift").count() == 0
    assert schedule.design_faults(timed, "n", strata.withColumn("pool", F.col("pool") + 1)).where("counts").count() == len(rows)


def test_quotas_and_quantiles_equal_sorting(spark):
    rng = random.Random(6)
    rows = [(k % 3, k, rng.choice((rng.random(), 0.5, None))) for k in range(3000)]
    df = spark.createDataFrame(rows, "s BIGINT, k BIGINT, v DOUBLE")
    quotas = spark.createDataFrame([(0, 5), (1, 0), (2, 2000)], "s BIGINT, quota BIGINT")
    got = first_in_order(df, ["s"], seeded(4, "k"), "k", quotas)
    import hashlib

    order = sorted((r for r in rows if r[0] == 0), key=lambda r: hashlib.md5(f"4:{r[1]}".encode()).hexdigest())
    assert got.columns == df.columns
    assert sorted(r.k for r in got.where("s = 0").collect()) == sorted(r[1] for r in order[:5])
    assert got.where("s = 1").count() == 0 and got.where("s = 2").count() == 1000
    values = [v for _, _, v in rows if v is not None]
    at = [0.0, 0.025, 0.31, 0.5, 0.975, 1.0]
    assert {r["at"]: r["value"] for r in quantiles(df, "v", at).collect()} == pytest.approx(dict(zip(at, np.quantile(values, at))))
    assert quantiles(df.where("false"), "v", at).count() == 0 and quantiles(df.limit(0).unionAll(df.where("k = 0").withColumn("v", F.lit(2.0))), "v", [0.1]).first()["value"] == 2.0


def test_draws_have_the_right_size_and_pair(spark):
    weights = estimates.unit_weights(spark.createDataFrame([(4,), (4,), (9,)], "n BIGINT"), 20, 3)
    sums = {(r.n, r.draw): r.total for r in weights.groupBy("n", "draw").agg(F.sum("weight").alias("total")).collect()}
    assert sums == {(n, d): n for n in (4, 9) for d in range(20)}
    same = spark.createDataFrame([("x", m, b, e, b % 2, 10 + b + e) for m in ("base", "other") for b in range(4) for e in range(5)], "c STRING, m STRING, b INT, e INT, r INT, v BIGINT")
    for r in estimates.nested_median_ratios(same, "c", "m", "b", "e", "r", "v", "base", 25, 1).collect():
        assert (r.ratio, r.low, r.high) == (1.0, 1.0, 1.0) and r.latency == 14
    one = estimates.crossed_ratio(same, ["c"], "e", "r", F.col("v"), F.col("v") * 2, 25, 1).first()
    assert (one.ratio, one.low, one.high) == (0.5, 0.5, 0.5)


def test_views_of_forests(spark):
    forest = models.random_forest(3, 5, 4, RANGES)
    trees = {r.tree: r for r in structure.trees(spark, forest).collect()}
    assert [trees[k].node_start for k in range(5)] == np.cumsum([0, *(len(t) for t in forest.trees)])[:-1].tolist()
    ranges = sorted((r.first, r.last, r.feature) for r in structure.feature_ranges(spark, forest).collect())
    assert ranges[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:])) and ranges[-1][1] == len(forest.predicates) - 1
    stump = Forest(((Node("<=", 0, 1.0, left=1, right=2), Node(value=1.0, weight=3.0), Node(value=2.0, weight=1.0)), (Node(value=0.0),)), 2)
    shares = {r["mode"]: (r["phi"], r["lambda"]) for r in structure.walk_shares(spark, stump, {0}).collect()}
    assert shares == {"never_split": (1 / 3, 2 / 3), "always_split": (1 / 4, 3 / 4)}
    assert [r.tree for r in structure.tree_order(spark, stump).orderBy("place").collect()] == [1, 0]
    assert [tuple(r) for r in structure.prefix_groups(spark, models.orders_forest(), range(6)).limit(1).collect()][0][1] >= 1
    assert prep is not None


def test_command_line(spark, tmp_path, capsys):
    forest = models.random_forest(3, 4, 3, [(0.0, 1.0), (0.0, 1.0)])
    (tmp_path / "m.json").write_text(treelite_json.write(forest))
    (tmp_path / "c.json").write_text(GroupingConfig(2, (1,)).to_json())
    rows = [(k, k / 10, 1 - k / 10) for k in range(10)]
    spark.createDataFrame(rows, "id BIGINT, a DOUBLE, b DOUBLE").write.parquet(str(tmp_path / "in"))
    cli.main(["score", "--model", str(tmp_path / "m.json"), "--config", str(tmp_path / "c.json"), "--features", "a,b", "--input", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark)
    assert {r.id: r.tree_sum for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {k: forest.stages((a, b))[0] for k, a, b in rows}
    assert cli.main(["nodes", "--model", str(tmp_path / "m.json")], spark).count() == forest.n_nodes
    assert cli.main(["model-stats", "--model", str(tmp_path / "m.json"), "--varying", "1"], spark).first().n_trees == 4
    (tmp_path / "cells.json").write_text(json.dumps(["support/nt500_md4_h16/lightgbm/panel", "x"]))
    cells = {r.cell: r for r in cli.main(["manifest", "--input", str(tmp_path / "cells.json"), "--seed", "3"], spark).collect()}
    assert (cells["support/nt500_md4_h16/lightgbm/panel"].n_trees, cells["x"].n_trees) == (500, None) and cells["x"].seed == str(schedule.name_seed(3, "x"))
    samples = spark.createDataFrame([("c", m, b, e, b % 2, b + e + 10) for m in ("base", "new") for b in range(4) for e in range(3)], "cell STRING, method STRING, block INT, entity INT, round INT, ticks BIGINT")
    samples.write.parquet(str(tmp_path / "samples"))
    out = cli.main(["summarize", "--input", str(tmp_path / "samples"), "--draws", "10", "--out", str(tmp_path / "est")], spark)
    assert out.count() == 2
    assert cli.main(["retime", "--input", str(tmp_path / "est"), "--percent", "1"], spark).count() == 0
    assert cli.main(["pack", "--inputs", str(tmp_path / "samples"), str(tmp_path / "samples"), "--out", str(tmp_path / "packed")], spark).count() == 1
    assert spark.read.parquet(str(tmp_path / "packed")).count() == 48
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)
    capsys.readouterr()


def test_run_tables_and_formats(spark, tmp_path):
    rows = [("s", "c", k, k, 10 * k, 10, k < 3) for k in range(4)]
    groups = spark.createDataFrame(rows, "suite STRING, cell STRING, group INT, entity INT, first_row INT, rows INT, timed BOOLEAN")
    run_tables.write(groups, "groups", str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "groups.parquet"))
    assert back.schema == run_tables.SCHEMAS["groups"] and back.count() == 4
    with pytest.raises(MalformedModel):
        run_tables.conform(groups.drop("timed"), "groups")
    samples = spark.createDataFrame([("c", "a", 0, 0, 10), ("c", "a", 0, 0, 10), ("c", "a", 0, 3, 10), ("c", "a", 0, 9, 10), ("c", "a", 0, 1, 11)], "cell STRING, method STRING, repetition INT, group INT, rows INT")
    assert tuple(run_tables.round_faults(samples, back).first())[3:] == (1, 1, 2, 2)
    x = np.arange(6.0).reshape(2, 3)
    assert (tables.read_npy(tables.write_npy(x)) == x).all()
    with pytest.raises(MalformedModel):
        tables.read_npy(b"no array")
    (tmp_path / "a.arff").write_text("% text\n@relation r\n@attribute a numeric\n@DATA\n1, ?\r\n\n% more\n2.5,3\n")
    assert [tuple(r) for r in tables.read_arff(spark, str(tmp_path / "a.arff"), ["a", "b"]).collect()] == [(1.0, None), (2.5, 3.0)]


def test_levels_and_features_of_whatifs(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.random(501), 2)
    donors = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    for n in (1, 4, 64):
        assert workloads.grid_levels(donors, "v", n) == np.quantile(values, (np.arange(n) + 0.5) / n, method="inverted_cdf").tolist()
    assert workloads.ranked_features({0: 3, 1: 5, 2: 5, 3: 0}, [0, 1, 2, 3, 4], 3) == [1, 2, 0]
    forest = models.random_forest(3, 5, 4, RANGES)
    assert sum(workloads.split_usage(forest).values()) == sum(n.op is not None for t in forest.trees for n in t)


def test_bins_and_remote_models(spark, tmp_path):
    edges, values = [0.5, 0.1, 0.5, -2.0, 9.0], [-3.0, -2.0, 0.1, 0.3, 0.5, 9.0, 10.0, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for inclusive in (False, True):
        got = df.select("v", prep.threshold_bin(F.col("v"), edges, inclusive).alias("bin")).collect()
        assert [r.bin for r in got] == [sum(e < r.v or (inclusive and e == r.v) for e in set(edges)) for r in got]
    assert df.select(prep.threshold_bin(F.col("v"), []).alias("bin")).distinct().collect()[0].bin == 0
    forest = models.random_forest(3, 2, 2, [(0.0, 1.0)])
    (tmp_path / "m.json").write_text(treelite_json.write(forest))
    assert Forest.load(f"file://{tmp_path}/m.json").fingerprint() == forest.fingerprint()
    with pytest.raises(ModelIOError):
        Forest.load(f"file://{tmp_path}/none.json")
    with pytest.raises(LimitExceeded):
        Forest.load(f"file://{tmp_path}/m.json", LoadOptions(max_file_bytes=3))
