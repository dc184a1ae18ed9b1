"""Plans against the plain evaluator, and queries against their SQL twins."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from coppice import models, oracles, queries
from coppice.config import GroupingConfig
from coppice.operators import contracts, estimates, stats, workloads
from coppice.plans.predictor import Predictor
from coppice.sources import tables
from coppice.streaming.scoring import score_stream

RANGES = [(-1.0, 1.0), 40, (0.0, 5.0)]
NAMES = ["a", "b", "c"]
ODD = [-math.inf, -1.0, -0.5, -0.0, 0.0, 1.0, 1.0 + 2**-25, 1.99, 31.0, 32.0, 40.0, 2.0**32, math.inf, math.nan, None]
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(n=150):
    rng = random.Random(1)
    return [(k, k % 2 if k < 20 else 2, *[rng.choice([*ODD, rng.uniform(-1, 5)]) for _ in NAMES]) for k in range(n)]


def forests():
    plain = models.random_forest(5, 6, 4, RANGES, base_score=0.125, link="sigmoid", alpha=0.5)
    return {"long": plain, "averaged": models.random_forest(6, 5, 3, RANGES, averaged=True),
            "single": models.random_forest(7, 6, 4, RANGES, single=True), "decimal": models.scaled_leaves(plain, 2, 2.0**-60),
            "wide": models.scaled_leaves(plain, 2, 2.0**-140), "categories": models.shifted_categories(plain, 200)}


@pytest.mark.parametrize("kind", sorted(forests()))
def test_plans_agree_with_the_evaluator(spark, kind):
    forest = forests()[kind]
    given = rows()
    df = spark.createDataFrame(given, "id BIGINT, g BIGINT, a DOUBLE, b DOUBLE, c DOUBLE")
    want = {r[0]: forest.stages(r[2:]) for r in given}
    predictor = Predictor(forest, GroupingConfig(3, (0, 1, 2)), NAMES)
    plans = ["walker"] if kind == "wide" else ["walker", "cases", "frontier"]
    for plan in plans:
        got = predictor.predict(df, plan, group="g", order=["id"]).collect()
        assert len(got) == len(given)
        for r in got:
            assert (r.tree_sum, r.raw_margin) == want[r.id][:2], (plan, r)
            assert r.output == pytest.approx(want[r.id][2], abs=1e-14, rel=1e-12)


def test_pushed_plan_uses_the_entities(spark):
    forest = forests()["long"]
    given = rows()
    first = {}
    for r in given:
        first.setdefault(r[1], r[2:4])
    entities = spark.createDataFrame([(g, *x) for g, x in first.items()], "g BIGINT, a DOUBLE, b DOUBLE")
    lines = spark.createDataFrame([(r[0], r[1], r[4]) for r in given], "id BIGINT, g BIGINT, c DOUBLE")
    got = Predictor(forest, GroupingConfig(3, (2,)), NAMES).predict_pushed(entities, lines, "g").collect()
    assert {r.id: r.tree_sum for r in got} == {r[0]: forest.stages((*first[r[1]], r[4]))[0] for r in given}


def test_no_rows_and_no_trees(spark):
    forest = forests()["long"]
    none = spark.createDataFrame([], "id BIGINT, g BIGINT, a DOUBLE, b DOUBLE, c DOUBLE")
    predictor = Predictor(forest, GroupingConfig(3, (0, 1, 2)), NAMES)
    for plan in ("cases", "walker", "frontier"):
        out = predictor.predict(none, plan, group="g", order=["id"])
        assert out.collect() == [] and {"tree_sum", "raw_margin", "output"} <= set(out.columns)


def test_streaming_equals_batch(spark, tmp_path):
    forest = forests()["long"]
    spark.createDataFrame(rows(), "id BIGINT, g BIGINT, a DOUBLE, b DOUBLE, c DOUBLE").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    predictor = Predictor(forest, GroupingConfig(3, (0, 1, 2)), NAMES)
    query = score_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), predictor).writeStream.format("memory").queryName(
        "scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.id: r.tree_sum for r in spark.table("scored").collect()}
    assert got == {r.id: r.tree_sum for r in predictor.predict(batch).collect()}


def test_saved_model_and_files(spark, tmp_path):
    forest = forests()["categories"]
    tables.save_model(spark, forest, str(tmp_path / "m"))
    assert tables.load_model(spark, str(tmp_path / "m")).fingerprint() == forest.fingerprint()
    x = np.arange(6.0).reshape(3, 2)
    (tmp_path / "x.bin").write_bytes(tables.write_matrix(x))
    assert [r.features for r in tables.matrix_frame(spark, str(tmp_path / "x.bin")).orderBy("row_no").collect()] == x.tolist()
    assert tables.read_offsets(tables.write_offsets([0, 2, 5])) == [0, 2, 5]
    with pytest.raises(Exception, match="rise"):
        tables.read_offsets(tables.write_offsets([0, 2, 2]))
    (tmp_path / "d.arff").write_text("% c\n@relation r\n@data\n1,?\n% c\n2, 3\n")
    assert [tuple(r) for r in tables.read_arff(spark, str(tmp_path / "d.arff"), ["p", "q"]).orderBy("p").collect()] == [(1.0, None), (2.0, 3.0)]
    parts = [spark.range(3).withColumnRenamed("id", "k"), spark.range(2).withColumnRenamed("id", "k")]
    tables.pack(parts, parts[0].schema, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == 5


def test_batches_are_greedy(spark):
    given = [(k % 2, k, (k * 7) % 11 + 1) for k in range(60)]
    df = spark.createDataFrame(given, "s BIGINT, k BIGINT, n BIGINT")
    got = {(r.s, r.k): r.batch for r in stats.pack_batches(df, "s", "k", "n", 20).collect()}
    for s, mine in itertools.groupby(sorted(given), key=lambda r: r[0]):
        batch = used = 0
        for _, k, n in mine:
            if used and used + n > 20:
                batch, used = batch + 1, 0
            used += n
            assert got[s, k] == batch


def test_bootstrap_holds_the_ratio(spark):
    df = spark.createDataFrame([("x", k % 5, float(k), 2.0) for k in range(50)], "c STRING, b BIGINT, t DOUBLE, n DOUBLE")
    r = estimates.clustered_ratio(df, ["c"], "b", F.col("t"), F.col("n"), 100, 1).first()
    assert r.ratio == sum(range(50)) / 100 and r.low <= r.ratio <= r.high


def test_contracts_and_shares(spark):
    df = spark.createDataFrame([(1, 1.0, math.nan), (1, 1.0, None), (2, 1.0, 3.0), (2, 2.0, math.nan)], "g BIGINT, x DOUBLE, y DOUBLE")
    assert sorted(map(tuple, contracts.constant_violations(df, "g", ["x", "y"]).collect())) == [(2, "x"), (2, "y")]
    with pytest.raises(ValueError):
        contracts.check_call(df, ["x", "y"], "g", GroupingConfig(2, (0, 1), max_group_width=1))
    assert workloads.varying_for_share({0: 5, 1: 3, 2: 2}, 0.5) == (0,)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    found = con.execute(oracles.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(d[0] for d in found.description) == columns

    def ordered(values):
        return sorted(values, key=lambda row: tuple((v is None, 0 if v is None else v) for v in row))

    place = [[d[0] for d in found.description].index(c) for c in columns]
    assert ordered(tuple(r[c] for c in columns) for r in df.collect()) == ordered(tuple(r[p] for p in place) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_orderkey", "n_rows", "total", "top_margin", "top_output"]
