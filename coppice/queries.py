"""The registered queries of the scoring engine; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import models
from .config import GroupingConfig
from .functions.ordering import nearest_rank
from .operators import contracts, estimates, prep, schedule, stats, structure, workloads
from .plans import cases, frontier, grouped, walker
from .plans.options import Options
from .plans.predictor import Predictor
from .session import spread
from .sources import run_tables

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir) -> DataFrame:
    return spread(_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", F.substring("o_orderpriority", 1, 1).cast("double").alias("priority")))


def _lines(spark, sf_dir) -> DataFrame:
    """Line items; the highest taxes count as missing."""
    return spread(_table(spark, sf_dir, "lineitem").select(
        *LINE_KEY, "l_extendedprice", "l_discount", F.when(F.col("l_tax") <= 0.075, F.col("l_tax")).alias("l_tax")))


def _order_lines(spark, sf_dir) -> DataFrame:
    return _lines(spark, sf_dir).join(_orders(spark, sf_dir), "l_orderkey")


def _user_events(spark, sf_dir) -> DataFrame:
    """Events with per-user constants; event codes are null for signups."""
    events = spread(_table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", "props"))
    code = F.when(F.col("event_type") == "click", 0.0).when(F.col("event_type") == "error", 1.0).when(
        F.col("event_type") == "purchase", 2.0).when(F.col("event_type") == "view", 3.0)
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1)
    rows = events.select("event_id", "user_id", "value", code.alias("type_code"), F.when(k != "", k).cast("double").alias("k"))
    users = events.groupBy("user_id").agg(F.count("*").cast("double").alias("n_events"), F.max("value").alias("max_value"))
    return rows.join(users, "user_id")


def _samples(spark, sf_dir) -> DataFrame:
    """Events as timing samples of cells, variants and blocks."""
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1)
    return _table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("cell"), F.when(F.col("event_id") % 2 == 0, "base").otherwise("other").alias("variant"),
        (F.col("user_id") % 8).alias("block"), (F.col("event_id") % 5).alias("round"),
        F.round(F.col("value") * 100).cast("bigint").alias("ticks"), (F.when(k != "", k).cast("bigint") + 1).alias("n_rows"))


def forest_score_orders(spark, sf_dir):
    """Flagship: the forest over order lines, summarised by order; scored before anything is shuffled but the join."""
    config = GroupingConfig(6, (2, 3, 4, 5))
    scored = Predictor(models.orders_forest(), config, models.ORDER_FEATURES).predict_pushed(
        _orders(spark, sf_dir), _lines(spark, sf_dir), "l_orderkey")
    return scored.groupBy("l_orderkey").agg(
        F.count("*").alias("n_rows"), F.sum("tree_sum").alias("total"), F.max("raw_margin").alias("top_margin"),
        F.round(F.max("output"), 9).alias("top_output"))


def _staged(df):
    return df.select(*LINE_KEY, "tree_sum", "raw_margin", F.round("output", 9).alias("output"))


def forest_stages(spark, sf_dir):
    return _staged(cases.score(_order_lines(spark, sf_dir), models.orders_forest(), models.ORDER_FEATURES))


def forest_pushdown(spark, sf_dir):
    return _staged(cases.score_pushed(_orders(spark, sf_dir), _lines(spark, sf_dir), "l_orderkey", models.orders_forest(),
                                      models.ORDER_FEATURES, models.ORDER_CONSTANT))


def forest_walker(spark, sf_dir):
    return _staged(walker.score(_order_lines(spark, sf_dir), models.large_forest(), models.ORDER_FEATURES, LINE_KEY))


def _panel(spark, sf_dir):
    """Customers by 32 steps, in the order of their steps."""
    customers = spread(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"))
    code = F.when(F.col("c_mktsegment") == "AUTOMOBILE", 0.0).when(F.col("c_mktsegment") == "BUILDING", 1.0).when(
        F.col("c_mktsegment") == "FURNITURE", 2.0).when(F.col("c_mktsegment") == "MACHINERY", 3.0)
    held = customers.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), code.alias("segment"),
                            F.length(F.col("c_custkey").cast("string")).cast("double").alias("n_digits"), ((F.col("c_custkey") % 1000) / 1000.0).alias("key_share"))
    return workloads.panel(held, 32, "c_acctbal")


def _panel_stages(df):
    return df.select("c_custkey", F.col("t").cast("bigint").alias("t"), "tree_sum", "raw_margin")


def panel_walker(spark, sf_dir):
    """The full walk of every row of a panel."""
    return _panel_stages(walker.score(_panel(spark, sf_dir), models.panel_forest(), models.PANEL_FEATURES, ["c_custkey", "t"]))


def panel_grouped(spark, sf_dir):
    """The same rows, constant splits walked once for each customer."""
    return _panel_stages(grouped.score(_panel(spark, sf_dir), models.panel_forest(), models.PANEL_FEATURES, models.PANEL_CONSTANT, "c_custkey", ["c_custkey", "t"]))


def sentinel_rows(spark, sf_dir):
    """Orders by 16 steps, with 14 seeded covariates each; for benches."""
    orders = spread(_table(spark, sf_dir, "orders").select("o_orderkey"))
    held = orders.select("o_orderkey", *[(F.pmod(F.xxhash64("o_orderkey", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)).alias(f"x{k}") for k in range(14)])
    return workloads.panel(held, models.SENTINEL_STEPS, "x0")


def sentinel_walk(spark, sf_dir):
    """The full walk of every row of the sentinel."""
    return walker.score(sentinel_rows(spark, sf_dir), models.sentinel_forest(), models.SENTINEL_FEATURES, ["o_orderkey", "t"])


def sentinel_grouped(spark, sf_dir):
    """The same rows, what is constant walked once an entity."""
    return grouped.score(sentinel_rows(spark, sf_dir), models.sentinel_forest(), models.SENTINEL_FEATURES, models.SENTINEL_CONSTANT, "o_orderkey", ["o_orderkey", "t"])


def forest_average(spark, sf_dir):
    return _staged(cases.score(_order_lines(spark, sf_dir), models.averaged_forest(), models.ORDER_FEATURES))


def forest_float32(spark, sf_dir):
    return _staged(cases.score(_order_lines(spark, sf_dir), models.single_forest(), models.ORDER_FEATURES))


def forest_frontier(spark, sf_dir):
    scored = frontier.score(_user_events(spark, sf_dir), "user_id", ["event_id"], models.events_forest(), models.EVENT_FEATURES)
    return scored.select("event_id", "tree_sum", "raw_margin", F.round("output", 9).alias("output"))


def categorical_splits(spark, sf_dir):
    scored = cases.score(_user_events(spark, sf_dir), models.events_forest(), models.EVENT_FEATURES)
    return scored.select("event_id", "tree_sum", "raw_margin", F.round("output", 9).alias("output"))


def predict_group(spark, sf_dir):
    predictor = Predictor(models.events_forest(), GroupingConfig(5, (2, 3, 4)), models.EVENT_FEATURES)
    return predictor.predict_group(_user_events(spark, sf_dir), "user_id", 8).select("event_id", "tree_sum")


def predict_fixed(spark, sf_dir):
    predictor = Predictor(models.events_forest(), GroupingConfig(5, (2, 3, 4)), models.EVENT_FEATURES)
    scored = predictor.predict_fixed(_user_events(spark, sf_dir), 16, ["event_id"], shard="user_id")
    return scored.groupBy("user_id", "group_id").agg(F.count("*").alias("n_rows"), F.sum("tree_sum").alias("total"))


def predicate_masks(spark, sf_dir):
    return frontier.predicate_masks(_user_events(spark, sf_dir), "user_id", ["event_id"], models.events_forest(), models.EVENT_FEATURES).select(
        "user_id", F.col("word").cast("bigint").alias("word"), F.col("predicate").cast("bigint").alias("predicate"), "mask")


def work_counters(spark, sf_dir):
    return frontier.counters(_user_events(spark, sf_dir), "user_id", ["event_id"], models.events_forest(), models.EVENT_FEATURES, models.EVENT_CONSTANT)


def constant_violations(spark, sf_dir):
    return contracts.constant_violations(_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_discount", "l_tax"])


def monotone_violations(spark, sf_dir):
    return contracts.monotone_violations(_user_events(spark, sf_dir), "user_id", ["event_id"], "type_code")


def node_catalog(spark, sf_dir):
    """Splits per tree and feature of the flagship forest."""
    nodes = structure.nodes(spark, models.orders_forest())
    return nodes.filter("not is_leaf").groupBy("tree", "feature").agg(F.count("*").alias("n_splits"), F.count_distinct("predicate").alias("n_predicates"))


def tree_catalog(spark, sf_dir):
    return structure.trees(spark, models.events_forest())


def feature_ranges(spark, sf_dir):
    return structure.feature_ranges(spark, models.events_forest())


def tree_order(spark, sf_dir):
    return structure.tree_order(spark, models.large_forest())


def prefix_groups(spark, sf_dir):
    return structure.prefix_groups(spark, models.large_forest(), models.ORDER_CONSTANT)


def walk_shares(spark, sf_dir):
    """Shares of walk steps that stop at varying splits or leaves, for groups that never and that always split."""
    out = structure.walk_shares(spark, models.orders_forest(), set(range(6)) - models.ORDER_CONSTANT)
    return out.select("mode", *(F.round(c, 9).alias(c) for c in ("phi", "lambda", "events_per_step")))


def model_stats(spark, sf_dir):
    out = structure.model_stats(spark, models.orders_forest(), set(range(6)) - models.ORDER_CONSTANT)
    return out.select("n_trees", "n_nodes", "n_leaves", "n_predicates", F.round("varying_share", 9).alias("varying_share"), F.round("steps_leaf", 9).alias("steps_leaf"))


def panel_expand(spark, sf_dir):
    out = workloads.panel(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 12, "c_acctbal")
    return out.select("c_custkey", F.col("t").cast("bigint").alias("t"), "t_frac_sq", F.col("t_left").cast("bigint").alias("t_left"),
                      F.round("base_frac", 6).alias("base_frac"), F.round("t_sine", 9).alias("t_sine"))


def _orders_of(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")


def session_shuffle(spark, sf_dir):
    out = workloads.shuffled_sessions(_orders_of(spark, sf_dir), "o_custkey", "o_orderkey", 5)
    return out.select("o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))


def cohort_first_n(spark, sf_dir):
    out = workloads.cohorts(_orders_of(spark, sf_dir), "o_custkey", "o_orderkey", [2, 4, 8], 5)
    return out.select("o_custkey", "o_orderkey", F.col("width").cast("bigint").alias("width"), F.col("place").cast("bigint").alias("place"))


def whatif_variants(spark, sf_dir):
    out = workloads.whatifs(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", ["c_acctbal"], 8, 3)
    return out.select("c_custkey", F.col("variant").cast("bigint").alias("variant"), F.round("c_acctbal", 4).alias("c_acctbal"))


def whatif_donors(spark, sf_dir):
    base = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    donors = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("c_acctbal"))
    out = workloads.donor_whatifs(base, donors, "c_custkey", "s_suppkey", ["c_acctbal"], 4, 8, 9)
    return out.select("c_custkey", F.col("variant").cast("bigint").alias("variant"), "c_acctbal")


def whatif_grid(spark, sf_dir):
    """Suppliers at 4 by 3 levels of the two customer columns that the panel forest splits on most."""
    usage = workloads.split_usage(models.panel_forest())
    first, second = (models.PANEL_FEATURES[f] for f in workloads.ranked_features(usage, [0, 1], 2))
    customers = _table(spark, sf_dir, "customer")
    levels = {first: workloads.grid_levels(customers, first, 4), second: workloads.grid_levels(customers, second, 3)}
    grid = workloads.whatif_grid(_table(spark, sf_dir, "supplier").select("s_suppkey"), levels)
    return grid.select("s_suppkey", "c_acctbal", "c_nationkey")


def round_faults(spark, sf_dir):
    """Two rounds of two methods over the orders of even keys, with samples left out, repeated, of other groups and of wrong sizes."""
    sizes = _order_sizes(spark, sf_dir).select(F.lit("cell").alias("cell"), F.col("l_orderkey").alias("group"), F.col("n").alias("rows"), (F.col("l_orderkey") % 2 == 0).alias("timed"))
    key = F.col("group")
    copies = F.when(key % 50 == 8, 0).when(key % 60 == 10, 2).when((key % 2 == 1) & (key % 70 != 1), 0).otherwise(1)
    rounds = sizes.withColumn("repetition", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("method", F.explode(F.array(F.lit("a"), F.lit("b"))))
    kept = rounds.withColumn("__k", F.explode(F.when(F.col("method") == "b", F.array(F.lit(0))).otherwise(F.array_repeat(F.lit(0), copies)))).where(F.col("timed") | (F.col("method") == "a"))
    samples = kept.select("cell", "method", F.col("repetition").cast("bigint").alias("repetition"), "group", (F.col("rows") + (key % 90 == 4).cast("bigint")).alias("rows"))
    return run_tables.round_faults(samples, sizes)


def row_groups(spark, sf_dir):
    scored = cases.score(_user_events(spark, sf_dir), models.events_forest(), models.EVENT_FEATURES)
    return workloads.rows_as_groups(scored, F.col("event_id")).groupBy("group_id").agg(F.count("*").alias("n_rows"), F.sum("tree_sum").alias("total"))


def zero_fraction(spark, sf_dir):
    return workloads.zero_fraction(_table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"])


def draw_entities(spark, sf_dir):
    return workloads.draw(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 25, 21)


def category_encode(spark, sf_dir):
    """Codes from customers of even keys; segments and nations not among them get null."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    codes = prep.fit_codes(customers.filter("c_custkey % 2 = 0 and c_nationkey <> 7"), "c_nationkey")
    return prep.encode(customers, codes, "c_nationkey").select("c_custkey", F.col("code").cast("bigint").alias("code"))


def entity_split(spark, sf_dir):
    out = prep.split_entities(_table(spark, sf_dir, "orders"), "o_custkey", 0.2, 1)
    return out.groupBy("is_test").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_entities"))


def digitize_bins(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    edges = prep.quantile_edges(orders, "o_totalprice", 8)
    binned = orders.join(F.broadcast(edges)).withColumn("bin", prep.digitize(F.col("o_totalprice"), F.col("edges")))
    return binned.groupBy("bin").agg(F.count("*").alias("n_rows"), F.max("o_totalprice").alias("top"))


def survival_expand(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 9).cast("bigint").alias("last"), (F.col("p_partkey") % 3 == 0).alias("event"))
    return prep.survival_rows(parts, "last", "event").select("p_partkey", "t", F.col("label").cast("bigint").alias("label"))


def session_filter(spark, sf_dir):
    """Orders of 2 to 128 lines whose return flag is the same on every line."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    return prep.usable_sessions(lines, "l_orderkey", 2, 128, ["l_returnflag"])


def fill_missing(spark, sf_dir):
    events = _user_events(spark, sf_dir).select("event_id", "type_code")
    return prep.fill_below(events, events, ["type_code"])


def replicate_sample(spark, sf_dir):
    return prep.replicate(_orders_of(spark, sf_dir), "o_custkey", 0.1, 4)


def name_fields(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    return parts.select("p_partkey", prep.clean_name(F.col("p_type")).alias("clean"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("padded"),
                        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"))


def cell_fields(spark, sf_dir):
    """Parts of cell names; every ninth lacks its horizon."""
    size = F.col("p_size")
    design = F.concat(F.lit("nt"), size, F.lit("_md"), size % 7, F.when(size % 9 == 0, "").otherwise(F.concat(F.lit("_h"), size % 17)))
    cell = F.concat_ws("/", F.lower("p_brand"), design, F.lit("lightgbm"), F.lit("panel"))
    return _table(spark, sf_dir, "part").select("p_partkey", prep.cell_parts(cell).alias("parts")).select("p_partkey", "parts.*")


def option_outputs(spark, sf_dir):
    """Rows whose result is another with a switch of the plan off: none, for every switch."""
    out = None
    for k, options in enumerate(Options.ablations()):
        predictor = Predictor(models.orders_forest(), GroupingConfig(6, (2, 3, 4, 5)), models.ORDER_FEATURES)
        scored = predictor.predict_pushed(_orders(spark, sf_dir), _lines(spark, sf_dir), "l_orderkey", options)
        one = scored.agg(F.lit(options.label).alias("options"), F.count("*").alias("n"), F.sum("tree_sum").alias("total"), F.max("raw_margin").alias("top_margin"))
        out = one if out is None else out.unionByName(one)
    return out


def drop_missing(spark, sf_dir):
    return _user_events(spark, sf_dir).dropna(subset=["type_code", "k"]).groupBy("user_id").agg(F.count("*").alias("n_rows"), F.sum("k").alias("total_k"))


def nearest_rank_percentiles(spark, sf_dir):
    out = nearest_rank(_samples(spark, sf_dir), ["cell", "variant"], "ticks", [5, 50, 95, 99])
    return out.select("cell", "variant", F.col("percent").cast("bigint").alias("percent"), "ticks")


def block_nested_median(spark, sf_dir):
    return stats.nested_median(_samples(spark, sf_dir), ["cell", "variant"], "block", "ticks")


def dense_rank_over(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    ranked = samples.withColumn("rank", F.dense_rank().over(Window.partitionBy("cell", "block").orderBy("ticks")))
    return ranked.select("event_id", F.col("rank").cast("bigint").alias("rank"))


def mean_over(spark, sf_dir):
    """Ticks against the mean of the cell's block, a position profile by round."""
    mean = F.avg("ticks").over(Window.partitionBy("cell", "block"))
    profile = _samples(spark, sf_dir).withColumn("excess", F.col("ticks") - mean)
    return profile.groupBy("cell", "round").agg(F.round(F.avg("excess"), 4).alias("excess"), F.count("*").alias("n"))


def run_boundaries(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    runs = stats.run_starts(events, "user_id", ["event_id"], "event_type")
    return runs.groupBy("user_id", "run").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


def group_offsets(spark, sf_dir):
    return stats.offsets(_table(spark, sf_dir, "lineitem"), "l_orderkey")


def summary_aggregates(spark, sf_dir):
    ticks, rows = F.sum("ticks"), F.sum("n_rows")
    return _samples(spark, sf_dir).groupBy("cell").agg(
        F.count("*").alias("n"), F.count_distinct("block").alias("n_blocks"), F.min("ticks").alias("low"), F.max("ticks").alias("high"),
        F.avg("ticks").alias("mean"), F.sum(F.when(F.col("variant") == "base", F.col("ticks"))).alias("base_ticks"),
        (ticks.cast("double") / rows).alias("ticks_per_row"), F.round(F.exp(F.avg(F.log(F.col("ticks") + 1.0))), 6).alias("geometric"))


def pivot_speedup(spark, sf_dir):
    """Nested medians of the variants side by side and their ratio."""
    medians = stats.nested_median(_samples(spark, sf_dir), ["cell", "variant"], "block", "ticks")
    wide = medians.groupBy("cell").pivot("variant", ["base", "other"]).agg(F.first("ticks")).dropna()
    return wide.withColumn("speedup", F.col("base").cast("double") / F.col("other"))


def union_diagonal(spark, sf_dir):
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("nation"), "s_acctbal")
    customers = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("segment"))
    both = suppliers.unionByName(customers, allowMissingColumns=True)
    return both.groupBy("nation").agg(F.count("*").alias("n"), F.count("s_acctbal").alias("n_balances"), F.count_distinct("segment").alias("n_segments"))


def argmax_attempt(spark, sf_dir):
    best = F.max_by("event_id", F.struct("round", "event_id"))
    return _samples(spark, sf_dir).groupBy("cell", "block").agg(best.alias("event_id"))


def top_k(spark, sf_dir):
    """The five largest cell and block groups; the limit is the feature."""
    return _samples(spark, sf_dir).groupBy("cell", "block").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "cell", "block").limit(5)


def set_difference(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return orders.distinct().join(lines, "key", "left_anti")


def sentinel_drift(spark, sf_dir):
    blocks = _samples(spark, sf_dir).groupBy("cell", "block").agg(F.sum("ticks").alias("ticks"))
    return stats.drift(blocks, ["cell"], "block", "ticks")


def ablation_effect(spark, sf_dir):
    """Variant against denominator by cell: left join, so that a lacking denominator gives null."""
    totals = _samples(spark, sf_dir).groupBy("cell", "variant").agg(F.sum("ticks").alias("ticks"), F.sum("n_rows").alias("n_rows"))
    base = totals.filter("variant = 'base'").select("cell", F.col("ticks").alias("base_ticks"), F.col("n_rows").alias("base_rows"))
    joined = totals.filter("variant <> 'base'").join(base, "cell", "left")
    slow = (F.col("ticks").cast("double") / F.col("n_rows")) / (F.col("base_ticks").cast("double") / F.col("base_rows"))
    return joined.select("cell", "variant", slow.alias("slowdown"))


def first_against_later(spark, sf_dir):
    """Round 0 against later rounds of the same cell and block."""
    rounds = _samples(spark, sf_dir).groupBy("cell", "block", "round").agg(F.sum("ticks").alias("ticks"))
    first = rounds.filter("round = 0").select("cell", "block", F.col("ticks").alias("first_ticks"))
    return rounds.filter("round > 0").join(first, ["cell", "block"]).groupBy("cell").agg(
        F.sum("first_ticks").alias("first_ticks"), F.sum("ticks").alias("later_ticks"), F.count("*").alias("n"))


def precision_audit(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    exact = F.col("l_extendedprice")
    return stats.precision_audit(lines, ["l_returnflag"], exact, exact.cast("float").cast("double"), F.round(exact, 1))


def output_compare(spark, sf_dir):
    """The float32 forest against the averaged one: rows that differ, by tolerance and bitwise."""
    rows = cases.score(_order_lines(spark, sf_dir), models.single_forest(), models.ORDER_FEATURES).withColumnRenamed("tree_sum", "a").drop("raw_margin", "output")
    both = cases.score(rows, models.averaged_forest(), models.ORDER_FEATURES)
    a, b = F.col("a"), F.col("tree_sum")
    return both.agg(F.count("*").alias("n"), F.count_if(stats.mismatch(a, b)).alias("n_bits"), F.count_if(stats.mismatch(a, b, 2.0)).alias("n_beyond"))


def stratified_sizes(spark, sf_dir):
    sizes = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return stats.stratified_sample(sizes, "l_orderkey", "n", 20, 2)


def _order_sizes(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def systematic_sample(spark, sf_dir):
    """Orders timed when a sample may hold 5,000 rows: one fraction for all, quotas by size."""
    groups, _ = schedule.systematic_sample(_order_sizes(spark, sf_dir), "l_orderkey", "n", 5000, 50, 3)
    return groups


def sample_design(spark, sf_dir):
    _, strata = schedule.systematic_sample(_order_sizes(spark, sf_dir), "l_orderkey", "n", 5000, 50, 3)
    return strata.withColumn("fraction", F.round("fraction", 12))


def design_faults(spark, sf_dir):
    """A record that takes one group of a stratum too many, against the groups."""
    groups, strata = schedule.systematic_sample(_order_sizes(spark, sf_dir), "l_orderkey", "n", 5000, 50, 3)
    return schedule.design_faults(groups, "n", strata.withColumn("sampled", F.col("sampled") + (F.col("stratum") == 1).cast("bigint")))


def method_schedule(spark, sf_dir):
    """Four rounds of three methods over the regions as groups."""
    n = _table(spark, sf_dir, "region").count()
    return schedule.Schedule.of(n, 3, 2, schedule.name_seed(7, "cell")).phases(spark, ["a", "b", "c"], 4)


def crossed_bootstrap(spark, sf_dir):
    out = estimates.crossed_ratio(_samples(spark, sf_dir), ["cell"], "block", "round", F.col("ticks"), F.col("n_rows"), 40, 11)
    return out.select("cell", *(F.round(c, 9).alias(c) for c in ("ratio", "low", "high")))


def nested_median_bootstrap(spark, sf_dir):
    """Latency of variants against the base one; blocks belong to rounds, entities are crossed with them."""
    samples = _samples(spark, sf_dir).withColumns({"entity": F.col("event_id") % 11, "round": F.col("block") % 4})
    out = estimates.nested_median_ratios(samples, "cell", "variant", "block", "entity", "round", "ticks", "base", 30, 5)
    return out.select("cell", "variant", "latency", *(F.round(c, 9).alias(c) for c in ("ratio", "low", "high")))


def wide_intervals(spark, sf_dir):
    """Cells with blocks whose ratio is known to 5 percent at worst, and the widest of them."""
    found = estimates.crossed_ratio(_samples(spark, sf_dir), ["cell", "variant"], "block", "round", F.col("ticks"), F.col("n_rows"), 40, 11)
    out = estimates.wide_intervals(found, ["cell"], 5.0)
    return out.select("cell", "variant", F.round("half_percent", 6).alias("half_percent"), "n_wide")


def work_terms(spark, sf_dir):
    """Counters of blocks in five versions, in common terms; ticks and rows stand in for the counters."""
    t, n = F.col("ticks"), F.col("n_rows")
    counted = _samples(spark, sf_dir).groupBy("cell", "block").agg(F.sum(t).alias("walk_steps"), F.sum(n).alias("prefix_steps"), F.count("*").alias("leaf_events"), F.max(n).alias("varying_events"), F.min(n).alias("splits"))
    versions = counted.withColumns({"version": F.col("block") + 2, "single_rows": F.col("splits"), "trees": F.lit(12), "constant_steps": F.col("walk_steps"), "varying_splits": F.col("varying_events"), "leaf_hits": F.col("leaf_events"), "unsplit_skips": F.col("splits")})
    return versions.select("cell", "block", *(c.cast("bigint").alias(k) for k, c in estimates.work_terms().items()))


def work_per_row(spark, sf_dir):
    """Steps of the masked walk of events by user, as a share of the full walk's."""
    forest = models.events_forest()
    events = _user_events(spark, sf_dir)
    steps = work_counters(spark, sf_dir).agg(F.sum("constant_events").alias("constant"), F.sum("varying_events").alias("varying"))
    size = events.agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("groups"))
    n = sum(p[0] not in models.EVENT_CONSTANT for p in forest.predicates)
    share = estimates.work_per_row(F.col("constant"), F.col("varying"), F.col("rows") * n, F.col("rows"), F.col("groups"), len(forest.trees), forest.depth)
    return steps.join(size).select(F.round(share, 9).alias("share"))


def two_mode_split(spark, sf_dir):
    return stats.two_modes(_samples(spark, sf_dir), ["cell"], "ticks")


def retime_flags(spark, sf_dir):
    """Cells and blocks whose spread is over half their mean, the widest block first of each cell."""
    spread = _samples(spark, sf_dir).groupBy("cell", "block").agg(((F.max("ticks") - F.min("ticks")).cast("double") / F.avg("ticks")).alias("spread"))
    wide = spread.filter("spread > 0.5")
    return wide.groupBy("cell").agg(F.count("*").alias("n_flagged"), F.max_by("block", F.struct("spread", "block")).alias("widest_block"))


def validity_gates(spark, sf_dir):
    """Cells that break a rule of a run: too few blocks, values below zero, repeated samples."""
    per_cell = _samples(spark, sf_dir).groupBy("cell").agg(
        F.count_distinct("block").alias("blocks"), F.count_if(F.col("ticks") < 0).alias("negative"), (F.count("*") - F.count_distinct("event_id")).alias("repeated"))
    return per_cell.select("cell", (F.col("blocks") < 8).alias("few_blocks"), (F.col("negative") > 0).alias("has_negative"), (F.col("repeated") > 0).alias("has_repeated"))


def numeric_bins(spark, sf_dir):
    """Number of the forest's thresholds of a feature below each value."""
    thresholds = sorted({p[2] for p in models.orders_forest().predicates if p[0] == 2})
    binned = _table(spark, sf_dir, "lineitem").withColumn("bin", prep.threshold_bin(F.col("l_quantity"), thresholds))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"))


def batch_packing(spark, sf_dir):
    sizes = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    sharded = sizes.withColumn("shard", F.col("l_orderkey") % 16)
    return stats.pack_batches(sharded, "shard", "l_orderkey", "n", 64)


def bootstrap_ratio(spark, sf_dir):
    out = estimates.clustered_ratio(_samples(spark, sf_dir), ["cell"], "block", F.col("ticks"), F.col("n_rows"), 200, 1)
    return out.select("cell", *(F.round(c, 9).alias(c) for c in ("ratio", "low", "high")))


ALL = (
    forest_score_orders, forest_stages, forest_pushdown, forest_walker, panel_walker, panel_grouped, forest_average, forest_float32, forest_frontier,
    categorical_splits, predict_group, predict_fixed, predicate_masks, work_counters, constant_violations, monotone_violations,
    node_catalog, tree_catalog, feature_ranges, tree_order, prefix_groups, walk_shares, model_stats, systematic_sample, sample_design,
    design_faults, round_faults, method_schedule, crossed_bootstrap, nested_median_bootstrap, wide_intervals, work_terms, work_per_row, panel_expand, session_shuffle, cohort_first_n, whatif_variants, whatif_donors, whatif_grid,
    row_groups, zero_fraction, draw_entities, category_encode, entity_split, digitize_bins, survival_expand, session_filter,
    fill_missing, replicate_sample, name_fields, cell_fields, option_outputs, drop_missing, nearest_rank_percentiles, block_nested_median, dense_rank_over,
    mean_over, run_boundaries, group_offsets, summary_aggregates, pivot_speedup, union_diagonal, argmax_attempt, top_k,
    set_difference, sentinel_drift, ablation_effect, first_against_later, precision_audit, output_compare, stratified_sizes,
    two_mode_split, retime_flags, validity_gates, numeric_bins, batch_packing, bootstrap_ratio,
)


def queries():
    return {f.__name__: f for f in ALL}
