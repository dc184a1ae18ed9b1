"""DuckDB twins of the queries. Forests are walked by a recursive query over their node tables, not by CASE text."""

from __future__ import annotations

import math

from . import models
from .model import Forest
from .operators.schedule import SplitMix
from .plans.options import Options


def _number(x: float) -> str:
    return f"'{x}'::DOUBLE" if math.isinf(x) else f"{x!r}::DOUBLE"


def _nodes(forest: Forest) -> str:
    rows = []
    for t, tree in enumerate(forest.trees):
        for j, n in enumerate(tree):
            if n.op is None:
                rows.append(f"({t}, {j}, NULL, 0, NULL::DOUBLE, NULL::BIGINT[], false, 0, 0, {_number(n.value)}, {n.weight!r}::DOUBLE, NULL)")
            else:
                threshold = "NULL::DOUBLE" if n.op == "in" else _number(n.threshold)
                rows.append(f"({t}, {j}, '{n.op}', {n.feature}, {threshold}, {list(n.categories)}::BIGINT[], {str(n.default_left).lower()}, "
                            f"{n.left}, {n.right}, NULL::DOUBLE, {n.weight!r}::DOUBLE, {forest.predicate_ids[n.predicate]})")
    return "nodes(tree, node, op, feature, threshold, cats, dflt, lft, rgt, leaf, weight, predicate) AS (VALUES " + ",\n".join(rows) + ")"


def _left(single: bool, x: str = "w.x[n.feature + 1]") -> str:
    number = f"CAST({x} AS FLOAT)" if single else x
    threshold = "CAST(n.threshold AS FLOAT)" if single else "n.threshold"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN n.dflt "
            f"WHEN n.op = 'in' THEN CASE WHEN {number} >= 0 AND {number} < 4294967296 THEN list_contains(n.cats, CAST(floor({number}) AS BIGINT)) ELSE false END "
            f"WHEN n.op = '<' THEN {number} < {threshold} ELSE {number} <= {threshold} END")


def scored(forest: Forest, rows: str, features: list[str]) -> str:
    """CTEs up to scored(rows' columns, tree_sum, raw_margin, output)."""
    margin = f"tree_sum / {forest.divisor!r}::DOUBLE + {forest.base_score!r}::DOUBLE"
    output = margin if forest.link == "identity" else f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({forest.alpha!r}::DOUBLE * ({margin}))))"
    return f"""
WITH RECURSIVE {_nodes(forest)},
rws AS MATERIALIZED (SELECT row_number() OVER () AS rid, [{', '.join(f + '::DOUBLE' for f in features)}] AS x, * FROM ({rows})),
walk(rid, x, tree, node, fin) AS (
  SELECT rid, x, t.tree, 0, false FROM rws, (SELECT DISTINCT tree FROM nodes) t
  UNION ALL
  SELECT w.rid, w.x, w.tree, CASE WHEN n.op IS NULL THEN n.node WHEN {_left(forest.single)} THEN n.lft ELSE n.rgt END, n.op IS NULL
  FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE NOT w.fin),
sums AS (SELECT rid, sum(n.leaf) AS tree_sum FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE w.fin GROUP BY rid),
scored AS (SELECT r.*, tree_sum, {margin} AS raw_margin, {output} AS output FROM rws r JOIN sums USING (rid))
"""


ORDERS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
CASE WHEN l_tax <= 0.075 THEN l_tax END AS l_tax, o_totalprice, substr(o_orderpriority, 1, 1)::DOUBLE AS priority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

EVENTS = """SELECT event_id, user_id, value, CASE event_type WHEN 'click' THEN 0.0 WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 2.0
WHEN 'view' THEN 3.0 END::DOUBLE AS type_code, nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '')::DOUBLE AS k, n_events, max_value
FROM events JOIN (SELECT user_id, count(*)::DOUBLE AS n_events, max(value) AS max_value FROM events GROUP BY user_id) USING (user_id)"""

SAMPLES = """WITH samples AS (SELECT event_id, event_type AS cell, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'other' END AS variant,
user_id % 8 AS block, event_id % 5 AS round, round(value * 100)::BIGINT AS ticks,
nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '')::BIGINT + 1 AS n_rows FROM events)"""

STAGES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, tree_sum, raw_margin, round(output, 9) AS output FROM scored"
BY_EVENT = "SELECT event_id, tree_sum, raw_margin, round(output, 9) AS output FROM scored"


def _uniform(seed: int, *columns: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def _seeded(seed: int, *columns: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(columns)}))"


def _rank(value: str, p: int) -> str:
    """Nearest rank as a place in the sorted list."""
    return f"list_sort(list({value}))[CAST(floor({p} * (count({value}) - 1) / 100.0 + 0.5) AS BIGINT) + 1]"


MEDIANS = f"""medians AS (SELECT cell, variant, {_rank('m', 50)} AS ticks FROM
(SELECT cell, variant, block, {_rank('ticks', 50)} AS m FROM samples GROUP BY ALL) GROUP BY cell, variant)"""


PANEL = """SELECT c_custkey, t, c_acctbal, c_nationkey::DOUBLE AS c_nationkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0.0 WHEN 'BUILDING' THEN 1.0
WHEN 'FURNITURE' THEN 2.0 WHEN 'MACHINERY' THEN 3.0 END::DOUBLE AS segment, length(c_custkey::VARCHAR)::DOUBLE AS n_digits, (c_custkey % 1000) / 1000.0::DOUBLE AS key_share,
31 - t AS t_left, (t / 32.0::DOUBLE) * (t / 32.0::DOUBLE) AS t_frac_sq, sin(pi() * (t / 32.0::DOUBLE)) AS t_sine FROM customer, range(32) AS r(t)"""

STRATA = """sizes AS (SELECT l_orderkey, count(*) AS n, floor(log2(count(*)))::BIGINT AS stratum FROM lineitem GROUP BY 1),
pools AS (SELECT stratum, count(*) AS pool, sum(n)::BIGINT AS pool_rows FROM sizes GROUP BY 1),
shares AS (SELECT *, CASE WHEN sum(pool_rows) OVER () <= 5000 THEN 1.0::DOUBLE ELSE least(greatest(5000.0::DOUBLE / sum(pool_rows) OVER (), 50.0::DOUBLE / sum(pool) OVER ()), 1.0::DOUBLE) END AS fraction,
  (sum(pool) OVER (ORDER BY stratum))::BIGINT AS upto FROM pools),
strata AS (SELECT stratum, pool, pool_rows, fraction, least(floor(upto * fraction + {u}) - floor((upto - pool) * fraction + {u}), pool)::BIGINT AS sampled FROM shares),
timed AS (SELECT l_orderkey, n, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {order}, l_orderkey) <= sampled AS timed FROM sizes JOIN strata USING (stratum))"""


def _draws(name: str, n: str, seed: int, draws: int) -> str:
    """CTE of weights: a row for each distinct n, draw and unit drawn."""
    return (f"{name} AS (SELECT n, draw, floor({_uniform(seed, 'n', 'draw', 'pick')} * n)::BIGINT AS unit, count(*) AS weight "
            f"FROM (SELECT DISTINCT {n} AS n FROM placed), range({draws}) AS a(draw), LATERAL (SELECT unnest(range(n)) AS pick) GROUP BY ALL)")


def _crossed(cells: str) -> str:
    using = ", ".join(f"{c}" for c in cells.split(", "))
    return f"""{SAMPLES}, totals AS (SELECT {cells}, block, round, sum(ticks)::DOUBLE AS a, sum(n_rows)::DOUBLE AS b FROM samples GROUP BY ALL),
e AS (SELECT {cells}, block, row_number() OVER (PARTITION BY {cells} ORDER BY block) - 1 AS e, count(*) OVER (PARTITION BY {cells}) AS n_e FROM (SELECT DISTINCT {cells}, block FROM samples)),
r AS (SELECT {cells}, round, row_number() OVER (PARTITION BY {cells} ORDER BY round) - 1 AS r, count(*) OVER (PARTITION BY {cells}) AS n_r FROM (SELECT DISTINCT {cells}, round FROM samples)),
placed AS (SELECT * FROM totals JOIN e USING ({using}, block) JOIN r USING ({using}, round)),
{_draws('we', 'n_e', 11, 40)}, {_draws('wr', 'n_r', 12, 40)},
drawn AS (SELECT {cells}, we.draw, sum(a * we.weight * wr.weight) / sum(b * we.weight * wr.weight) AS ratio FROM placed JOIN we ON we.n = n_e AND we.unit = e
  JOIN wr ON wr.n = n_r AND wr.unit = r AND wr.draw = we.draw GROUP BY ALL),
whole AS (SELECT {cells}, sum(ticks)::DOUBLE / sum(n_rows)::DOUBLE AS ratio FROM samples GROUP BY ALL),
found AS (SELECT {cells}, whole.ratio, low, high FROM whole JOIN (SELECT {cells}, quantile_cont(ratio, 0.025) AS low, quantile_cont(ratio, 0.975) AS high FROM drawn GROUP BY ALL) USING ({using}))"""


def _weighed(source: str, keys: str, value: str, weight: str, name: str) -> str:
    """The value at place total // 2 of values repeated by weight."""
    return (f"SELECT {keys}, min({value}) AS {name} FROM (SELECT {keys}, {value}, sum({weight}) OVER (PARTITION BY {keys} ORDER BY {value}) AS upto, "
            f"sum({weight}) OVER (PARTITION BY {keys}) // 2 AS half FROM {source}) WHERE upto > half GROUP BY {keys}")


def _nested() -> str:
    return f"""{SAMPLES}, s AS (SELECT cell, variant, block, event_id % 11 AS entity, block % 4 AS rnd, ticks FROM samples),
e AS (SELECT cell, entity, row_number() OVER (PARTITION BY cell ORDER BY entity) - 1 AS e, count(*) OVER (PARTITION BY cell) AS n_e FROM (SELECT DISTINCT cell, entity FROM s)),
r AS (SELECT cell, rnd, row_number() OVER (PARTITION BY cell ORDER BY rnd) - 1 AS r, count(*) OVER (PARTITION BY cell) AS n_r FROM (SELECT DISTINCT cell, rnd FROM s)),
placed AS (SELECT * FROM s JOIN e USING (cell, entity) JOIN r USING (cell, rnd)),
{_draws('we', 'n_e', 5, 30)}, {_draws('wr', 'n_r', 6, 30)},
ones AS (SELECT *, 1 AS w FROM s), m1 AS (SELECT *, 1 AS w FROM ({_weighed('ones', 'cell, variant, block', 'ticks', 'w', 'm')})), once AS ({_weighed('m1', 'cell, variant', 'm', 'w', 'latency')}),
d1 AS (SELECT placed.*, we.draw, we.weight AS w FROM placed JOIN we ON we.n = n_e AND we.unit = e),
d2 AS ({_weighed('d1', 'cell, variant, block, n_r, r, draw', 'ticks', 'w', 'm')}),
d3 AS (SELECT d2.*, wr.weight AS w FROM d2 JOIN wr ON wr.n = n_r AND wr.unit = r AND wr.draw = d2.draw),
d4 AS ({_weighed('d3', 'cell, variant, draw', 'm', 'w', 'latency')}),
ratios AS (SELECT d4.cell, d4.variant, d4.latency::DOUBLE / b.latency AS ratio FROM d4 JOIN d4 b ON b.cell = d4.cell AND b.draw = d4.draw AND b.variant = 'base')
SELECT cell, variant, latency, round(ratio, 9) AS ratio, round(low, 9) AS low, round(high, 9) AS high
FROM (SELECT o.cell, o.variant, o.latency, o.latency::DOUBLE / b.latency AS ratio FROM once o JOIN once b ON b.cell = o.cell AND b.variant = 'base')
LEFT JOIN (SELECT cell, variant, quantile_cont(ratio, 0.025) AS low, quantile_cont(ratio, 0.975) AS high FROM ratios GROUP BY ALL) USING (cell, variant)"""


def _masses(forest: Forest, varying: set[int], split: bool, name: str) -> str:
    """CTE of the mass of every node, by recursion over paths."""
    both = f"(n.feature IN ({', '.join(map(str, sorted(varying)))}) AND {str(split).lower()})"
    share = "CASE WHEN l.weight + r.weight > 0 THEN l.weight / (l.weight + r.weight) ELSE 0.5::DOUBLE END"
    return f"""{name}(tree, node, mass) AS (
  SELECT DISTINCT tree, 0, 1.0::DOUBLE FROM nodes
  UNION ALL
  SELECT m.tree, side.child, CASE WHEN {both} THEN m.mass WHEN side.child = n.lft THEN m.mass * {share} ELSE m.mass * (1 - {share}) END
  FROM {name} m JOIN nodes n ON n.tree = m.tree AND n.node = m.node AND n.op IS NOT NULL JOIN nodes l ON l.tree = n.tree AND l.node = n.lft JOIN nodes r ON r.tree = n.tree AND r.node = n.rgt,
  LATERAL (SELECT unnest([n.lft, n.rgt]) AS child) side)"""


def _paths(forest: Forest) -> str:
    """CTE of heavy paths: predicates (and features) of each tree, in order."""
    return f"""{_nodes(forest)},
steps(tree, node, level) AS (
  SELECT DISTINCT tree, 0, 0 FROM nodes
  UNION ALL
  SELECT s.tree, CASE WHEN l.weight >= r.weight THEN n.lft ELSE n.rgt END, s.level + 1 FROM steps s JOIN nodes n ON n.tree = s.tree AND n.node = s.node AND n.op IS NOT NULL
  JOIN nodes l ON l.tree = n.tree AND l.node = n.lft JOIN nodes r ON r.tree = n.tree AND r.node = n.rgt),
paths AS (SELECT tree, coalesce(list(predicate ORDER BY level) FILTER (WHERE op IS NOT NULL), []) AS path, coalesce(list(feature ORDER BY level) FILTER (WHERE op IS NOT NULL), []) AS features
  FROM steps JOIN nodes USING (tree, node) GROUP BY tree)"""


def oracle_sql() -> dict[str, str]:
    varying = set(range(6)) - models.ORDER_CONSTANT
    strata = "WITH " + STRATA.format(u=repr(SplitMix(3).unit()) + "::DOUBLE", order=_seeded(3, "l_orderkey"))
    in_varying = f"feature IN ({', '.join(map(str, sorted(varying)))})"
    masses = f"WITH RECURSIVE {_nodes(models.orders_forest())}, {_masses(models.orders_forest(), varying, False, 'never')}, {_masses(models.orders_forest(), varying, True, 'always')}"
    orders = scored(models.orders_forest(), ORDERS, models.ORDER_FEATURES)
    events = scored(models.events_forest(), EVENTS, models.EVENT_FEATURES)
    forest, single, averaged = models.events_forest(), models.single_forest(), models.averaged_forest()
    catalog = f"WITH {_nodes(models.orders_forest())} "
    edges = ", ".join(f"quantile_cont(o_totalprice, {k / 8})" for k in range(1, 8))
    places = sorted({p[2] for p in models.orders_forest().predicates if p[0] == 2})
    walked = f"""{events.rsplit("sums AS", 1)[0]}
placed AS (SELECT rid, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 63 AS word FROM rws),
steps AS (SELECT row_number() OVER () AS k, w.* FROM walk w)"""
    twins = {
        "forest_score_orders": orders + "SELECT l_orderkey, count(*) AS n_rows, sum(tree_sum) AS total, max(raw_margin) AS top_margin, round(max(output), 9) AS top_output FROM scored GROUP BY 1",
        "forest_stages": orders + STAGES,
        "forest_pushdown": orders + STAGES,
        "forest_walker": scored(models.large_forest(), ORDERS, models.ORDER_FEATURES) + STAGES,
        "panel_walker": scored(models.panel_forest(), PANEL, models.PANEL_FEATURES) + "SELECT c_custkey, t, tree_sum, raw_margin FROM scored",
        "panel_grouped": scored(models.panel_forest(), PANEL, models.PANEL_FEATURES) + "SELECT c_custkey, t, tree_sum, raw_margin FROM scored",
        "forest_average": scored(averaged, ORDERS, models.ORDER_FEATURES) + STAGES,
        "forest_float32": scored(single, ORDERS, models.ORDER_FEATURES) + STAGES,
        "forest_frontier": events + BY_EVENT,
        "categorical_splits": events + BY_EVENT,
        "predict_group": events + "SELECT event_id, tree_sum FROM scored WHERE user_id = 8",
        "predict_fixed": events + ", numbered AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS group_id FROM scored) SELECT user_id, group_id, count(*) AS n_rows, sum(tree_sum) AS total FROM numbered GROUP BY 1, 2",
        "predicate_masks": f"""WITH {_nodes(forest)}, preds AS (SELECT predicate, any_value(op) AS op, any_value(feature) AS feature, any_value(threshold) AS threshold,
any_value(cats) AS cats, any_value(dflt) AS dflt FROM nodes WHERE op IS NOT NULL GROUP BY predicate),
placed AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, [{', '.join(f + '::DOUBLE' for f in models.EVENT_FEATURES)}] AS x FROM ({EVENTS}))
SELECT user_id, place // 63 AS word, predicate::BIGINT AS predicate, sum(CASE WHEN {_left(False)} THEN 1::BIGINT << (place % 63) ELSE 0::BIGINT END)::BIGINT AS mask
FROM placed w, preds n GROUP BY 1, 2, 3""",
        "work_counters": walked.replace("walk(rid, x, tree, node, fin)", "walk(rid, x, tree, node, fin, level)").replace(
            "SELECT rid, x, t.tree, 0, false FROM", "SELECT rid, x, t.tree, 0, false, 0 FROM").replace(
            ", n.op IS NULL\n  FROM walk", ", n.op IS NULL, w.level + 1\n  FROM walk") + """
SELECT level::BIGINT AS level, count(*) FILTER (WHERE op IS NOT NULL AND feature < 2) AS constant_events, count(*) FILTER (WHERE op IS NOT NULL AND feature >= 2) AS varying_events,
count(*) FILTER (WHERE op IS NULL) AS leaf_events, coalesce(sum(n) FILTER (WHERE op IS NULL), 0)::BIGINT AS leaf_rows
FROM (SELECT level, user_id, word, tree, node, count(*) AS n FROM steps JOIN placed USING (rid) WHERE NOT fin GROUP BY ALL) s
JOIN nodes USING (tree, node) GROUP BY level""",
        "constant_violations": " UNION ALL ".join(f"SELECT l_orderkey, '{c}' AS feature FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 1" for c in ("l_discount", "l_tax")),
        "monotone_violations": f"""WITH e AS ({EVENTS}), p AS (SELECT *, lag(type_code) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e WHERE type_code IS NOT NULL)
SELECT user_id, coalesce(any_value(bad), 0)::BIGINT AS n_violations, count(*) FILTER (WHERE type_code IS NULL) AS n_missing
FROM e LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE type_code < before) AS bad FROM p GROUP BY 1) USING (user_id) GROUP BY 1""",
        "node_catalog": catalog + "SELECT tree, feature, count(*) AS n_splits, count(DISTINCT predicate) AS n_predicates FROM nodes WHERE op IS NOT NULL GROUP BY 1, 2",
        "tree_catalog": f"WITH {_nodes(models.events_forest())} SELECT tree, n_nodes, n_leaves, n_categories, (sum(n_nodes) OVER (ORDER BY tree) - n_nodes)::BIGINT AS node_start FROM (SELECT tree, count(*) AS n_nodes, count(*) FILTER (WHERE op IS NULL) AS n_leaves, coalesce(sum(len(cats)) FILTER (WHERE op = 'in'), 0)::BIGINT AS n_categories FROM nodes GROUP BY 1)",
        "feature_ranges": f"WITH {_nodes(models.events_forest())} SELECT feature, op = 'in' AS categorical, min(predicate)::BIGINT AS first, max(predicate)::BIGINT AS last, count(DISTINCT predicate) AS n_predicates, count(*) AS n_splits FROM nodes WHERE op IS NOT NULL GROUP BY ALL",
        "tree_order": f"WITH RECURSIVE {_paths(models.large_forest())} SELECT row_number() OVER (ORDER BY path, tree) - 1 AS place, tree::BIGINT AS tree, len(path)::BIGINT AS n_splits FROM paths",
        "prefix_groups": f"""WITH RECURSIVE {_paths(models.large_forest())},
lead AS (SELECT tree, path, coalesce(list_position(list_transform(features, lambda f: f IN (0, 1)), false), len(path) + 1) - 1 AS upto FROM paths),
cut AS (SELECT path[1] AS predicate, path[:upto] AS path FROM lead WHERE upto > 0),
ends AS (SELECT predicate, count(*) AS n_trees, min(len(path)) AS short, list(path) AS all_paths FROM cut GROUP BY 1),
depths AS (SELECT predicate, n_trees, len(list_filter(range(1, short + 1), lambda k: len(list_distinct(list_transform(all_paths, lambda p: p[:k]))) = 1)) AS depth FROM ends)
SELECT predicate::BIGINT AS predicate, n_trees, depth::BIGINT AS depth, ((n_trees - 1) * depth)::BIGINT AS saved_steps FROM depths""",
        "walk_shares": masses + "".join(
            f"{' UNION ALL' if k else ''} SELECT '{name}_split' AS mode, round(sum(mass) FILTER (WHERE {in_varying}) / sum(mass), 9) AS phi, round(sum(mass) FILTER (WHERE op IS NULL) / sum(mass), 9) AS lambda, round(sum(mass) FILTER (WHERE op IS NULL OR {in_varying}) / sum(mass), 9) AS events_per_step FROM {name} JOIN nodes USING (tree, node)"
            for k, name in enumerate(("never", "always"))).replace("feature IN", "op IS NOT NULL AND feature IN"),
        "model_stats": masses + f""" SELECT (SELECT count(DISTINCT tree) FROM nodes) AS n_trees, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE op IS NULL) AS n_leaves,
(SELECT count(DISTINCT predicate) FROM nodes) AS n_predicates, (SELECT round(avg(CASE WHEN {in_varying} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) FROM nodes WHERE op IS NOT NULL) AS varying_share,
(SELECT round(sum(mass) / 12, 9) FROM never JOIN nodes USING (tree, node) WHERE op IS NOT NULL) AS steps_leaf""",
        "systematic_sample": strata + " SELECT l_orderkey, n, stratum, timed FROM timed",
        "sample_design": strata + " SELECT stratum, pool, pool_rows, round(fraction, 12) AS fraction, sampled FROM strata",
        "design_faults": strata + ", rec AS (SELECT stratum, pool, fraction, sampled + CASE WHEN stratum = 1 THEN 1 ELSE 0 END AS sampled FROM strata), seen AS (SELECT stratum, count(*) AS pool2, count(*) FILTER (WHERE timed) AS sampled2 FROM timed GROUP BY 1) "
        "SELECT stratum, pool <> pool2 OR sampled <> sampled2 AS counts, abs(sum(sampled) OVER (ORDER BY stratum) - sum(pool * fraction) OVER (ORDER BY stratum)) >= 1 + 1e-9 AS drift FROM rec JOIN seen USING (stratum)",
        "crossed_bootstrap": _crossed("cell") + " SELECT cell, round(ratio, 9) AS ratio, round(low, 9) AS low, round(high, 9) AS high FROM found",
        "wide_intervals": _crossed("cell, variant") + ", halves AS (SELECT cell, variant, 100 * (high - low) / 2 / ratio AS half FROM found) SELECT cell, (list(variant ORDER BY half DESC, variant DESC))[1] AS variant, round(max(half), 6) AS half_percent, count(*) AS n_wide FROM halves WHERE half > 5.0 GROUP BY 1",
        "nested_median_bootstrap": _nested(),
        "work_terms": SAMPLES + """, c AS (SELECT cell, block, sum(ticks) AS t, sum(n_rows) AS n, count(*) AS k, max(n_rows) AS hi, min(n_rows) AS lo, block + 2 AS v FROM samples GROUP BY ALL),
d AS (SELECT *, k + CASE WHEN v = 3 THEN lo * 12 ELSE 0 END AS leaves FROM c)
SELECT cell, block, (CASE WHEN v = 2 THEN t WHEN v <= 7 THEN t + n - hi - leaves END)::BIGINT AS constant_steps, (CASE WHEN v <= 7 THEN hi END)::BIGINT AS varying_splits,
(CASE WHEN v = 2 THEN k WHEN v <= 7 THEN leaves END)::BIGINT AS leaf_hits, (CASE WHEN v = 2 THEN lo WHEN v <= 7 THEN hi - lo END)::BIGINT AS unsplit_skips FROM d""",
        "panel_expand": "SELECT c_custkey, t, (t / 12.0::DOUBLE) * (t / 12.0::DOUBLE) AS t_frac_sq, 11 - t AS t_left, round(c_acctbal * (t / 12.0::DOUBLE), 6) AS base_frac, round(sin(pi() * (t / 12.0::DOUBLE)), 9) AS t_sine FROM customer, range(12) AS r(t)",
        "session_shuffle": f"SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_seeded(5, 'o_orderkey')}, o_orderkey) - 1 AS place FROM orders",
        "cohort_first_n": f"SELECT o_custkey, o_orderkey, width::BIGINT AS width, place FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY {_seeded(5, 'o_orderkey')}, o_orderkey) - 1 AS place FROM orders), (VALUES (2), (4), (8)) AS w(width) WHERE n >= 8 AND place < width",
        "whatif_variants": f"SELECT c_custkey, variant, round(CASE WHEN variant = 0 THEN c_acctbal ELSE c_acctbal * pow(2.0::DOUBLE, {_uniform(3, 'c_custkey', 'variant')} * 2 - 1) END, 4) AS c_acctbal FROM customer, range(8) AS r(variant)",
        "whatif_donors": f"""WITH pool AS (SELECT row_number() OVER (ORDER BY {_seeded(9, 's_suppkey')}, s_suppkey) - 1 AS place, s_acctbal FROM supplier)
SELECT c_custkey, variant, CASE WHEN variant = 0 THEN c_acctbal ELSE s_acctbal END AS c_acctbal FROM (SELECT c_custkey, c_acctbal, variant, floor({_uniform(10, 'c_custkey', 'variant')} * 8)::BIGINT AS place FROM customer, range(4) AS r(variant)) JOIN pool USING (place)""",
        "whatif_grid": """WITH s AS (SELECT list_sort(list(c_acctbal)) AS a, list_sort(list(c_nationkey)) AS n, count(*) AS c FROM customer)
SELECT s_suppkey, a[ceil((j + 0.5) / 3 * c)::BIGINT]::DOUBLE AS c_acctbal, n[ceil((i + 0.5) / 4 * c)::BIGINT]::DOUBLE AS c_nationkey FROM supplier, s, range(4) AS x(i), range(3) AS y(j)""",
        "batch_packing": """WITH RECURSIVE sizes AS (SELECT l_orderkey % 16 AS shard, l_orderkey, count(*) AS n, row_number() OVER (PARTITION BY l_orderkey % 16 ORDER BY l_orderkey) AS k FROM lineitem GROUP BY 1, 2),
fold(shard, k, l_orderkey, n, batch, used) AS (SELECT shard, k, l_orderkey, n, 0::BIGINT, n FROM sizes WHERE k = 1
  UNION ALL SELECT s.shard, s.k, s.l_orderkey, s.n, CASE WHEN f.used + s.n > 64 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + s.n > 64 THEN s.n ELSE f.used + s.n END
  FROM fold f JOIN sizes s ON s.shard = f.shard AND s.k = f.k + 1)
SELECT shard, l_orderkey, n, batch FROM fold""",
        "bootstrap_ratio": f"""{SAMPLES}, totals AS (SELECT cell, block, sum(ticks)::DOUBLE AS a, sum(n_rows)::DOUBLE AS b FROM samples GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY block) - 1 AS e, count(*) OVER (PARTITION BY cell) AS n_e FROM totals), {_draws('we', 'n_e', 1, 200)},
drawn AS (SELECT cell, draw, sum(a * weight) / sum(b * weight) AS ratio FROM placed JOIN we ON we.n = n_e AND unit = e GROUP BY ALL)
SELECT cell, round(sum(a) / sum(b), 9) AS ratio, any_value(low) AS low, any_value(high) AS high FROM totals
JOIN (SELECT cell, round(quantile_cont(ratio, 0.025), 9) AS low, round(quantile_cont(ratio, 0.975), 9) AS high FROM drawn GROUP BY 1) USING (cell) GROUP BY cell""",
        "round_faults": """WITH g AS (SELECT l_orderkey AS k, count(*) AS n, l_orderkey % 2 = 0 AS timed FROM lineitem GROUP BY 1),
s AS (SELECT method, repetition, k, n, timed, n + CASE WHEN k % 90 = 4 THEN 1 ELSE 0 END AS seen FROM g, range(2) AS r(repetition), (VALUES ('a'), ('b')) AS m(method),
  LATERAL (SELECT unnest(range(CASE WHEN method = 'b' THEN 1 WHEN k % 50 = 8 THEN 0 WHEN k % 60 = 10 THEN 2 WHEN k % 2 = 1 AND k % 70 <> 1 THEN 0 ELSE 1 END))) WHERE timed OR method = 'a')
SELECT 'cell' AS cell, method, repetition, (SELECT count(*) FROM g WHERE timed) - count(DISTINCT k) FILTER (WHERE timed) AS lacking, count(*) - count(DISTINCT k) AS repeated,
count(*) FILTER (WHERE NOT timed) AS untimed, count(*) FILTER (WHERE n <> seen) AS wrong_rows FROM s GROUP BY method, repetition""",
        "row_groups": events + "SELECT event_id AS group_id, count(*) AS n_rows, sum(tree_sum) AS total FROM scored GROUP BY 1",
        "zero_fraction": "SELECT count(*) AS n_groups, avg(CASE WHEN l_discount = 0 OR l_tax = 0 THEN 1 ELSE 0 END) AS zero_fraction FROM lineitem",
        "draw_entities": f"SELECT c_custkey, c_name FROM customer ORDER BY {_seeded(21, 'c_custkey')}, c_custkey LIMIT 25",
        "category_encode": "SELECT c_custkey, code FROM customer LEFT JOIN (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS code FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey <> 7)) USING (c_nationkey)",
        "entity_split": f"SELECT {_uniform(1, 'o_custkey')} < 0.2 AS is_test, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities FROM orders GROUP BY 1",
        "digitize_bins": f"WITH e AS (SELECT list_distinct([{edges}]) AS edges FROM orders) SELECT least(len(list_filter(edges, lambda e: e <= o_totalprice)), len(edges))::BIGINT AS bin, count(*) AS n_rows, max(o_totalprice) AS top FROM orders, e GROUP BY 1",
        "survival_expand": "SELECT p_partkey, unnest(range(p_size % 9 + 1)) AS t, CASE WHEN t = p_size % 9 AND p_partkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS label FROM part",
        "session_filter": "SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 128 AND count(DISTINCT l_returnflag) <= 1)",
        "fill_missing": f"WITH e AS ({EVENTS}) SELECT event_id, coalesce(type_code, (SELECT min(type_code) - 1 FROM e)) AS type_code FROM e",
        "replicate_sample": f"SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY {_seeded(4, 'o_custkey')}, o_custkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE r <= floor(n * 0.1::DOUBLE + 0.5))",
        "name_fields": "SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9_]+', '_', 'g') AS clean, lpad(p_size::VARCHAR, 3, '0') AS padded, regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part",
        "cell_fields": r"""SELECT p_partkey, nullif(regexp_extract(c, '^([^/]+)/', 1), '') AS dataset, nullif(regexp_extract(c, '/nt([0-9]+)', 1), '')::BIGINT AS n_trees, nullif(regexp_extract(c, '_md([0-9]+)', 1), '')::BIGINT AS depth,
nullif(regexp_extract(c, '_h([0-9]+)', 1), '')::BIGINT AS horizon, 'lightgbm' AS framework, 'panel' AS workload
FROM (SELECT p_partkey, lower(p_brand) || '/nt' || p_size || '_md' || (p_size % 7) || CASE WHEN p_size % 9 = 0 THEN '' ELSE '_h' || (p_size % 17) END || '/lightgbm/panel' AS c FROM part)""",
        "option_outputs": orders + "SELECT options, count(*) AS n, sum(tree_sum) AS total, max(raw_margin) AS top_margin FROM scored, (VALUES " + ", ".join(f"('{o.label}')" for o in Options.ablations()) + ") AS o(options) GROUP BY 1",
        "drop_missing": f"SELECT user_id, count(*) AS n_rows, sum(k) AS total_k FROM ({EVENTS}) WHERE type_code IS NOT NULL AND k IS NOT NULL GROUP BY 1",
        "nearest_rank_percentiles": SAMPLES + " UNION ALL ".join(f" SELECT cell, variant, {p}::BIGINT AS percent, {_rank('ticks', p)} AS ticks FROM samples GROUP BY cell, variant" for p in (5, 50, 95, 99)),
        "block_nested_median": f"{SAMPLES}, {MEDIANS} SELECT * FROM medians",
        "dense_rank_over": SAMPLES + " SELECT event_id, dense_rank() OVER (PARTITION BY cell, block ORDER BY ticks) AS rank FROM samples",
        "mean_over": SAMPLES + " SELECT cell, round, round(avg(excess), 4) AS excess, count(*) AS n FROM (SELECT cell, round, ticks - avg(ticks) OVER (PARTITION BY cell, block) AS excess FROM samples) GROUP BY cell, round",
        "run_boundaries": "WITH f AS (SELECT user_id, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, run, min(event_id) AS first_event, count(*) AS n FROM (SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM f) GROUP BY 1, 2",
        "group_offsets": "SELECT l_orderkey, n, (sum(n) OVER (ORDER BY l_orderkey) - n)::BIGINT AS start FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)",
        "summary_aggregates": SAMPLES + " SELECT cell, count(*) AS n, count(DISTINCT block) AS n_blocks, min(ticks) AS low, max(ticks) AS high, avg(ticks) AS mean, (sum(ticks) FILTER (WHERE variant = 'base'))::BIGINT AS base_ticks, sum(ticks)::DOUBLE / sum(n_rows)::DOUBLE AS ticks_per_row, round(exp(avg(ln(ticks + 1.0::DOUBLE))), 6) AS geometric FROM samples GROUP BY cell",
        "pivot_speedup": f"{SAMPLES}, {MEDIANS} SELECT b.cell, b.ticks AS base, o.ticks AS other, b.ticks::DOUBLE / o.ticks AS speedup FROM medians b JOIN medians o ON b.cell = o.cell AND b.variant = 'base' AND o.variant = 'other'",
        "union_diagonal": "SELECT nation, count(*) AS n, count(s_acctbal) AS n_balances, count(DISTINCT segment) AS n_segments FROM (SELECT s_nationkey::BIGINT AS nation, s_acctbal, NULL AS segment FROM supplier UNION ALL SELECT c_nationkey, NULL, c_mktsegment FROM customer) GROUP BY 1",
        "argmax_attempt": SAMPLES + " SELECT cell, block, event_id FROM samples QUALIFY row_number() OVER (PARTITION BY cell, block ORDER BY round DESC, event_id DESC) = 1",
        "top_k": SAMPLES + " SELECT cell, block, count(*) AS n FROM samples GROUP BY 1, 2 ORDER BY n DESC, cell, block LIMIT 5",
        "set_difference": "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
        "sentinel_drift": SAMPLES + ", b AS (SELECT cell, block, sum(ticks)::BIGINT AS ticks FROM samples GROUP BY 1, 2) SELECT cell, block, ticks, first_value(ticks) OVER (PARTITION BY cell ORDER BY block) AS first_value, ticks::DOUBLE / first_value AS drift FROM b",
        "ablation_effect": SAMPLES + ", t AS (SELECT cell, variant, sum(ticks)::DOUBLE / sum(n_rows)::DOUBLE AS per_row FROM samples GROUP BY 1, 2) SELECT o.cell, o.variant, o.per_row / b.per_row AS slowdown FROM t o LEFT JOIN t b ON o.cell = b.cell AND b.variant = 'base' WHERE o.variant <> 'base'",
        "first_against_later": SAMPLES + ", r AS (SELECT cell, block, round, sum(ticks)::BIGINT AS ticks FROM samples GROUP BY 1, 2, 3) SELECT l.cell, sum(f.ticks)::BIGINT AS first_ticks, sum(l.ticks)::BIGINT AS later_ticks, count(*) AS n FROM r l JOIN r f ON l.cell = f.cell AND l.block = f.block AND f.round = 0 WHERE l.round > 0 GROUP BY 1",
        "precision_audit": "SELECT l_returnflag, count(*) FILTER (WHERE a < b) AS closer, count(*) FILTER (WHERE a = b) AS tie, count(*) FILTER (WHERE a > b) AS farther, max(a) AS max_a, max(b) AS max_b, quantile_cont(a, 0.5) AS median_a, quantile_cont(b, 0.5) AS median_b, max(a / l_extendedprice) AS relative_a, max(b / l_extendedprice) AS relative_b FROM (SELECT l_returnflag, l_extendedprice, abs(l_extendedprice::FLOAT::DOUBLE - l_extendedprice) AS a, abs(round(l_extendedprice, 1) - l_extendedprice) AS b FROM lineitem) GROUP BY 1",
        "output_compare": scored(averaged, scored(single, ORDERS, models.ORDER_FEATURES) + "SELECT * EXCLUDE (rid, x, tree_sum, raw_margin, output), tree_sum AS a FROM scored", models.ORDER_FEATURES)
        + "SELECT count(*) AS n, count(*) FILTER (WHERE a <> tree_sum) AS n_bits, count(*) FILTER (WHERE abs(a - tree_sum) > 2.0) AS n_beyond FROM scored",
        "stratified_sizes": f"SELECT l_orderkey, n, floor(log2(n))::BIGINT AS stratum FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY floor(log2(n)) ORDER BY {_seeded(2, 'l_orderkey')}, l_orderkey) <= 20",
        "two_mode_split": SAMPLES + ", d AS (SELECT DISTINCT cell, ticks FROM samples WHERE ticks > 0), g AS (SELECT cell, ticks AS low_top, lead(ticks) OVER (PARTITION BY cell ORDER BY ticks) AS high_bottom FROM d) SELECT cell, low_top, high_bottom, high_bottom::DOUBLE / low_top AS ratio FROM g WHERE high_bottom IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell ORDER BY high_bottom::DOUBLE / low_top DESC, low_top) = 1",
        "retime_flags": SAMPLES + ", s AS (SELECT cell, block, (max(ticks) - min(ticks))::DOUBLE / avg(ticks) AS spread FROM samples GROUP BY 1, 2) SELECT cell, count(*) AS n_flagged, (list(block ORDER BY spread DESC, block DESC))[1] AS widest_block FROM s WHERE spread > 0.5 GROUP BY 1",
        "validity_gates": SAMPLES + " SELECT cell, count(DISTINCT block) < 8 AS few_blocks, count(*) FILTER (WHERE ticks < 0) > 0 AS has_negative, count(*) > count(DISTINCT event_id) AS has_repeated FROM samples GROUP BY 1",
        "numeric_bins": f"SELECT len(list_filter({places}::DOUBLE[], lambda t: t < l_quantity))::BIGINT AS bin, count(*) AS n, min(l_quantity) AS low FROM lineitem GROUP BY 1",
    }
    n_varying = sum(p[0] not in models.EVENT_CONSTANT for p in forest.predicates)
    twins["work_per_row"] = f"""SELECT round(((c + v + r * {n_varying}) / g + (r / g) * {len(forest.trees)}) / (r / g) / {len(forest.trees) * forest.depth}, 9) AS share
FROM (SELECT sum(constant_events)::DOUBLE AS c, sum(varying_events)::DOUBLE AS v FROM ({twins['work_counters']})), (SELECT count(*)::DOUBLE AS r, count(DISTINCT user_id)::DOUBLE AS g FROM events)"""
    return twins
