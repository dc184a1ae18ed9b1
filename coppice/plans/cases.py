"""Scoring by generated SQL: one CASE per tree, exact integer sums, entity push-down.

Everything stays in generated code; nothing is shuffled but the join that the
caller asks for.  The JVM does not compile methods of more than 8,000 bytes of
bytecode, and whole-stage codegen puts a projection into one method.  So sums of
trees are projected outside of it (`small_methods`), where Spark splits the code
of every expression into small methods.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Forest, Node
from .options import Options

#: Bits of a flag word; bit 63 is the sign.
WORD = 63


def small_methods(column: str) -> Column:
    """0, by an expression that whole-stage codegen doesn't take; it keeps its projection out of there."""
    return F.size(F.filter(F.array(column), lambda v: F.lit(False))).cast("bigint")


def double_text(x: float) -> str:
    if math.isinf(x) or math.isnan(x):
        return f"double('{'NaN' if math.isnan(x) else 'Infinity' if x > 0 else '-Infinity'}')"
    return f"{x!r}D"


def condition(forest: Forest, predicate: tuple, column: str) -> str:
    """SQL that is true where a row goes left; never null for non-null input.

    Missing values are NaN, which Spark orders above all numbers, so 'x <= t' and
    'x < t' already send them right; infinite t takes a guard.
    """
    _, categorical, threshold, categories, default_left, op = predicate
    if categorical:
        x = f"double(float({column}))" if forest.single else column
        inside = f"{x} >= 0D AND {x} < 4294967296D"
        members = ", ".join(f"{c}L" for c in categories)
        # A number outside the range is compared as -1, so that the cast cannot overflow.
        test = f"bigint(CASE WHEN {inside} THEN {x} ELSE -1D END) IN ({members})" if categories else "false"
    elif forest.single:
        test = f"float({column}) {op} float({double_text(threshold)})"
    else:
        test = f"{column} {op} {double_text(threshold)}"
    return f"({test} OR isnan({column}))" if default_left else f"({test})"


def leaf_text(forest: Forest, node: Node) -> str:
    kind = forest.sum_plan.kind
    if kind == "long":
        return f"{forest.fixed(node.value)}L"
    return f"CAST('{forest.fixed(node.value)}' AS DECIMAL(38,0))"


def tree_text(forest: Forest, k: int, test: Callable[[tuple], str], options: Options = Options(), j: int = 0) -> str:
    """Two branches per split, the heavier one first."""
    n = forest.trees[k][j]
    if n.op is None:
        return leaf_text(forest, n)
    left, right = tree_text(forest, k, test, options, n.left), tree_text(forest, k, test, options, n.right)
    if not options.heavy_first or forest.heavy_left(k, j):
        return f"CASE WHEN {test(n.predicate)} THEN {left} ELSE {right} END"
    return f"CASE WHEN NOT {test(n.predicate)} THEN {right} ELSE {left} END"


def missing_as_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature columns as DOUBLE, null as NaN."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in columns})


def _added(terms: list[str]) -> str:
    """A balanced sum, so that its tree is not as deep as the forest is wide."""
    while len(terms) > 1:
        terms = [f"({a} + {b})" for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def add_sums(df: DataFrame, forest: Forest, test: Callable[[tuple], str], trees: Sequence[int], name: str, anchor: str, options: Options) -> DataFrame:
    """Adds the exact integer sum of the given trees' leaves; anchor is any column without nulls."""
    kind = "DECIMAL(38,0)" if forest.sum_plan.kind == "decimal" else "BIGINT"
    terms = [f"({tree_text(forest, k, test, options)})" for k in trees]
    if not terms:
        return df.withColumn(name, F.lit(0).cast(kind))
    total = F.expr(_added(terms))
    return df.withColumn(name, (total + small_methods(anchor) if options.small_methods else total).cast(kind))


def stage_columns(forest: Forest, fixed: Column) -> dict[str, Column]:
    """tree_sum, raw_margin and output, rounded at each step, from the integer sum."""
    total = fixed.cast("double") * F.lit(2.0**-forest.sum_plan.scale) + F.lit(0.0)
    return finish(forest, total)


def finish(forest: Forest, total: Column) -> dict[str, Column]:
    margin = total / F.lit(forest.divisor) + F.lit(forest.base_score)
    output = margin if forest.link == "identity" else F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(forest.alpha) * margin)))
    return {"tree_sum": total, "raw_margin": margin, "output": output}


def _checked(forest: Forest, features: Sequence[str]) -> None:
    if len(features) != forest.n_features:
        raise ValueError(f"{len(features)} feature columns for {forest.n_features} features")
    if forest.sum_plan.kind == "wide":
        raise ValueError("leaves too far apart for integer sums; use the walker")


def score(df: DataFrame, forest: Forest, features: Sequence[str], options: Options = Options()) -> DataFrame:
    """Adds tree_sum, raw_margin and output to every row; narrow, no shuffle."""
    _checked(forest, features)
    held = {f: f"__f{k}" for k, f in enumerate(features)}
    out = df.withColumns({h: F.coalesce(F.col(f).cast("double"), F.lit(math.nan)) for f, h in held.items()})
    names = list(held.values())
    out = add_sums(out, forest, lambda p: condition(forest, p, names[p[0]]), range(len(forest.trees)), "__sum", names[0], options)
    return out.withColumns(stage_columns(forest, F.col("__sum"))).drop("__sum", *names)


def score_pushed(
    entities: DataFrame, rows: DataFrame, key: str, forest: Forest, features: Sequence[str], constant: set[int], options: Options = Options()
) -> DataFrame:
    """Scores rows joined to their entities, deciding constant splits on the entities.

    Before the join each entity gets its constant predicates as bits of BIGINT words
    and the sum of trees without varying splits; only these cross the join. The join
    is a plain equi join: AQE broadcasts the entities if they are small enough and
    splits hot keys otherwise. Returns the columns of rows and the stages.
    """
    _checked(forest, features)
    fixed_trees = [k for k, t in enumerate(forest.trees) if options.entity_sums and all(n.op is None or n.feature in constant for n in t)]
    mixed = [k for k in range(len(forest.trees)) if k not in set(fixed_trees)]
    bits = {}
    for k in mixed:
        for n in forest.trees[k]:
            if n.op and n.feature in constant:
                bits.setdefault(n.predicate, len(bits))
    if not options.shared_predicates:
        return score(rows.join(entities.select(key, *[features[k] for k in sorted(constant)]), key), forest, features, options).select(
            key, *[c for c in rows.columns if c != key], *finish(forest, F.lit(0.0)))
    names = [f"__f{k}" for k in range(len(features))]
    on_entity = sorted(constant)
    held = entities.select(key, *[F.coalesce(F.col(features[k]).cast("double"), F.lit(math.nan)).alias(names[k]) for k in on_entity])
    words = []
    for w in range(0, len(bits), WORD):
        mine = [p for p, b in bits.items() if w <= b < w + WORD]
        text = " | ".join(f"(CASE WHEN {condition(forest, p, names[p[0]])} THEN {1 << bits[p] - w}L ELSE 0L END)" for p in mine)
        words.append(f"__w{w // WORD}")
        held = held.withColumn(words[-1], F.expr(text) + small_methods(names[on_entity[0]]))
    held = add_sums(held, forest, lambda p: condition(forest, p, names[p[0]]), fixed_trees, "__entity_sum", names[on_entity[0]] if on_entity else "__none", options)
    held = held.select(key, *words, "__entity_sum")
    varying = [k for k in range(len(features)) if k not in constant]
    out = rows.withColumns({names[k]: F.coalesce(F.col(features[k]).cast("double"), F.lit(math.nan)) for k in varying}).join(held, key)

    def test(p: tuple) -> str:
        if p[0] not in constant:
            return condition(forest, p, names[p[0]])
        return f"((__w{bits[p] // WORD} & {1 << bits[p] % WORD}L) <> 0L)"

    out = add_sums(out, forest, test, mixed, "__row_sum", "__entity_sum", options)
    out = out.withColumns(stage_columns(forest, F.col("__entity_sum") + F.col("__row_sum")))
    return out.drop("__entity_sum", "__row_sum", *words, *[names[k] for k in varying])
