"""Choosing a plan: generated CASE text for small forests, the walker for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GroupingConfig
from ..model import Forest
from . import cases, frontier, grouped, walker
from .options import Options

#: Splits up to which CASE text is made: every task's JVM compiles it, some 1 ms a split, before its first row.
CASE_SPLITS = 2000


class Predictor:
    """Scores DataFrames by one forest under one grouping configuration."""

    def __init__(self, forest: Forest, config: GroupingConfig, features: Sequence[str]):
        if config.n_features != forest.n_features or len(features) != forest.n_features:
            raise ValueError("forest, configuration and columns differ in width")
        self.forest, self.config, self.features = forest, config, list(features)

    @property
    def strategy(self) -> str:
        small = (self.forest.n_nodes - len(self.forest.trees)) // 2 <= CASE_SPLITS
        return "cases" if small and self.forest.sum_plan.kind != "wide" else "walker"

    def predict(self, df: DataFrame, strategy: str | None = None, *, group: str | None = None, order: Sequence[str] = (), options: Options = Options()) -> DataFrame:
        """All columns of df with the three stages; every strategy gives the same rows."""
        strategy = strategy or self.strategy
        if strategy == "cases":
            return cases.score(df, self.forest, self.features, options)
        if strategy == "walker":
            return walker.score(df, self.forest, self.features, df.columns)
        if strategy == "grouped":
            return grouped.score(df, self.forest, self.features, set(self.config.constant_features), group, df.columns)
        if strategy == "frontier":
            return frontier.score(df, group, order, self.forest, self.features)
        raise ValueError(strategy)

    def predict_group(self, df: DataFrame, group: str, value) -> DataFrame:
        """One group's rows; the filter reaches the scan."""
        return self.predict(df.filter(F.col(group) == F.lit(value)))

    def predict_fixed(self, df: DataFrame, width: int, order: Sequence[Column | str], shard: str | None = None) -> DataFrame:
        """Groups of width consecutive rows, the last one shorter; adds group_id.

        Rows are numbered inside each shard, so that numbering is one window per
        shard. Without a shard all rows pass one task; give one on large inputs.
        """
        if width < 1:
            raise ValueError(f"width {width}")
        window = Window.partitionBy(shard) if shard else Window.partitionBy()
        place = F.row_number().over(window.orderBy(*order)) - 1
        return self.predict(df.withColumn("group_id", F.floor(place / width)))

    def predict_pushed(self, entities: DataFrame, rows: DataFrame, key: str, options: Options = Options()) -> DataFrame:
        """Constant features from entities, varying ones from rows."""
        if self.strategy == "walker":
            kept = [self.features[k] for k in self.config.constant_features]
            joined = rows.join(entities.select(key, *kept), key)
            return grouped.score(joined, self.forest, self.features, set(self.config.constant_features), key, rows.columns)
        return cases.score_pushed(entities, rows, key, self.forest, self.features, set(self.config.constant_features), options)
