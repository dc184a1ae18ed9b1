"""Streaming input: scoring is a projection, so it runs on streams as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.predictor import Predictor


def score_stream(stream: DataFrame, predictor: Predictor) -> DataFrame:
    """The stages of every row of a stream, stateless."""
    return predictor.predict(stream)


def windowed_scores(stream: DataFrame, predictor: Predictor, time: str, window: str, lateness: str) -> DataFrame:
    """Number, sum of tree sums and largest output by window; rows later than lateness are dropped by the watermark."""
    scored = predictor.predict(stream.withWatermark(time, lateness))
    return scored.groupBy(F.window(time, window).alias("window")).agg(
        F.count("*").alias("n_rows"), F.sum("tree_sum").alias("tree_sum"), F.max("output").alias("max_output")
    ).select(F.col("window.start").alias("window_start"), "n_rows", "tree_sum", "max_output")
