"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    For a checkout that driver and executors share; where it is not shared,
    install the package or pass it with --py-files.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if a scan of few or small files has less; for costly projections.

    On large inputs scans have more partitions than cores, and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
