"""Tables of a run: their schemas, conforming frames to them, and whether samples cover what was to be timed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MalformedModel

_COUNT = T.DecimalType(20, 0)  # unsigned 64-bit


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name.rstrip("_"), kind) for name, kind in kinds.items()])


def _many(names: str, kind: T.DataType) -> dict[str, T.DataType]:
    return dict.fromkeys(names.split(), kind)


# The columns of the run tables.
SCHEMAS = {
    "samples": _schema(sample_id=T.LongType(), **_many("suite cell variant method mode interface", T.StringType()), **_many("block batch position repetition process group n_groups rows", T.LongType()), ticks=_COUNT),
    "groups": _schema(**_many("suite cell", T.StringType()), **_many("group entity first_row rows", T.LongType()), timed=T.BooleanType()),
    "stages": _schema(**_many("suite cell", T.StringType()), **_many("group row", T.LongType()), **_many("tree_sum raw_margin output", T.DoubleType())),
    "hw": _schema(**_many("suite cell variant method mode", T.StringType()), **_many("block process", T.LongType()), **_many("cycles instructions branches branch_misses cache_references cache_misses", _COUNT), status=T.StringType()),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """df under a table's schema; ANSI casts fail on loss of range, further columns are refused, lacking ones too."""
    schema = SCHEMAS[table]
    if sorted(df.columns) != sorted(schema.names):
        raise MalformedModel(f"columns {sorted(df.columns)} for table {table}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def write(df: DataFrame, table: str, path: str) -> None:
    conform(df, table).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{table}.parquet")


def round_faults(samples: DataFrame, groups: DataFrame) -> DataFrame:
    """For each cell, method and round of serving samples what is wrong; a faultless round has 0 everywhere.

    lacking: timed groups without a sample; repeated: samples beyond one a group; untimed:
    samples of groups that were not to be timed; wrong_rows: samples with another row count.
    """
    known = groups.select("cell", "group", F.col("rows").alias("g_rows"), "timed")
    wanted = known.where("timed").groupBy("cell").agg(F.count("*").alias("wanted"))
    keys = ["cell", "method", "repetition"]
    joined = samples.join(known, ["cell", "group"], "left").withColumn("timed", F.coalesce("timed", F.lit(False)))
    found = joined.groupBy(*keys).agg(
        F.count_distinct(F.when(F.col("timed"), F.col("group"))).alias("held"), (F.count("*") - F.count_distinct("group")).alias("repeated"),
        F.count_if(~F.col("timed")).alias("untimed"), F.count_if(F.coalesce(F.col("rows") != F.col("g_rows"), F.lit(True))).alias("wrong_rows"))
    return found.join(wanted, "cell", "left").select(*keys, (F.coalesce("wanted", F.lit(0)) - F.col("held")).alias("lacking"), "repeated", "untimed", "wrong_rows")
