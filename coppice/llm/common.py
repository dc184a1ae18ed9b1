"""What several operators share: checkpoints, row keys and table paths."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contract white space: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint in the folder that the session names.

    Where spark.checkpoint.dir is unset (tests, local runs) a folder of this
    machine is set; a cluster has to name a shared one.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "coppice-checkpoints"))
    return df.checkpoint(eager=True)


def forget(frame: DataFrame) -> None:
    """Deletes the files of a frame from checkpointed(); nothing may read it any more."""
    kept = frame._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if kept.isDefined():
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.get())
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidied(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files that nothing refers to: else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def lowered(text: Column | str) -> Column:
    """A-Z to a-z; other letters stay, unlike with lower()."""
    return F.translate(text, UPPER, LOWER)


def text_of(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_key(text: Column | None = None) -> Column:
    """Tells rows of one doc_id with different texts apart (16 bytes)."""
    text = text_of() if text is None else text
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text, F.lit(17)).alias("b"))


def spread_join(left: DataFrame, right: DataFrame, on: str | list[str], by: str, how: str = "inner", parts: int = 16) -> DataFrame:
    """left joined to right, which has one row for a value of `on`; a value may hold most rows of left.

    The rows of a value are dealt out by the hash of the column `by`, and right is repeated for each part.
    Both are sorted and merged: small sides would be broadcast as tables of whole memory pages.
    """
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    repeated = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(repeated.hint("merge"), [*([on] if isinstance(on, str) else on), "_part"], how).drop("_part")
