"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; all but the last keep the columns of documents.

Defined results: null and empty texts, and all under 50 words, fail the base rule
and end in the first stage.  Rows of a null doc_id pass through as any other: for
line dedup they are one document below all others, as near duplicates each is its own
group.  Rows that share a doc_id and differ in text are judged each by itself; of
rows that are equal in both one stays at near duplicates, the least by its other
columns.  An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import decontam, jaccard, linededup, pieces, quality
from coppice.llm.common import checkpointed, table, tidied
from coppice.session import importable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the likelihood ratio rejects go."""
    return quality.keep(docs, table(importable(spark), sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from all documents but the last that holds them; n_chars follows the text."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of linked documents stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and round_trip: whether the ids decode to the text."""
    return pieces.encode(docs, pieces.read_model(spark))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can express neither the model of the first stage nor the encoding of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again.

    Rows of a stage are deleted once those of the next are written, and its shuffle files
    with them; those that the last one reads stay, as it is evaluated by the caller.
    """
    docs = table(importable(spark), sf_dir, "documents")
    checkpointed(spark.range(1))  # names the shared folder where the session doesn't
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            old = jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}")
            old.getFileSystem(hadoop).delete(old, True)
        tidied(spark)
