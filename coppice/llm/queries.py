"""The registered queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chains, chat, decontam, htmltext, jaccard, licenses, linededup, pieces, pii, quality
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.passages(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows of one turn each, and conversation -1 as a record of messages: two layouts, one output."""
    rows = chat.row_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    said = "<|im_end|><|im_start|>assistant ok"
    record = json.dumps({"messages": [{"role": role, "content": said} for role in ("user", "assistant")]})
    records = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(record).alias("record"))
    return chat.digest(rows.unionByName(chat.json_turns(records).select("conv_id", "turns")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.read_model(spark))


ALL = (op1_quality_rules, op2_substring_dedup, op3_pii, op4_line_dedup, op5_chat_format, op6_license_scan, op7_jaccard_join, op8_decontamination, op9_html_extract, op10_sentencepiece)


def queries():
    return {f.__name__: f for f in ALL}
