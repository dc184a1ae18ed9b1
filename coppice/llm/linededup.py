"""Line dedup (4): explode, hash, count documents, drop, reassemble by position.

Lines of at least `min_chars` code points whose normalised key stands in at
least `min_docs` documents are dropped from all of these but the one of the
largest doc_id.  Only hashes, positions and ids are shuffled by line; texts are
shuffled once, by document.  Documents are counted by line and document first.  The
rows of the lines that hold the most, HOT_LINES at most, are dealt over parts, so
that none of them gathers its rows in one task.

Defined results: a null or empty text is one empty line; a null doc_id counts
as one document below all others; repeated rows of a doc_id are one document
and each is returned; an empty table gives an empty one.  Other columns are kept
by `dedup_lines`, whatever their names.  Line keys are compared by 128 hash bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, checkpointed, lowered, text_of

_NO_ID = -(2**63)
#: A line with more than one part in HOT_LINES of the rows of all common lines is hot: so many at most.
HOT_LINES = 4096
#: Parts that the rows of a hot line are dealt over.
PARTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return lowered(F.btrim(line, F.lit(BLANKS)))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(3), key).alias("b"))


def with_drops(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of docs as column `row`, their lines as `lines`, the dropped positions as `drops`."""
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).alias("id"), text_of().alias("body"))
    lines = named.select("id", F.xxhash64("body").alias("body_hash"), F.posexplode(_lines(F.col("body"))).alias("at", "line"))
    # the trimmed length is checked before the costly lower-casing
    trimmed = lines.select("id", "body_hash", "at", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.char_length("line") >= min_chars)
    keyed = trimmed.select("id", "body_hash", "at", _hash(lowered("line")).alias("h")).select("id", "body_hash", "at", "h.a", "h.b")
    held = keyed.groupBy("a", "b", "id").agg(F.count(F.lit(1)).alias("rows")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"), F.sum("rows").alias("rows"))
    common = checkpointed(held.where(F.col("n") >= min_docs).select("a", "b", "keeper", "rows"))
    most = (common.agg(F.sum("rows")).first()[0] or 0) / HOT_LINES
    hot = [r.a for r in common.where(F.col("rows") > most).select("a").collect()]  # HOT_LINES at most
    is_hot = F.col("a").isin(hot) if hot else F.lit(False)
    # rows of hot lines are dealt over all parts, and these lines are repeated for each
    dealt = keyed.withColumn("part", F.when(is_hot, F.pmod(F.xxhash64("id", "at"), F.lit(PARTS)).cast("int")).otherwise(0))
    repeated = common.select("a", "b", "keeper", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
    dropped = dealt.join(repeated.hint("merge"), ["a", "b", "part"]).where("id <> keeper")
    drops = dropped.groupBy("id", "body_hash").agg(F.collect_set("at").alias("drops"))
    joined = named.withColumn("body_hash", F.xxhash64("body")).join(drops, ["id", "body_hash"], "left")
    return joined.select("row", _lines(F.col("body")).alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))


def kept_text(lines: Column, drops: Column) -> Column:
    """The lines that stay, joined; array_except keeps the order of positions and hashes."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
    return F.when(F.size(drops) == 0, F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with their columns, text cut to the lines that stay."""
    found = with_drops(docs, min_chars, min_docs)
    columns = [F.when(F.size("drops") == 0, F.col("row.text")).otherwise(kept_text(F.col("lines"), F.col("drops"))).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns)


def digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays."""
    found = with_drops(docs, min_chars, min_docs)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.size("lines").cast("bigint").alias("n_lines"), F.size("drops").cast("bigint").alias("n_dropped"), F.sha2(kept_text(F.col("lines"), F.col("drops")), 256).alias("kept_sha256"))
