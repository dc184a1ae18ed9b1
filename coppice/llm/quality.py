"""Quality rules (1): a hashed n-gram log-likelihood ratio, length-normalised.

Two multinomials over hashed token uni- and bigrams are counted: one over every
document (the raw corpus), one over a bounded sample of trusted rows.  The score
of a text is the mean, over its n-grams, of log(target / raw).  A document is
kept if its score reaches a threshold that is fitted once on the other half of
the labelled sample, so the same input always gives the same decisions.

Defined results: a null or empty text has no words, zero counts, score 0 and is
rejected by the base rule; repeated rows are scored alike; an empty table gives
an empty result; columns other than doc_id and text are ignored by `score` and
kept as they are by `keep`.  Null doc_ids stay null.  Without labelled rows (or
with none of one class) the threshold is `Rules.fallback_threshold`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


@dataclass(frozen=True)
class Rules:
    bucket_bits: int = 16
    #: Labelled rows of each class that the target model and the threshold use at most.
    sample_rows: int = 20_000
    #: Added to both counts of a bucket before the ratio.
    smoothing: float = 5.0
    #: A lost clean document costs as much as so many kept bad ones.
    clean_weight: float = 20.0
    min_words: int = 50
    repeat_percent: int = 50
    fallback_threshold: float = -0.5


def _buckets(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = K.tokens(data, offsets)
    one, owner = K.span_hashes(data, starts, ends), K.owners(starts, offsets)
    two, at = K.grams(one, owner, 2)
    return (np.concatenate([one, two]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([owner, owner[at]])


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (owner, key), and whether each in that order equals the one before."""
    order = np.lexsort((keys, owner))
    same = np.zeros(len(order), bool)
    k, o = keys[order], owner[order]
    same[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return order, same


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's base counts of every text of a slice."""
    n, rows = len(data), len(offsets) - 1
    starts, ends = K.words(data, offsets)
    owner = K.owners(starts, offsets)
    hashes = K.span_hashes(data, starts, ends)
    points = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    symbols = np.zeros(n + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    windows, at = K.grams(hashes, owner, 3)
    order, same = _repeats(windows, owner[at])
    twice = same.copy()
    twice[:-1] |= same[1:]
    covered = np.zeros(len(starts), bool)
    first = at[order[twice]]
    for k in range(3):
        covered[first + k] = True

    ends_of_lines = np.flatnonzero(data == 10)
    ends_of_texts = offsets[1:]
    line_ends = np.unique(np.concatenate([ends_of_lines, ends_of_texts]))
    line_starts = np.unique(np.concatenate([offsets[:-1], ends_of_lines + 1]))
    line_starts = line_starts[line_starts < n]
    line_starts = line_starts[data[line_starts] != 10]
    line_ends = line_ends[np.searchsorted(line_ends, line_starts, "right")]
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_owner = K.owners(line_starts, offsets)
    order, same = _repeats(K.span_hashes(data, line_starts, line_ends), line_owner)

    count = lambda of, weights=None: np.bincount(of, weights, minlength=rows).astype(np.int64)
    return {
        "n_words": count(owner),
        "word_chars": count(owner, points[ends] - points[starts]),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": count(line_owner[order[same]]),
        "n_repeat_words": count(owner[covered]),
    }


def _corpus_counter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, data, offsets in K.text_slices(batch.column(0)):
                bucket, owner = _buckets(data, offsets, bits)
                raw += np.bincount(bucket, minlength=1 << bits)
                target += np.bincount(bucket[trusted[first:last][owner]], minlength=1 << bits)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])

    return run


def _scorer(bits: int, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            for first, last, data, offsets in K.text_slices(batch.column(batch.num_columns - 1)):
                bucket, owner = _buckets(data, offsets, bits)
                n = np.bincount(owner, minlength=last - first)
                total = np.bincount(owner, table[bucket], minlength=last - first)
                base = base_counts(data, offsets)
                # to 9 decimals: the order of additions then decides nothing
                score = np.round(total / np.maximum(n, 1), 9) + 0.0
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns[:-1]), *map(pa.array, base.values()), pa.array(score)], [*batch.schema.names[:-1], *base, "llr"])

    return run


def _labelled(labels: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, quality and fit (half of the rows) of at most rules.sample_rows rows of each class."""
    ids = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.withColumn("_mark", F.xxhash64("doc_id", F.lit(11)))
    parts = [ids.where(F.col("quality") == q).orderBy("_mark", "doc_id").limit(rules.sample_rows) for q in (0, 1)]
    return parts[0].unionAll(parts[1]).select("doc_id", "quality", (F.pmod("_mark", F.lit(2)) == 0).alias("fit"))


def threshold_of(scores: list[tuple[float, int]], clean_weight: float, fallback: float) -> float:
    """The cut of least cost between the scores of good (1) and bad (0) rows."""
    good = np.sort([s for s, q in scores if q == 1])
    bad = np.sort([s for s, q in scores if q == 0])
    if not len(good) or not len(bad):
        return fallback
    points = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[points[0] - 1], (points[1:] + points[:-1]) / 2])
    cost = clean_weight * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[np.argmin(cost)])


def _frame(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> tuple[np.ndarray, float]:
    """The weight of each bucket, from counts over all documents, and the threshold.

    To the driver go 2**bucket_bits counts and the scores of at most
    2 * sample_rows rows, whatever the size of the corpus.
    """
    spark, size = docs.sparkSession, 1 << rules.bucket_bits
    sample = [tuple(r) for r in _labelled(labels, rules).collect()]  # bounded by 2 * sample_rows
    sampled = spark.createDataFrame(sample, "doc_id bigint, quality int, fit boolean")
    trusted = sampled.where("quality = 1 and fit").select("doc_id", F.lit(True).alias("_trusted"))
    marked = _frame(docs).join(F.broadcast(trusted), "doc_id", "left").select("text", F.coalesce("_trusted", F.lit(False)).alias("trusted"))
    counts = marked.mapInArrow(_corpus_counter(rules.bucket_bits), "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(size), np.zeros(size)
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    expected = raw * (target.sum() / max(raw.sum(), 1))
    weights = np.log((target + rules.smoothing) / (expected + rules.smoothing))

    held_out = _frame(docs).join(F.broadcast(sampled.where("not fit")), "doc_id").select("quality", "text")
    scored = held_out.mapInArrow(_scorer(rules.bucket_bits, spark.sparkContext.broadcast(weights)), f"quality int, {COUNTS}, llr double")
    scores = [(r.llr, r.quality) for r in scored.where(~_base_failed(rules)).select("llr", "quality").collect()]
    return weights, threshold_of(scores, rules.clean_weight, rules.fallback_threshold)


def _base_failed(rules: Rules):
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))


def score(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and llr of every document."""
    weights, threshold = fit(docs, labels, rules)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    scored = _frame(docs).mapInArrow(_scorer(rules.bucket_bits, shared), f"doc_id bigint, {COUNTS}, llr double")
    judged = scored.withColumn("base_failed", _base_failed(rules))
    return judged.select(*(c for c in judged.columns if c != "llr"), (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")


def keep(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents, with all their columns, judged row by row without a join."""
    weights, threshold = fit(docs, labels, rules)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits, names = rules.bucket_bits, docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scored in _scorer(bits, shared)(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["row", "text"])])):
                words, repeated = scored["n_words"].to_numpy(), scored["n_repeat_words"].to_numpy()
                good = (words >= rules.min_words) & (100 * repeated <= rules.repeat_percent * words) & (scored["llr"].to_numpy() >= threshold)
                yield batch.take(pa.array(scored["row"].to_numpy()[good]))

    return docs.mapInArrow(run, docs.schema)
