"""Benchmark decontamination (8): pigeonhole edit matching.

Texts and items are lower-cased and white space becomes one space.  An item of
m characters may differ by k = m * error_percent / 100 edits.  Cut into k + 1
pieces, at least one piece stands unchanged in any passage within k edits, so
exact piece hits, found for all items at once by one automaton, are complete
candidates.  Each is verified with Myers' bit-parallel distance on the window
of text that the piece's place in the item allows.

Defined results: null or empty texts match nothing and so do null or empty
items; equal items each match; for each doc_id and item one row is returned
(for repeated rows of a doc_id too), that of the least distance, the first of
equals; an empty table gives an empty one; other columns are ignored by
`matches` and kept by `clean`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MATCHES = "doc_id bigint, item_id bigint, distance int, start bigint, end bigint, n_chars bigint"
#: Characters of items that one pass over the documents takes, and that are broadcast at once; more items take more passes.
BLOCK_CHARS = 16_000_000


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 consecutive pieces of nearly equal length, with their places."""
    n = errors + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of pattern to any substring of text, and that substring's end (the first)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        rise, fall = minus | ~(diagonal | plus) & full, plus & diagonal
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        plus, minus = fall | ~(diagonal | rise) & full, rise & diagonal
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """The automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], error_percent: int):
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normalised(text or "")
            if item:
                errors = len(item) * error_percent // 100
                for at, piece in pieces(item, errors):
                    places.setdefault(piece, []).append((len(self.items), at))
                self.items.append((item_id, item, item[::-1], errors))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of every item found in a normalised text."""
        if self.empty or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for item, at in where:
                starts.setdefault(item, []).append(end + 1 - length - at)
        found = []
        for item, at in starts.items():
            item_id, pattern, reverse, errors = self.items[item]
            m, best = len(pattern), None
            at.sort()
            k = 0
            while k < len(at):
                # hits whose windows overlap are verified together; a group spans at most one more item length
                last = bisect_left(at, at[k] + m + 1, k)
                low, high = max(0, at[k] - errors), min(len(text), at[last - 1] + m + errors)
                if high - low >= m - errors:
                    distance, end = myers(pattern, text[low:high])
                    if distance <= errors and (best is None or distance < best[0]):
                        _, back = myers(reverse, text[max(low, low + end - m - errors) : low + end][::-1])
                        best = (distance, low + end - back, low + end)
                k = last
            if best:
                found.append((item_id, *best))
        return found


_made: list[tuple] = []


def _matcher(items, error_percent: int) -> Matcher:
    """One automaton for a worker, as long as its tasks take the same items."""
    value = items.value
    if not _made or _made[0][0] is not value or _made[0][1] != error_percent:
        _made[:] = [(value, error_percent, Matcher(value, error_percent))]
    return _made[0][2]


def _matching(items, error_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, error_percent)
        for batch in batches:
            out = []
            ids, texts = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                text = texts[row].as_py()
                if text:
                    text = normalised(text)
                    doc = ids[row].as_py()
                    out += [(doc, *hit, len(text)) for hit in matcher.find(text)]
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "end", "n_chars"])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, so that what is broadcast at once has a bound."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if block and size + len(row.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, error_percent: int = 8) -> DataFrame:
    """One row for each document and item with a passage within the item's error budget."""
    spark, frame, done, part, items = docs.sparkSession, docs.select("doc_id", "text"), [], None, None
    for block in _blocks(benchmark):
        if part is not None:  # one block at a time is held
            done.append(checkpointed(part))
            items.unpersist()
        items = spark.sparkContext.broadcast(block)
        part = frame.mapInArrow(_matching(items, error_percent), MATCHES)
    found = reduce(lambda a, b: a.unionAll(b), done, part)
    best = F.min_by(F.struct("distance", "start", "end", "n_chars"), F.struct("distance", "start", "end", "n_chars"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, error_percent: int = 8) -> DataFrame:
    """The documents without any benchmark passage, judged row by row: no join."""
    frame, at, items = docs, docs.columns.index("text"), None
    for block in _blocks(benchmark):
        if items is not None:
            frame = checkpointed(frame)
            items.unpersist()
        items = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, error_percent)
            for batch in batches:
                texts = batch.column(at)
                stay = [not matcher.find(normalised(texts[k].as_py() or "")) for k in range(batch.num_rows)]
                yield batch.filter(pa.array(stay, pa.bool_()))

        frame = frame.mapInArrow(run, docs.schema)
    return frame
