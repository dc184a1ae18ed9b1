"""SentencePiece encoding and decoding (10) as a max-plus scan over chunks.

A text is a path of tokens.  For a merge (BPE) model the weight of a step from
one token to the next is 0 if merging both together would leave them as they are,
else minus infinity: a sequence of tokens is the model's encoding exactly if
each neighbouring pair is.  So the encoding is the path of greatest weight, 0.

A long text is cut every `chunk_chars`.  The state at a cut is the token that
ends at or reaches over it.  Every chunk, on its own, gives the matrix of weights
from entry to exit states.  Max-plus products of these are associative: they are taken
in a tree, FAN matrices at a time, up to the matrix of the whole text, and on the
way back each product's entry and exit states fix those of its factors.  Then each
chunk is traced back independently.  Within a chunk, places where no
piece spans two characters cut the text into units, whose paths are cached.

Defined results: a null or empty text has no tokens; U+2581 decodes to a space,
as in the library; characters outside the vocabulary become bytes; a null doc_id
stays null; repeated rows are encoded alike; an empty table gives an empty one;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import checkpointed

#: Texts of more characters are scanned in chunks of so many.
CHUNK_CHARS = 1 << 16
#: Matrices that one product of the tree takes.
FAN = 32
#: Entries of the caches of units and of pairs in a worker.  That of pairs starts anew when it is full; of units
#: those of the last half that was filled stay, and of these what is met again.
CACHED = 140_000
SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# Numbers of the model file's fields and of its piece types.
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6
_MERGE_MODEL = 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            size, at = number(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _distinct(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans that cover code one of each kind, and for each span which of these it equals."""
    _, least, of = np.unique(K.code_hashes(code, starts, ends), return_index=True, return_inverse=True)
    n, same = ends - starts, least[of]
    if (n == n[same]).all() and (code == code[np.arange(len(code)) - np.repeat(starts - starts[same], n)]).all():
        return least, of
    return np.arange(len(starts)), np.arange(len(starts))


Tree = dict[str, tuple["Tree", str | None]]
_LEAF: tuple[Tree, None] = ({}, None)


def _tree(pieces: list[str], depth: int) -> Tree:
    """The tree of sorted pieces that agree up to depth and go on."""
    out: Tree = {}
    for c, group in groupby(pieces, key=lambda p: p[depth]):
        same = list(group)
        whole = same[0] if len(same[0]) == depth + 1 else None
        longer = same[1:] if whole else same
        out[c] = (_tree(longer, depth + 1) if longer else _LEAF[0], whole)
    return out


class Vocabulary:
    """Pieces, scores and options of a merge model without character normalisation."""

    def __init__(self, model: bytes):
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.shown: list[bytes] = []
        byte_ids: dict[int, int] = {}
        self.unknown, self.prefix = 0, True
        kind = None
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                text, score, sort, k = piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, _NORMAL), len(self.shown)
                self.shown.append(text.replace(SPACE, " ").encode() if sort in (_NORMAL, _USER, _UNUSED) else b"")
                if sort in (_NORMAL, _USER, _UNUSED):
                    self.ids[text], self.scores[text] = k, score
                elif sort == _BYTE:
                    byte_ids[int(text[3:5], 16)] = k
                    self.shown[k] = bytes([int(text[3:5], 16)])
                elif sort == _UNKNOWN:
                    self.unknown = k
                    self.shown[k] = " ⁇ ".encode()
            elif field == 2:
                kind = dict(_fields(value)).get(3)
            elif field == 3:
                options = dict(_fields(value))
                self.prefix = options.get(3, 1) == 1
                if options.get(2) or options.get(4, 1) == 1:
                    raise ValueError("models that normalise characters or drop spaces are not supported")
        if kind != _MERGE_MODEL:
            raise ValueError("only merge (BPE) models are supported")
        self.bytes = [byte_ids.get(b) for b in range(256)] if len(byte_ids) == 256 else None
        self.longest = max(map(len, self.ids))
        #: Beginnings of pieces as a tree: by character, what may follow and the piece that ends there, or None.
        self.tree: Tree = _tree(sorted(p for p in self.ids if p), 0)
        inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        alphabet = {c: k + 1 for k, c in enumerate(sorted({c for two in inside for c in two}))}
        self.kind = np.zeros(0x110000, np.uint16)
        for c, k in alphabet.items():
            self.kind[ord(c)] = k
        self.joins = np.zeros((len(alphabet) + 1, len(alphabet) + 1), bool)
        for two in inside:
            self.joins[alphabet[two[0]], alphabet[two[1]]] = True
        self._pairs: dict[str | None, dict[str, bool]] = {}
        self._n_pairs = 0
        self._units: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for the short strings that pairs are: best score first, then leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: str | None, token: str) -> bool:
        """Whether the step has weight 0."""
        known = self._pairs.get(before, {}).get(token)
        if known is None:
            if self._n_pairs > CACHED:
                self._pairs.clear()
                self._n_pairs = 0
            # a first token must be what merging gives for its own characters
            known = self.merged((before or "") + token) == ([before, token] if before else [token])
            self._pairs.setdefault(before, {})[token] = known
            self._n_pairs += 1
        return known

    def path(self, text: str, start: int, first: str | None, stop: int) -> list[str | None]:
        """For each place up to stop, the last token of the path that reaches it from (start, first); None if none does.

        The path to a place is unique, so one token a place is the whole state.
        """
        tree, fits, pairs = self.tree, self.fits, self._pairs
        last: list[str | None] = [None] * (stop + 1)
        none: dict[str, bool] = {}
        for begin in range(start, stop):
            before = first if begin == start else last[begin]
            if before is None and begin > start:
                continue
            after = pairs.get(before, none).get
            # a character is a token even if it is no piece
            token = text[begin]
            follow, end = tree.get(token, _LEAF)[0], begin
            while True:
                end += 1
                if token is not None and last[end] is None:
                    known = after(token)
                    if known or (known is None and fits(before, token)):
                        last[end] = token
                if end == stop or (node := follow.get(text[end])) is None:
                    break  # no piece goes on like this
                follow, token = node
        return last

    def token_ids(self, token: str) -> list[int]:
        known = self.ids.get(token)
        if known is not None:
            return [known]
        return [self.bytes[b] for b in token.encode()] if self.bytes else [self.unknown]

    def back(self, last: list[str | None], start: int, end: int) -> list[str]:
        tokens = []
        while end > start:
            tokens.append(last[end])
            end -= len(last[end])
        return tokens[::-1]

    def unit(self, text: str) -> bytes:
        """Ids, as int32 bytes, of a text that stands between places where no piece spans."""
        found = self._units.get(text)
        if found is None:
            found = self._older.get(text)
            if found is None:
                tokens = self.back(self.path(text, 0, None, len(text)), 0, len(text))
                found = np.array([i for t in tokens for i in self.token_ids(t)], np.int32).tobytes()
            if len(text) <= 64:
                if len(self._units) >= CACHED // 2:
                    self._older, self._units = self._units, {}
                self._units[text] = found
        return found

    def cuts(self, text: str) -> np.ndarray:
        """Places where a unit starts."""
        return self._starts(_code(text))

    def _starts(self, code: np.ndarray, firsts: np.ndarray | None = None) -> np.ndarray:
        kind = self.kind[code]
        new = np.empty(len(kind), bool)
        new[:1] = True
        new[1:] = ~self.joins[kind[:-1], kind[1:]]
        if firsts is not None:
            new[firsts] = True
        return np.flatnonzero(new)

    def prepared(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's ids start and the last end.  One chunk each."""
        return self._encoded(texts)[:2]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bool]:
        """The same, and whether all distinct units decode to themselves, as then all texts do."""
        ready = [self.prepared(t) for t in texts]
        lengths = np.array([len(t) for t in ready], np.int64)
        joined = "".join(ready)
        offsets = np.zeros(len(ready) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(ready) + 1, np.int64), True
        code = _code(joined)
        starts = self._starts(code, offsets[:-1][lengths > 0])
        ends = np.append(starts[1:], len(code))
        least, of = _distinct(code, starts, ends)
        known, unit = self._units, self.unit
        units = list(map(joined.__getitem__, map(slice, starts[least].tolist(), ends[least].tolist())))
        found = [known.get(u) or unit(u) for u in units]
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, first = np.frombuffer(b"".join(found), np.int32), np.cumsum(n) - n
        total = np.zeros(len(of) + 1, np.int64)
        np.cumsum(n[of], out=total[1:])
        ids = flat[np.arange(total[-1]) - np.repeat(total[:-1] - first[of], n[of])]
        # only an unknown character does not show itself, and what it shows is longer than any
        shown = b"".join(map(self.shown.__getitem__, flat.tolist())) == "".join(units).replace(SPACE, " ").encode()
        return ids, total[np.searchsorted(starts, offsets)], shown

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    # Chunks of a long text.  Places are relative to the piece of text at hand.

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Tokens that end at or reach over a cut, as (start, end) relative to it; the text's own ends bound them."""
        if cut == 0:
            return [(0, 0)]
        if cut == len(text):
            return [(a - cut, 0) for a in range(max(0, cut - self.longest), cut) if a == cut - 1 or text[a:cut] in self.ids]
        out = []
        for a in range(max(0, cut - self.longest), cut):
            for b in range(cut, min(len(text), a + self.longest) + 1):
                if b - a == 1 or text[a:b] in self.ids:
                    out.append((a - cut, b - cut))
        return out

    def _middle(self, text: str, low: int, high: int) -> tuple[list[int], int]:
        """Unit starts after low and, of these, the last that no state at high reaches below (-1: none).

        No token passes a unit start, so paths from either side of one are independent.
        """
        starts = self.cuts(text)
        starts = starts[(starts >= max(low, 1)) & (starts <= high)].tolist()
        before = bisect_right(starts, high - self.longest)
        return starts, starts[before - 1] if before else -1

    def _head(self, text: str, starts: list[int], tail: int, begin: int, first: str | None) -> tuple[int, list[str | None]] | None:
        """The first unit start at or after begin and the path to it; None if there is none up to tail."""
        at = bisect_left(starts, begin)
        if at == len(starts) or starts[at] > tail:
            return None
        return starts[at], self.path(text, begin, first, starts[at])

    def matrix(self, text: str, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """(entry, exit) pairs of weight 0 of the chunk from low to high; others are minus infinity."""
        exits, out = self.states(text, high), []
        starts, tail = self._middle(text, low, high)
        open_exits: list[tuple[int, int]] = []
        if tail >= 0:
            last = self.path(text, tail, None, high)
            open_exits = [(a, b) for a, b in exits if high + a == tail or last[high + a] is not None]
            open_exits = [(a, b) for a, b in open_exits if self.fits(None if high + a == tail else last[high + a], text[high + a : high + b])]
        for entry in self.states(text, low):
            begin = low + entry[1]
            first = text[low + entry[0] : begin] or None
            if head := self._head(text, starts, tail, begin, first):
                # every entry that reaches a unit start reaches every exit that the last one opens
                if head[0] == begin or head[1][head[0]] is not None:
                    out += [(*entry, *leave) for leave in open_exits]
                continue
            last = self.path(text, begin, first, min(len(text), high + self.longest))
            for a, b in exits:
                if (high + a, high + b) == (low + entry[0], begin):  # the entry's token reaches over a short last chunk
                    out.append((*entry, a, b))
                    continue
                before = first if high + a == begin else last[high + a] if high + a > begin else None
                if high + a >= begin and (before is not None or high + a == begin) and self.fits(before, text[high + a : high + b]):
                    out.append((*entry, a, b))
        return out

    def trace(self, text: str, low: int, high: int, entry: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """Ids of the tokens after the entry's up to and with the exit's."""
        if (high + leave[0], high + leave[1]) == (low + entry[0], low + entry[1]):
            return []
        begin, end = low + entry[1], high + leave[0]
        first = text[low + entry[0] : begin] or None
        starts, tail = self._middle(text, low, high)
        if head := self._head(text, starts, tail, begin, first):
            inner = starts[bisect_left(starts, head[0]) : bisect_right(starts, tail)]
            ids = [i for t in self.back(head[1], begin, head[0]) for i in self.token_ids(t)]
            ids += np.frombuffer(b"".join(self.unit(text[a:b]) for a, b in zip(inner, inner[1:])), np.int32).tolist()
            tokens = self.back(self.path(text, tail, None, end), tail, end)
        else:
            ids, tokens = [], self.back(self.path(text, begin, first, end), begin, end)
        return ids + [i for t in [*tokens, text[end : high + leave[1]]] for i in self.token_ids(t)]


Edges = list[tuple[int, int, int, int]]


def combined(left: Edges, right: Edges) -> Edges:
    """Max-plus product of two matrices of weights 0 and minus infinity."""
    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, c, d in right:
        by.setdefault((a, b), []).append((c, d))
    return sorted({(a, b, *to) for a, b, c, d in left for to in by.get((c, d), ())})


def states_on_path(matrices: list[Edges], entry: tuple[int, int] = (0, 0), leave: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """The state at each cut, first and last ones with them, on the path of weight 0 from entry to leave."""
    reached = [{entry}]
    for m in matrices:
        reached.append({(c, d) for a, b, c, d in m if (a, b) in reached[-1]})
    state = min(reached[-1]) if leave is None else leave
    out = [state]
    for m, before in zip(reversed(matrices), reversed(reached[:-1]), strict=True):
        state = min((a, b) for a, b, c, d in m if (c, d) == state and (a, b) in before)
        out.append(state)
    return out[::-1]


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One vocabulary, with its caches, for a worker."""
    model = shared.value
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(model)
    return _loaded[key]


def read_model(spark, path: str = MODEL) -> bytes:
    """The model's bytes, read by Spark if the path has a scheme, else from this machine."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as file:
        return file.read()


def _encode_short(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for batch in batches:
            first = 0
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64).cumsum()
            while first < batch.num_rows:
                start = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, start + (1 << 18), "right")))
                texts = [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()]
                ids, offsets, shown = v._encoded(texts)
                same = [shown or v.decode(ids[a:b].tolist()) == t.replace(SPACE, " ") for t, a, b in zip(texts, offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(same)], ["doc_id", "ids", "round_trip"])
                first = last

    return run


_CHUNK = "row string, at int, low bigint, high bigint, doc_id bigint, body string"


def _chunker(shared, chunk: int):
    """Rows (row, doc_id, text) to the chunks of each text, with as many characters around as a piece has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for batch in batches:
            for row, doc_id, text in zip(*batch.columns):
                ready, row, doc_id = v.prepared(text.as_py()), row.as_py(), doc_id.as_py()
                for first in range(0, len(ready), 16 * chunk):
                    lows = range(first, min(first + 16 * chunk, len(ready)), chunk)
                    begins, ends = [max(low - v.longest, 0) for low in lows], [min(low + chunk, len(ready)) for low in lows]
                    columns = [pa.array([row] * len(lows)), pa.array([low // chunk for low in lows], pa.int32()), pa.array([low - a for low, a in zip(lows, begins)], pa.int64()), pa.array([b - a for a, b in zip(begins, ends)], pa.int64()), pa.array([doc_id] * len(lows), pa.int64()), pa.array([ready[a : b + v.longest] for a, b in zip(begins, ends)])]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "at", "low", "high", "doc_id", "body"])

    return run


def _edges(flat) -> Edges:
    return list(zip(*[iter(map(int, flat))] * 4))


def _matrices(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for batch in batches:
            flat = [[x for edge in v.matrix(r["body"], r["low"], r["high"]) for x in edge] for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("at"), pa.array(flat, pa.list_(pa.int32()))], ["row", "at", "edges"])

    return run


def _by_product(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple]]:
    """Rows (row, up, ...) of one product after the other, from batches sorted by these."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(columns))):
            if held and r[:2] != held[0][:2]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _rows(columns, kind: str) -> pa.RecordBatch:
    row, at, flat = columns
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(at, pa.int32()), pa.array(flat, pa.list_(pa.int32()))], ["row", "at", kind])


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, up, at, edges) to one matrix of up to FAN consecutive ones."""
    for group in _by_product(batches, 4):
        flat = [x for edge in reduce(combined, (_edges(r[3]) for r in group)) for x in edge]
        yield _rows(([group[0][0]], [group[0][1]], [flat]), "edges")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry and exit state of whole texts."""
    for batch in batches:
        found = [states_on_path([_edges(e)]) for e in batch.column("edges").to_pylist()]
        yield _rows((batch.column("row").to_pylist(), batch.column("at").to_pylist(), [[*a, *b] for a, b in found]), "states")


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, up, at, edges, states of the product) to the entry and exit state of each factor."""
    for group in _by_product(batches, 5):
        outer = group[0][4]
        found = states_on_path([_edges(r[3]) for r in group], tuple(outer[:2]), tuple(outer[2:]))
        yield _rows(([r[0] for r in group], [r[2] for r in group], [[*a, *b] for a, b in zip(found, found[1:])]), "states")


def _states(matrices: DataFrame, fan: int) -> DataFrame:
    """row, at and states (entry, exit) of each chunk: products in a tree upwards, states of factors downwards."""
    levels, up = [matrices], F.floor(F.col("at") / fan).cast("int")
    most = matrices.agg(F.max("at")).first()[0] or 0

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.repartition("row", "up").sortWithinPartitions("row", "up", "at")

    while most:
        levels.append(dealt(levels[-1].select("row", up.alias("up"), "at", "edges")).mapInArrow(_product, "row string, at int, edges array<int>"))
        most //= fan
    states = levels.pop().mapInArrow(_whole, "row string, at int, states array<int>")
    while levels:
        joined = levels.pop().withColumn("up", up).join(states.withColumnRenamed("at", "up"), ["row", "up"])
        states = dealt(joined.select("row", "up", "at", "edges", "states")).mapInArrow(_factors, "row string, at int, states array<int>")
    return states


def _traces(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for batch in batches:
            ids, same = [], []
            for r in batch.to_pylist():
                text, low, high, states = r["body"], r["low"], r["high"], r["states"]
                found = v.trace(text, low, high, tuple(states[:2]), tuple(states[2:]))
                ids.append(found)
                # tokens stand for whole characters, so a text decodes if the stretch of each chunk does
                shown = b"".join(map(v.shown.__getitem__, found)).decode("utf-8", "replace")
                same.append(shown == text[low + states[1] : max(low + states[1], high + states[3])].replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("at"), batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["row", "at", "doc_id", "ids", "same"])

    return run


def _encode_long(docs: DataFrame, shared, chunk: int) -> DataFrame:
    """doc_id, ids and round_trip of long texts: chunks are dealt out over all executors."""
    # repeated rows of one text share a key, and each still has its row in the end
    named = docs.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("text", 256)).alias("row"), "doc_id", "text")
    chunks = named.mapInArrow(_chunker(shared, chunk), _CHUNK).dropDuplicates(["row", "at"])
    matrices = checkpointed(chunks.mapInArrow(_matrices(shared), "row string, at int, edges array<int>"))
    traced = chunks.join(_states(matrices, FAN), ["row", "at"]).mapInArrow(_traces(shared), "row string, at int, doc_id bigint, ids array<int>, same boolean")
    whole = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"), F.min("same").alias("round_trip"))
    copies = named.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return whole.join(copies, "row").select("doc_id", "ids", "round_trip", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def encode(docs: DataFrame, model: bytes, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip (whether decoding gives the text back) of every document."""
    v = Vocabulary(model)
    if chunk_chars < 2 * v.longest:
        raise ValueError("chunks must be longer than two pieces")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select("doc_id", "text")
    long = F.char_length(F.coalesce("text", F.lit(""))) >= chunk_chars
    short = frame.where(~long).mapInArrow(_encode_short(shared), "doc_id bigint, ids array<int>, round_trip boolean")
    both = short.unionAll(_encode_long(frame.where(long), shared, chunk_chars))
    return both.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "round_trip")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded with `text` from `ids`; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in encoded.columns if c != "text"]
    frame = encoded.select(*(f"`{c}`" for c in rest))
    at = rest.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for batch in batches:
            texts = [v.decode(i.as_py() or []) for i in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{schema}, text string")
