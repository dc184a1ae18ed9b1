"""N-gram Jaccard join (7): pivots, Voronoi regions, boundary windows, recursion.

Documents are sets of word shingles under the metric 1 - Jaccard, with a radius
r = 0.2.  Nearly all documents of a corpus are at distance 1 from each other, and so
from any pivot that is a document: there, regions of such pivots would have to hold
everything.  So the first pivots are the sets of one shingle: a document is nearest
to the pivots in it and at 1 from all others, ties going to the rarer pivot.  Two
sets within r share 80 of 100 shingles of either, so a document that is replicated
to its nearest 20 of 100 pivots + 1 meets every partner in a region.  This first
level is a prefix filter.  Within a region sizes are sorted, and a size ratio under
0.8 cuts it.  Two documents within r share not one but a number of pivots of both
windows that follows from their sizes; pairs that share fewer are left out, exactly.
In a large region pairs are not listed.  Its documents bring a sketch, which has a bit
for about every shingle: the parity of the shingles that fall on it.  Sets that differ in
d shingles have sketches that differ in d bits at most, so pairs whose sketches differ
in more than sets within r can are left out, exactly; of the others come as many as
connect them.

What is left forms groups of documents that have much in common, and there distances
differ.  A group of more than a block is
divided by document pivots: distances to all of them are computed, each document
is at home in the Voronoi region of the nearest, and replicated to those that are
at most 2 r further, as far as the triangle inequality lets a partner be.  Documents
linked to a pivot are connected by that; in its region they are compared only to
those that are not, if these can be within r.  Regions are divided again until they
fit a block; there whole sets are compared, and only links that connect
components come out.

Rarity comes from a table of counts of fixed size over all documents; any order
of pivots is exact, rare ones first keep regions small.  Equal sets are one
class from the start.  Sets are compared by 64-bit shingle hashes.

Defined results: a null or empty text has 0 shingles and is its own component;
fewer than five words are one shingle; a null doc_id is its own component
(null) and links nothing; repeated rows are returned as often; rows of one doc_id
with different texts each get the component of their own set, and an id that stands
for both sets joins them; an empty table gives an empty one; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from . import textkernel as K
from .common import checkpointed, forget, spread_join, tidied


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80
    #: log2 of the cells of the table of counts (8 bytes each).
    table_bits: int = 18
    #: Regions up to so many documents are listed, pair by pair; in larger ones sketches are compared.
    region: int = 24
    #: Documents of a region whose sketches are compared in one task; of larger ones each two parts go to a task.
    sketched: int = 8192
    #: Documents of a group that are compared in one task; larger groups are divided by pivots.
    block: int = 1024


_BLOCK = 4096


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of the distinct shingles of each text, by owner, then hash."""
    low = K.LOWER[data]
    starts, ends = K.words(low, offsets)
    hashes, owner = K.span_hashes(low, starts, ends), K.owners(starts, offsets)
    found, at = K.grams(hashes, owner, words)
    owners = owner[at]
    count = np.bincount(owner, minlength=len(offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        # a text of fewer words is one shingle, marked by its length
        first = np.searchsorted(owner, few)
        total = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            has = count[few] > k
            total[has] += K.mix(hashes[first[has] + k] + np.uint64(7 * k + 1)) * np.uint64(2 * k + 3)
        found = np.concatenate([found, K.mix(total + count[few].astype(np.uint64))])
        owners = np.concatenate([owners, few])
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])
    return found[new], owners[new]


def _counter(how: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << how.table_bits, np.int64)
        for batch in batches:
            for _, _, data, offsets in K.text_slices(batch.column(0)):
                found, _ = shingles(data, offsets, how.words)
                table += np.bincount((found >> np.uint64(64 - how.table_bits)).astype(np.int64), minlength=len(table))
        blocks = table.reshape(-1, min(_BLOCK, len(table)))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "counts"])

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            new = np.frombuffer(counts.as_buffer(), np.int64)
            total[block] = total[block] + new if block in total else new.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["block", "counts"])


def shingle_counts(docs: DataFrame, how: Join) -> np.ndarray:
    """How many documents have a shingle of each cell: a table of fixed size, added up by blocks."""
    rows = docs.select("text").mapInArrow(_counter(how), "block int, counts binary").repartition("block").mapInArrow(_adder, "block int, counts binary").collect()
    table = np.zeros(1 << how.table_bits, np.int64)
    for r in rows:
        part = np.frombuffer(bytes(r.counts), np.int64)
        table[r.block * len(part) : (r.block + 1) * len(part)] = part
    return table


#: log2 of the bits of the smallest sketch.
_LEAST_SKETCH = 6


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """log2 of the bits of sketches of sets of n: a bit for every shingle at least."""
    return np.maximum(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), _LEAST_SKETCH)


def _sketches(found: np.ndarray, owner: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of each set the parities of its shingles by the last bits of their hashes; the halves of a sketch make, by xor, the next smaller one."""
    bits = np.where(n > 0, 1 << sketch_bits(n), 0)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(bits, out=at[1:])
    place = at[owner] + (K.mix(found).view(np.int64) & (bits[owner] - 1))
    parity = (np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at // 8), pa.py_buffer(np.packbits(parity, bitorder="little"))]).cast(pa.binary())


def _windows(how: Join, table):
    """For each text: size, 128 bits of hash of its set, its window of pivots, rare ones first, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            for first, last, data, offsets in K.text_slices(batch.column(1)):
                rows = last - first
                found, owner = shingles(data, offsets, how.words)
                n = np.bincount(owner, minlength=rows)
                at = np.zeros(rows + 1, np.int64)
                np.cumsum(n, out=at[1:])
                sums = []
                for salt in (0x51, 0xA7):
                    total = np.zeros(len(found) + 1, np.uint64)
                    np.cumsum(K.mix(found + np.uint64(salt)), dtype=np.uint64, out=total[1:])
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                order = np.lexsort((found, counts[(found >> np.uint64(64 - how.table_bits)).astype(np.int64)], owner))
                window = np.where(n > 0, n + (-how.percent * n) // 100 + 1, 0)
                inside = np.arange(len(found)) - at[owner] < window[owner]
                ends = np.zeros(rows + 1, np.int32)
                np.cumsum(window, out=ends[1:])
                pivots = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[order][inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pivots, _sketches(found, owner, n)], ["doc_id", "n", "h1", "h2", "pivots", "sketch"])

    return run


def _regions(how: Join):
    """Rows (pivot, n, doc) sorted by pivot and size to regions: members and sizes, or for large ones a row for each
    member, with the pivot and the least size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        lead = None  # of a large region that may go on: pivot, least and last size

        def emit(cols, whole):
            """Regions of cols; gives back rows of a last region that may go on."""
            nonlocal lead
            pivot, n, doc = cols
            size = len(pivot)
            cut = np.ones(size, bool)
            cut[1:] = (pivot[1:] != pivot[:-1]) | (100 * n[:-1] < how.percent * n[1:])
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], size)
            goes_on = lead is not None and lead[0] == pivot[0] and 100 * lead[2] >= how.percent * n[0]
            members, sizes, rest = [], [], size
            large = []
            wanted = (ends - starts > 1) | (ends == size)
            wanted[0] |= goes_on
            for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist()):
                if (a == 0 and goes_on) or b - a > how.region:
                    least = lead[1] if a == 0 and goes_on else n[a]
                    large.append((pivot[a:b], np.full(b - a, least), doc[a:b], n[a:b]))
                    lead = (pivot[a], least, n[b - 1])
                elif b == size and not whole:
                    rest = a
                elif b - a > 1:
                    members.append(doc[a:b].tolist())
                    sizes.append(n[a:b].tolist())
            made = []
            if members:
                none = pa.nulls(len(members), pa.int64())
                made.append([pa.array(members, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64())), none, none])
            if large:
                pivots, least, docs, ns = (np.concatenate(c) for c in zip(*large))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32)), pa.array(c)) for c in (docs, ns)]
                made.append([*lists, pa.array(pivots), pa.array(least)])
            return [pa.RecordBatch.from_arrays(m, ["members", "sizes", "pivot", "least"]) for m in made], [c[rest:] for c in cols]

        for batch in batches:
            cols = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            if len(cols[0]):
                made, held = emit(cols, False)
                yield from made
        if len(held[0]):
            yield from emit(held, True)[0]

    return run


def _folded(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def alike(n: np.ndarray, side: np.ndarray, sketches: list[bytes], how: Join) -> list[tuple[int, int]]:
    """Pairs whose sketches don't exclude that they are linked, as many as connect them; sets are sorted by size n, with two sides pairs across."""
    bits = sketch_bits(n)
    across, p = side.min() != side.max(), how.percent
    # at each level the sketches of that size, then larger ones folded, as far as sizes let them be linked
    levels, larger = {}, np.zeros((0, 2 << int(bits[-1] - 6)), np.uint64)
    for level in range(int(bits[-1]), int(bits[0]) - 1, -1):
        a, b = np.searchsorted(bits, [level, level + 1])
        own = np.frombuffer(b"".join(sketches[a:b]), np.uint64).reshape(b - a, 1 << (level - 6))
        larger = np.concatenate([own, _folded(larger[: max(np.searchsorted(n, 100 * (1 << level) // p, "right") - b, 0)])])
        levels[level] = a, larger
    left, out = np.arange(len(n)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            d = queue.pop()
            low, high = np.searchsorted(n[left], [-(-p * n[d] // 100), 100 * n[d] // p + 1])
            others = left[low:high]
            if across:
                others = others[side[others] != side[d]]
            total = n[others] + n[d]
            most = total - 2 * -(-p * total // (100 + p))
            at, found = np.minimum(bits[others], bits[d]), np.zeros(len(others), bool)
            for level in np.unique(at):
                first, rows = levels[level]
                k = np.flatnonzero(at == level)
                found[k] = np.bitwise_count(rows[others[k] - first] ^ rows[d - first]).sum(axis=1, dtype=np.int64) <= most[k]
            if found.any():
                near = others[found]
                out += [(d, int(k)) for k in near]
                queue += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return out


def _sketched(how: Join):
    """Rows (pivot, least, i, j, side, n, doc, sketch) sorted by region, parts and size to edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def edges(rows: pa.Table):
            side, n, doc = (rows.column(k).to_numpy() for k in ("side", "n", "doc"))
            return [(int(doc[a]), int(doc[b])) for a, b in alike(n, side, rows.column("sketch").to_pylist(), how)]

        def emit(rows: pa.Table, cuts):
            out = [e for a, b in zip(cuts, cuts[1:]) if b - a > 1 for e in edges(rows.slice(a, b - a))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"]) if out else None

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(4)])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if last is not None and (last != key[:, 0]).any():
                new = np.append(0, new)
            last = key[:, -1]
            if not len(new):
                held.append(batch)
                continue
            before = sum(b.num_rows for b in held)
            rows = pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
            if made := emit(rows, [0, *(before + new).tolist()] if before or new[0] else (before + new).tolist()):
                yield made
            held = [batch.slice(int(new[-1]))]
        if held and (made := emit(rows := pa.Table.from_batches(held), [0, rows.num_rows])):
            yield made

    return run


def _large_edges(regions: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """Edges (a, b) of large regions: by sketches, as many as connect the pairs that these don't exclude."""
    rows = regions.where("pivot is not null").select("pivot", "least", F.col("members")[0].alias("doc"), F.col("sizes")[0].alias("n"))
    parts = rows.groupBy("pivot", "least").agg(F.ceil(F.count(F.lit(1)) / how.sketched).cast("int").alias("parts")).where("parts > 1")
    dealt = spread_join(rows, parts, ["pivot", "least"], "doc", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("doc"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    sketches = sets.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("doc"), "n", "sketch").hint("merge")
    joined = dealt.join(sketches, ["doc", "n"]).select("pivot", "least", "i", "j", "side", "n", "doc", "sketch")
    keys = ["pivot", "least", "i", "j"]
    return joined.repartition(*keys).sortWithinPartitions(*keys, "n", "doc").mapInArrow(_sketched(how), "a bigint, b bigint")


#: log2 of the bits of a bitmap of ids: 16 an id, from 2**18 to 2**28 (32 MB); beyond 2**28 ids it filters little.
_LEAST_BITS, _MOST_BITS = 18, 28


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _marks(bits: int):
    """The bitmap of a partition's ids, its blocks that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 6), np.int64)
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(table, slot >> 6, np.int64(1) << (slot & 63))
        blocks = table.reshape(-1, _BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[k].tobytes() for k in some], pa.binary())], ["block", "bits"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
            new = np.frombuffer(bits.as_buffer(), np.int64)
            total[block] = total[block] | new if block in total else new.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["block", "bits"])


def _bitmap(ids: DataFrame):
    """The bits and the broadcast bitmap, of bounded size, of a frame's only column."""
    bits = min(max((16 * ids.count()).bit_length(), _LEAST_BITS), _MOST_BITS)
    table, kind = np.zeros(1 << (bits - 6), np.int64), "block int, bits binary"
    for r in ids.mapInArrow(_marks(bits), kind).repartition("block").mapInArrow(_united, kind).toLocalIterator():
        table[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(bytes(r.bits), np.int64)
    return bits, ids.sparkSession.sparkContext.broadcast(table)


def _marked(marks: np.ndarray, ids: pa.Array, bits: int) -> pa.Array:
    slot = _slots(ids.to_numpy(zero_copy_only=False), bits)
    return pa.array((marks[slot >> 6] >> (slot & 63) & 1).astype(bool))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id may be in ids: a bitmap of bounded size keeps most other texts from the join's shuffle."""
    bits, shared = _bitmap(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_marked(shared.value, batch.column(0), bits))

    return docs.mapInArrow(run, "doc_id bigint, text string")


def _apart(frame: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose value of column (not null) is not in ids, for certain, and the others, most of which are: only these need a shuffle."""
    bits, shared = _bitmap(ids)

    @F.arrow_udf("boolean")
    def marked(values: pa.Array) -> pa.Array:
        return _marked(shared.value, values, bits)

    return frame.where(~marked(column)), frame.where(marked(column))


def _links_of(x: list[int], side: list[int], sets: list[np.ndarray], how: Join) -> list[tuple[int, int]]:
    """Links between the sets of a task, as many as connect their components; with two sides, those across."""
    rows = len(x)
    root = list(range(rows))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    across = min(side) != max(side)
    n = [len(s) for s in sets]
    out = []
    if rows <= 48:
        for a in range(rows):
            for b in range(a + 1, rows):
                if (across and side[a] == side[b]) or 100 * min(n[a], n[b]) < how.percent * max(n[a], n[b]) or top(a) == top(b):
                    continue
                small, large = (sets[a], sets[b]) if n[a] <= n[b] else (sets[b], sets[a])
                both = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
                if 100 * both >= how.percent * (n[a] + n[b] - both):
                    root[top(a)] = top(b)
                    out.append((x[a], x[b]))
        return out
    # all pairs at once: products of the incidence matrix, some columns at a time
    owner, found = np.repeat(np.arange(rows), n), np.concatenate(sets)
    _, column, shared = np.unique(found, return_inverse=True, return_counts=True)
    common = shared[column] > 1
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both, width = np.zeros((rows, rows), np.float32), 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((rows, width), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        both += part @ part.T
    size = np.array(n, np.float32)
    linked = 100 * both >= how.percent * (size[:, None] + size[None, :] - both)
    if across:
        sides = np.array(side)
        linked &= sides[:, None] != sides[None, :]
    for a in range(rows):
        for b in np.flatnonzero(linked[a, a + 1 :]) + a + 1:
            if top(a) != top(b):
                root[top(a)] = top(b)
                out.append((x[a], x[int(b)]))
    return out


def _grouped(how: Join):
    """Rows (g, i, j, side, x, text) sorted by group and blocks to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, side, sets = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            sides, ids = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            out = []
            for first, last, data, offsets in K.text_slices(batch.column(5)):
                found, owner = shingles(data, offsets, how.words)
                at = np.searchsorted(owner, np.arange(last - first + 1))
                for k in range(last - first):
                    row = first + k
                    if keys[row] != now:
                        if len(x) > 1:
                            out += _links_of(x, side, sets, how)
                        now, x, side, sets = keys[row], [], [], []
                    x.append(ids[row])
                    side.append(sides[row])
                    sets.append(found[at[k] : at[k + 1]].copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        if len(x) > 1 and (out := _links_of(x, side, sets, how)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def _candidates(regions: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """Edges (a, b): pairs that share as many window pivots as sets within the distance must, and those of large regions.

    Of o common shingles the first t stand within t + size - o places of either
    set, so they are in both windows if t <= window - (size - o).
    """
    listed = regions.where("pivot is null").groupBy("members", "sizes").agg(F.count(F.lit(1)).alias("times"))
    entry = F.arrays_zip(F.col("members").alias("d"), F.col("sizes").alias("n"))
    pairs = F.flatten(F.transform(entry, lambda a, k: F.transform(F.slice(entry, k + 2, F.greatest(F.size(entry) - k - 1, F.lit(0))), lambda b: F.struct(F.least(a["d"], b["d"]).alias("a"), F.greatest(a["d"], b["d"]).alias("b"), F.least(a["n"], b["n"]).alias("low"), F.greatest(a["n"], b["n"]).alias("high")))))
    close = F.filter(pairs, lambda e: 100 * e["low"] >= how.percent * e["high"])
    counted = listed.select("times", F.explode(close).alias("e")).groupBy("e.a", "e.b", "e.low", "e.high").agg(F.sum("times").alias("shared"))
    p = how.percent
    common = F.ceil(F.lit(p) * (F.col("low") + F.col("high")) / (100 + p))
    need = [F.col(n) + F.floor(-p * F.col(n) / 100) + 1 - (F.col(n) - common) for n in ("low", "high")]
    chosen = counted.where(F.col("shared") >= F.least(*need)).select("a", "b")
    return chosen.unionAll(_large_edges(regions, sets, how))


def _distances(how: Join):
    """Rows (g, part, x, lead, text) sorted with each part's pivots first to (g, x, pivot, home, d, linked).

    A member is at home in the region of its nearest pivot.  A partner within the
    radius r of it is at most 2 r further from that pivot than from its own nearest
    one (triangle inequality): so members are replicated to the regions of all pivots
    that are that near.
    """
    window = 2 * (1 - how.percent / 100) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets, index = None, [], [], None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            ids, leads, out = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for first, last, data, offsets in K.text_slices(batch.column(4)):
                found, owner = shingles(data, offsets, how.words)
                at = np.searchsorted(owner, np.arange(last - first + 1))
                for k in range(last - first):
                    row, own = first + k, found[at[k] : at[k + 1]]
                    if keys[row] != now:
                        now, names, sets, index = keys[row], [], [], None
                    if leads[row]:
                        names.append(ids[row])
                        sets.append(own.copy())
                        continue
                    if index is None:
                        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                        order = np.argsort(flat, kind="stable")
                        index = flat[order], of[order], np.array([len(s) for s in sets])
                    flat, of, sizes = index
                    low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
                    n = high - low
                    hits = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                    both = np.bincount(of[hits], minlength=len(sizes))
                    union = len(own) + sizes - both
                    far, linked = 1 - both / union, 100 * both >= how.percent * union
                    home = int(np.argmin(far))
                    out += [(now[0], ids[row], names[j], j == home, float(far[j]), bool(linked[j])) for j in np.flatnonzero(far <= far[home] + window)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["g", "x", "pivot", "home", "d", "linked"])

    return run


def _divided(members: DataFrame, texts: DataFrame, how: Join) -> tuple[DataFrame, DataFrame]:
    """Large groups (g, x, part, n) by new pivots: exact links to pivots, and what is left to compare, as (g, x, part, n, parent).

    part marks members linked to their group's pivot; they are connected already, so
    pivots are drawn from the others.  In a region, members linked to its pivot need
    no comparison with each other, nor with any that is r further from the pivot: they
    stay only where a member that isn't linked is near enough.
    """
    want = F.ceil(2 * F.col("n") / how.block)
    drawn = members.where((~F.col("part")) & (F.pmod(F.xxhash64("x", "g"), F.col("n")) < want)).select("g", "x")
    least = members.where(~F.col("part")).groupBy("g").agg(F.min("x").alias("x"))
    pivots = drawn.unionAll(least).distinct()
    parts = F.ceil(F.col("n") / how.block).cast("int")
    dealt = members.select("g", F.pmod(F.xxhash64("x"), parts).cast("int").alias("part_no"), "x", F.lit(False).alias("lead"))
    leads = pivots.join(members.groupBy("g").agg(F.first("n").alias("n")), "g").select("g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"), "x", F.lit(True).alias("lead"))
    rows = dealt.unionAll(leads).join(texts, "x").select("g", "part_no", "x", "lead", "text").repartition("g", "part_no").sortWithinPartitions("g", "part_no", F.desc("lead"), "x")
    near = checkpointed(rows.mapInArrow(_distances(how), "g bigint, x bigint, pivot bigint, home boolean, d double, linked boolean"))
    links = near.where("linked and x <> pivot").select(F.col("x").alias("a"), F.col("pivot").alias("b"))
    placed = near.join(members.select("g", "x", F.col("part").alias("was_part"), F.col("n").alias("parent")), ["g", "x"])
    placed = placed.withColumn("region", F.xxhash64("g", "pivot"))
    edge = F.min(F.when(~F.col("linked"), F.col("d")))
    stats = placed.groupBy("region").agg(edge.alias("edge"), F.bool_and("was_part").alias("all_part"))
    radius = 1 - how.percent / 100 + 1e-9
    left = spread_join(placed, stats, "region", "x").where(~F.col("all_part") & F.col("edge").isNotNull() & (~F.col("linked") | (F.col("d") >= F.col("edge") - radius)))
    counted = left.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    kept = spread_join(left, counted.where("homes > 0 and n > 1"), "region", "x")
    return links, checkpointed(kept.select(F.col("region").alias("g"), "x", F.col("linked").alias("part"), "n", "parent"))


#: Levels of regions; what is still large then is compared by pairs of blocks.
LEVELS = 8


def _linked(frame: DataFrame, candidates: DataFrame, how: Join) -> DataFrame:
    """Links that connect each component, from the groups of candidates.

    A group larger than a block is divided by pivots, again and again; one that pivots
    don't make a quarter smaller (all its members equally far from each other) goes to
    a task for every two of its blocks.
    """
    groups = checkpointed(graph.components(candidates))
    tidied(frame.sparkSession)
    texts = _texts_of(frame.where("doc_id is not null"), groups.select("node")).withColumnRenamed("doc_id", "x")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = checkpointed(spread_join(groups, sizes, "component", "node").select(F.col("component").alias("g"), F.col("node").alias("x"), F.lit(False).alias("part"), "n"))
    ready, links = members.where(F.col("n") <= how.block), []
    large = members.where(F.col("n") > how.block)
    for _ in range(LEVELS):
        if large.isEmpty():
            break
        found, left = _divided(large, texts, how)
        links.append(found)
        small = F.col("n") <= how.block
        stuck = ~small & (4 * F.col("n") > 3 * F.col("parent"))
        ready = ready.unionAll(left.where(small | stuck).drop("parent"))
        large = left.where(~small & ~stuck).drop("parent")
    ready = ready.unionAll(large)
    blocks = F.ceil(F.col("n") / how.block).cast("int")
    placed = ready.select("g", "x", blocks.alias("k"), F.pmod(F.xxhash64("x"), blocks).cast("int").alias("block"))
    dealt = placed.select("g", "x", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    dealt = dealt.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "x")
    rows = dealt.join(texts, "x").select("g", "i", "j", "side", "x", "text").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "x")
    compared = rows.mapInArrow(_grouped(how), "a bigint, b bigint")
    for found in links:
        compared = compared.unionAll(found)
    return compared


def classes(docs: DataFrame, how: Join = Join()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, h1, h2) of every document, (h1, h2, n, rep, copies) of every class of equal sets, and (a, b) links
    between representatives that connect each component."""
    spark = docs.sparkSession
    frame = docs.select("doc_id", "text")
    table = spark.sparkContext.broadcast(shingle_counts(frame, how))
    sets = checkpointed(frame.mapInArrow(_windows(how, table), "doc_id bigint, n bigint, h1 bigint, h2 bigint, pivots array<bigint>, sketch binary"))
    some, least = "n > 0 and doc_id is not null", F.min("doc_id").alias("rep")
    several = checkpointed(sets.where(some).groupBy("h1", "h2", "n").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("h1").distinct())
    # windows of sets without copies are not gathered by class
    alone, others = _apart(sets.where(some), "h1", several)
    firsts = others.groupBy("h1", "h2", "n").agg(least, F.first("pivots").alias("pivots")).select("n", "rep", "pivots")
    rows = alone.select("n", F.col("doc_id").alias("rep"), "pivots").unionAll(firsts).select(F.explode("pivots").alias("pivot"), "n", F.col("rep").alias("doc"))
    rows = rows.repartition("pivot").sortWithinPartitions("pivot", "n", "doc")
    regions = checkpointed(rows.mapInArrow(_regions(how), "members array<bigint>, sizes array<bigint>, pivot bigint, least bigint"))
    # windows and their shuffle, the most that this stage holds, go before the next one is written
    slim = checkpointed(sets.drop("pivots"))
    forget(sets)
    tidied(spark)
    reps = slim.where(some).groupBy("h1", "h2", "n").agg(least, F.count(F.lit(1)).alias("copies"))
    links = _linked(frame, _candidates(regions, slim, how), how)
    return slim.drop("sketch"), reps, links


def join(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    A class of copies may hold most documents: its component is found first, for the
    class, and then looked up by its documents, dealt out.
    """
    sets, reps, links = classes(docs, how)
    found = checkpointed(graph.components(links))
    tidied(docs.sparkSession)
    several = reps.where("copies > 1").join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("of_class"))
    marked = spread_join(sets, several, ["h1", "h2", "n"], "doc_id", "left")
    alone = F.col("of_class").isNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    # only documents without copies are looked up by themselves; the others are dealt out and meet nothing
    dealt = marked.withColumn("node", F.when(alone, F.col("doc_id"))).withColumn("part", F.when(alone, 0).otherwise(1 + F.pmod(F.xxhash64("doc_id", "h1"), F.lit(256)).cast("int")))
    joined = dealt.join(found.withColumn("part", F.lit(0)).hint("merge"), ["node", "part"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The documents, with all their columns, that are the first of their component.

    A row of a null doc_id is its own component and stays.  Rows that share a doc_id
    and differ in text are judged each by itself: all but one of them come after all
    other documents.  Of those of equal text the least by all its columns stays.
    Only rows of documents that go, or share their doc_id, are shuffled with their texts.
    """
    key = F.xxhash64("doc_id", "text")
    rows, null = docs.where("doc_id is not null"), docs.where("doc_id is null")
    repeated = checkpointed(rows.groupBy("doc_id").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", "low"))
    shared = not repeated.isEmpty()
    own = F.col("doc_id")
    placed = rows.withColumn("_own", own)
    if shared:
        late = key.bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(F.lit(1 << 62))
        single, several = _apart(rows, "doc_id", repeated.select("doc_id"))
        several = several.join(repeated, "doc_id", "left").withColumn("_own", F.when(F.col("low").isNull() | (key == F.col("low")), own).otherwise(late))
        placed = single.withColumn("_own", own).unionAll(several.select(*docs.columns, "_own"))
    found = join(placed.select(F.col("_own").alias("doc_id"), "text"), how)
    gone = checkpointed(found.groupBy(F.col("doc_id").alias("_own")).agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first").select("_own"))
    tidied(docs.sparkSession)
    stay, unsure = _apart(placed, "_own", gone)
    kept = stay.unionAll(unsure.join(gone, "_own", "left_anti").select(stay.columns)).select(docs.columns)
    if not shared:
        return kept.unionAll(null)
    single, several = _apart(kept, "doc_id", repeated.select("doc_id"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.min(F.struct(*others)).alias("row") if others else F.lit(None).alias("row")
    one = several.groupBy("doc_id", "text").agg(row)
    return single.unionAll(one.select(*(c if c in ("doc_id", "text") else F.col(f"row.{c}").alias(c) for c in docs.columns))).unionAll(null)
