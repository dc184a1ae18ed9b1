"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

A slice is a run of whole texts whose bytes lie in one uint8 array, with the
offset of each text.  All kernels work on bytes, so no Python string is made
per text or per word.  White space is ASCII (0x20, 0x09-0x0D), as the
operators' contracts define words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: 0 white space, 1 letters, digits and non-ASCII, 2 punctuation and control.
TOKEN_CLASS = np.full(256, 2, np.uint8)
TOKEN_CLASS[0x80:] = 1
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    TOKEN_CLASS[_low:_high] = 1
TOKEN_CLASS[SPACE] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_ROOT_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root and of its inverse up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, root in enumerate((_ROOT, _ROOT_INVERSE)):
            full = np.full(size, root, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    up, down = _powers
    if n > 4 * SLICE_BYTES:  # a giant text: give the memory back afterwards
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows + end) in turn; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def runs(kept: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of kept bytes; runs end with their text."""
    n = len(kept)
    before = np.empty(n, bool)
    before[1:], before[:1] = kept[:-1], False
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    starts = np.flatnonzero(kept & ~before)
    after = np.empty(n, bool)
    after[:-1], after[-1:] = kept[1:], False
    after[inner[inner > 0] - 1] = False
    return starts, np.flatnonzero(kept & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space."""
    return runs(~SPACE[data], offsets)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters or of punctuation."""
    kind = TOKEN_CLASS[data]
    n = len(kind)
    new = np.empty(n, bool)
    new[1:], new[:1] = kind[1:] != kind[:-1], True
    new[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n) if n else starts
    real = kind[starts] > 0
    return starts[real], ends[real]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of each span, equal for equal bytes."""
    n = len(data)
    up, down = _grown(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def code_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same of the code points of each span."""
    up, down = _grown(len(code))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code.astype(np.uint64)) * up[: len(code)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row, within the slice, of each span."""
    return np.searchsorted(offsets, starts, "right") - 1


_STEP = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(64)]


def grams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of consecutive spans of one text, and the index of each gram's first span."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: m] == owner[n - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += mix(hashes[at + k] + _STEP[k]) * _STEP[k]
    return mix(total), at
