"""Vectorised work on the bytes of many texts at once (numpy inside tasks).

Texts arrive as Arrow batches; a batch is cut into pieces of a few MB, so the
memory of a task follows the piece (or the longest single text), never the
batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20

_rng = np.random.default_rng(20260101)
_SYMBOL = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes between words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them)."""
    column = pc.cast(pc.fill_null(batch.column(text), ""), pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which ``span_hash`` gets the hash of any span in one step."""
    powers, inverse = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * powers[:-1], out=sums[1:])
    return sums, inverse


def span_hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, wherever the span stands."""
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each row's end) of runs of non-space bytes; no word crosses rows."""
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles.

    Words are lower-cased (A-Z). A row with fewer words has one shingle, all
    its words; a row without words has none.
    """
    data = LOWER[data]
    start, end, bounds = words(data, offsets)
    sums, inverse = prefix_sums(data)
    word = span_hash(sums, inverse, start, end)
    rolled = np.full(max(0, len(word) - width + 1), np.uint64(width), np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(0xD6E8FEB86659FD93) + word[k : k + len(rolled)])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            whole = np.full(1, np.uint64(b - a), np.uint64)
            for k in range(a, b):
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + word[k : k + 1])
            yield whole
        else:
            yield np.empty(0, np.uint64)
