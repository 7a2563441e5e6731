"""Where passages stand letter for letter in the versions of their documents, by hashes of windows.

Each text is read once where it stands, by any number of passages. The hashes of all its windows of a power of two
characters come by doubling the width. Two maps of hashed bits, of fixed size, say where a
passage may begin and which windows may be one whole; they say yes too often at worst. What they let through
meets the passages as strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Bits of a map, as a power of two: 8 MB. Characters of text that a task looks at together; a longer text is looked at whole.
BITS, SLAB, ROWS = 26, 1 << 20, 10_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spots_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BITS)).astype(np.int64)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = spots_of(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Slab:
    """Texts, and the documents that they are of, as one array of characters."""

    def __init__(self, documents: list[str], texts: list[str]):
        self.documents, self.texts = documents, texts
        self.sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.names = np.fromiter((int.from_bytes(hashlib.blake2b(d.encode(), digest_size=8).digest(), "little") for d in documents), np.uint64, len(documents))

    def windows(self, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """(width, a hash for each position that a window begins at); windows may cross texts."""
        width, h = 1, mixed(self.codes.astype(np.uint64) + np.uint64(1))
        while width <= longest and len(h):
            yield width, h
            h = mixed(h[:-width] * FACTOR + h[width:])
            width *= 2

    def first(self, h: np.ndarray, width: int) -> np.ndarray:
        return mixed(h + np.uint64(width))

    def whole(self, h: np.ndarray, width: int, at: np.ndarray, of: np.ndarray, length: int) -> np.ndarray:
        """Hashes of ``length`` characters at ``at`` in the texts ``of``, with their documents: two windows cover them."""
        return mixed(mixed(h[at] * FACTOR + h[at + length - width]) * FACTOR + self.names[of] + np.uint64(length))


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Slab]]:
    for batch in batches:
        ids, documents, texts = (batch.column(c).to_pylist() for c in range(3))
        cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // SLAB)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            if b > a:
                yield ids[a:b], Slab(documents[a:b], texts[a:b])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, spot) of passages: their lengths, bits of their beginnings, bits of them whole."""
    for _, slab in _slabs(batches):
        kinds, spots = [np.zeros(len(slab.sizes), np.int64)], [slab.sizes]
        for width, h in slab.windows(int(slab.sizes.max())):
            for length in np.unique(slab.sizes[(slab.sizes >= width) & (slab.sizes < 2 * width)]).tolist():
                of = np.flatnonzero(slab.sizes == length)
                at = slab.starts[of]
                kinds += [np.full(len(of), 1), np.full(len(of), 2)]
                spots += [spots_of(slab.first(h[at], width)), spots_of(slab.whole(h, width, at, of, length))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(spots))], ["kind", "spot"])


def bit_maps(keys: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Maps of the bits ``spot`` of ``keys(kind, spot)`` of the kinds 1 and 2, and the different spots of kind 0."""
    bit = F.when(F.col("kind") > 0, F.col("spot") + 1)
    rows = keys.groupBy("kind", F.coalesce(F.bitmap_bucket_number(bit), "spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    maps, lengths = np.zeros((2, 1 << (BITS - 3)), np.uint8), []
    for kind, bucket, bits in rows.toLocalIterator():
        if kind:
            maps[kind - 1, (bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
        else:
            lengths.append(bucket)
    return maps[0], maps[1], sorted(lengths)


def equal_passages(versions: DataFrame, passages: DataFrame) -> DataFrame:
    """(version_id, start, end): where the passages of its document stand in each version, if not of white space alone.

    ``versions(version_id, document_id, text)``, ``passages(document_id, passage)``, these distinct and none empty.
    """
    document = F.col("document_id").cast("string")
    keys = passages.where(document.isNotNull()).select(F.lit(0).alias("id"), document, "passage").mapInArrow(_keys, "kind long, spot long")
    held = versions.sparkSession.sparkContext.broadcast(bit_maps(keys))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, whole, lengths = held.value
        for ids, slab in _slabs(batches):
            for width, h in slab.windows(lengths[-1] if lengths else 0):
                some = [n for n in lengths if width <= n < 2 * width]
                at = np.flatnonzero(marked(first, slab.first(h, width))) if some else np.empty(0, np.int64)
                of = np.searchsorted(slab.ends, at, "right")
                for length in some:
                    inside = at + length <= slab.ends[of]
                    x, y = at[inside], of[inside]
                    hit = marked(whole, slab.whole(h, width, x, y, length))
                    x, y = (x - slab.starts[y])[hit].tolist(), y[hit].tolist()
                    for k in range(0, len(x), ROWS):
                        rows = [(ids[t], slab.documents[t], a, a + length, p) for a, t in zip(x[k : k + ROWS], y[k : k + ROWS], strict=True) if not (p := slab.texts[t][a : a + length]).isspace()]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    texts = versions.select("version_id", document.alias("document_id"), "text").where("text <> '' AND document_id IS NOT NULL")
    like = texts.select("version_id", "document_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.col("text").alias("passage"))
    out = to_arrow_schema(like.schema)
    hits = texts.mapInArrow(found, like.schema)
    return hits.join(passages.select(document.alias("document_id"), "passage"), ["document_id", "passage"], "left_semi").select("version_id", "start", "end")
