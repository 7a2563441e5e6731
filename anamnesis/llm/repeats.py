"""Removal of long byte strings that occur twice, by distributed suffix sorting.

Only suffixes that can matter are sorted. Every window of ``length`` bytes holds
one anchor: the k-gram with the least hash (the leftmost of equal ones), which
depends on the window's bytes alone, so equal windows have their anchor at the
same place. Suffixes start at anchors whose k-gram occurs twice or more, and
occurs twice together with half of a window's other bytes on one side.

Each task sorts its suffixes into a run and front-codes it: the length of the
prefix shared with the suffix before, and the bytes after it; equal suffixes are
one entry with all their places. Runs are cut at fixed ranges of the order,
exchanged, and merged in each range by a loser tree that compares two suffixes
only behind the prefix they are known to share. The order is that of the
k-gram's hash and then of the bytes, so ranges of the order are even without
sampling.

An entry carries the bytes before its anchor too. Two entries hold a common
window with the anchor at offset j exactly if they share j bytes to the left and
length - j bytes to the right, and both are prefix groups of a sorted order, so
repeated windows come from counting equal pairs of group numbers. Nothing is
decided by hashes, except in the way for very frequent anchors.

An anchor's k-gram with more than ``frequent`` different surroundings, judged over all
the bytes an entry holds, or more than ``frequent * PLACES`` places is not gathered in
one task: each of its windows is keyed by a 128-bit hash and the keys are counted by
grouping, which spreads over all tasks and sums before the shuffle. Before that, rows
are counted and joined by their k-gram in ``SALTS`` parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, located, numbered, staged
from .textvec import mix, pieces, prefix_sums, span_hash

LENGTH = 200
GRAM = 50
#: Different surroundings from which an anchor's windows are counted by grouping.
FREQUENT = 200_000
#: Places that take as much memory as an entry of one surrounding, at least.
PLACES = 25
#: Parts in which the rows of one k-gram are counted and joined.
SALTS = 64
#: Suffixes that a range of the order holds on average.
RANGE_ROWS = 60_000


def _sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    at = np.arange(len(values))
    span = 1
    best = at
    while span * 2 <= width:
        a, b = best[:-span], best[span:]
        best = np.where(values[b] < values[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(values[b] < values[a], b, a)


def _upper(hashed: np.ndarray) -> np.ndarray:
    return hashed >> np.uint64(32)


def anchors_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(position, k-gram hash, hashes to the left and to the right, hash of all around) of a text's anchors.

    A window around an anchor reaches half of its other bytes to the left of
    the k-gram or to the right, so a repeated window has the k-gram with that
    half repeated; where the text ends before, the hash is 0. The two stand in one
    number, the left one above. The last hash is that
    of the bytes that an entry holds, and of how many there are on either side.
    These tell only anchors of one k-gram apart, so 32 bits each are enough.
    """
    sums, inverse = prefix_sums(data)
    start = np.arange(len(data) - gram + 1)
    hashed = span_hash(sums, inverse, start, start + gram)
    at = np.unique(_sliding_first_min(hashed, length - gram + 1))
    half = (length - gram) // 2
    left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    can = at >= half
    left[can] = _upper(span_hash(sums, inverse, at[can] - half, at[can] + gram)) | np.uint64(1)
    can = at + gram + half <= len(data)
    right[can] = _upper(mix(span_hash(sums, inverse, at[can], at[can] + gram + half))) | np.uint64(1)
    first, last = np.maximum(at - (length - gram), 0), np.minimum(at + length, len(data))
    ends = ((at - first) << 32 | (last - at)).astype(np.uint64)
    around = _upper(mix(span_hash(sums, inverse, first, last) ^ mix(ends)))
    return at, hashed[at], left << np.uint64(32) | right, around


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, n_bytes, sha, at, gram, sides, around): one row per text, anchors as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch, "text"):
                at, ends, size, sha = [], [0], [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    text = data[a:b]
                    size.append(len(text))
                    sha.append(hashlib.sha256(text.tobytes()).hexdigest())
                    if len(text) >= length:
                        at.append(anchors_of(text, length, gram))
                    ends.append(ends[-1] + (len(at[-1][0]) if len(text) >= length else 0))
                ends = pa.array(ends, pa.int32())
                flat = [np.concatenate(x) for x in zip(*at, strict=True)] if at else [np.empty(0, np.uint64)] * 4
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.uint32).view(np.int32) if k in (0, 3) else x.view(np.int64))) for k, x in enumerate(flat)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, last - first), pa.array(size, pa.int64()), pa.array(sha), *lists],
                    ["id", "n_bytes", "sha", "at", "gram", "sides", "around"],
                )

    schema = "id long, n_bytes long, sha string, at array<int>, gram array<long>, sides array<long>, around array<int>"
    return docs.select("id", "text").mapInArrow(run, schema)


# -- runs: front coding, exchange and merge ---------------------------------


def _shared_with_before(rows: np.ndarray) -> np.ndarray:
    """For sorted rows of bytes, how many leading bytes each shares with the row before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _front_coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    """(shared prefix lengths as uint16, the bytes after them) of sorted distinct rows."""
    shared = _shared_with_before(rows)
    keep = np.arange(rows.shape[1])[None, :] >= shared[:, None]
    return shared.astype(np.uint16).tobytes(), rows[keep].tobytes()


def _decoded(shared: bytes, rest: bytes, width: int) -> tuple[list[int], list[bytes]]:
    lengths, out, at, before = np.frombuffer(shared, np.uint16).tolist(), [], 0, b""
    for k in lengths:
        before = before[:k] + rest[at : at + width - k]
        at += width - k
        out.append(before)
    return lengths, out


def _common(a: bytes, b: bytes, known: int) -> int:
    """How long the common prefix of two equally long strings is, the first ``known`` bytes being equal."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) if not x else len(a) - (x.bit_length() + 7) // 8


def merged_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs by a loser tree that knows prefixes.

    Yields (run, entry, prefix shared with the entry yielded before). Each run's
    head keeps the length of its common prefix with the last winner. Of two
    heads the one sharing more with it is the smaller, without a look at the
    bytes; only at equal lengths are bytes read, from that length on.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads, known = [0] * leaves, [0] * leaves
    text = [run[1][0] if run[1] else None for run in runs] + [None] * (leaves - len(runs))

    def beats(i: int, j: int) -> bool:
        """Whether head i goes before head j; the loser learns its prefix shared with the winner."""
        a, b = text[i], text[j]
        if b is None:
            return True
        if a is None:
            return False
        if known[i] != known[j]:
            return known[i] > known[j]
        c = _common(a, b, known[i])
        if c == len(a):
            known[max(i, j)] = c
            return i < j
        first = a[c] < b[c]
        known[j if first else i] = c
        return first

    tree = [0] * (2 * leaves)
    winner = [0] * (2 * leaves)
    for k in range(leaves):
        winner[leaves + k] = k
    for k in range(leaves - 1, 0, -1):
        i, j = winner[2 * k], winner[2 * k + 1]
        winner[k], tree[k] = (i, j) if beats(i, j) else (j, i)
    top = winner[1]
    while text[top] is not None:
        yield top, heads[top], known[top]
        heads[top] += 1
        lengths, entries = runs[top]
        if heads[top] < len(entries):
            text[top], known[top] = entries[heads[top]], lengths[heads[top]]
        else:
            text[top] = None
        k, i = (leaves + top) // 2, top
        while k:
            if not beats(i, tree[k]):
                i, tree[k] = tree[k], i
            k //= 2
        top = i


def _run_rows(found: DataFrame, length: int, gram: int, ranges: int) -> DataFrame:
    """Front-coded runs (range, shared, rest, places) of the texts' suffixes, or keys of frequent anchors' windows."""
    left = length - gram
    width = 8 + length + left + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, ats, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, ids, ats, held
            if not held:
                return
            block, doc, at = np.concatenate(rows), np.concatenate(ids), np.concatenate(ats)
            order = np.argsort(np.ascontiguousarray(block).view(f"S{width}").ravel(), kind="stable")
            block, doc, at = block[order], doc[order], at[order]
            new = _shared_with_before(block) < width
            new[:1] = True
            group = np.cumsum(new) - 1
            distinct = block[new]
            bucket = (distinct[:, 0].astype(np.int64) << 16 | distinct[:, 1].astype(np.int64) << 8 | distinct[:, 2]) * ranges >> 24
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=ranges + 1))
            out = {"range": [], "shared": [], "rest": [], "count": [], "ids": [], "ats": []}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                shared, rest = _front_coded(distinct[a:b])
                lo, hi = np.searchsorted(group, (a, b))
                out["range"].append(int(bucket[a]))
                out["shared"].append(shared)
                out["rest"].append(rest)
                out["count"].append(np.bincount(group[lo:hi] - a, minlength=b - a).astype(np.int32).tobytes())
                out["ids"].append(doc[lo:hi].tobytes())
                out["ats"].append(at[lo:hi].tobytes())
            rows, ids, ats, held = [], [], [], 0
            n = len(out["range"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["range"], pa.int64())] + [pa.array(out[k], pa.binary()) for k in ("shared", "rest", "count", "ids", "ats")] + [pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())],
                ["range", "shared", "rest", "count", "ids", "ats", "key", "id", "at", "j"],
            )

        for batch in batches:
            texts = batch.column("text")
            for k, (doc, anchors) in enumerate(zip(batch.column("id").to_pylist(), batch.column("anchors").to_pylist(), strict=True)):
                text = np.frombuffer((texts[k].as_py() or "").encode(), np.uint8)
                at = np.array([a["at"] for a in anchors], np.int64)
                grams = np.array([a["gram"] for a in anchors], np.int64).view(np.uint64)
                often = np.array([a["often"] for a in anchors], bool)
                if often.any():
                    yield from _window_keys(text, doc, at[often], length, gram)
                    at, grams = at[~often], grams[~often]
                if not len(at):
                    continue
                padded = np.concatenate((np.zeros(left, np.uint8), text, np.zeros(length, np.uint8)))
                block = np.empty((len(at), width), np.uint8)
                block[:, :8] = mix(grams).astype(">u8").view(np.uint8).reshape(-1, 8)
                block[:, 8 : 8 + length] = padded[(at + left)[:, None] + np.arange(length)]
                block[:, 8 + length : 8 + length + left] = padded[(at + left - 1)[:, None] - np.arange(left)]
                ends = np.stack((np.minimum(len(text) - at, length), np.minimum(at, left)), 1).astype(">u2")
                block[:, -4:] = ends.view(np.uint8).reshape(-1, 4)
                rows.append(block)
                ids.append(np.full(len(at), doc, np.int64))
                ats.append(at.astype(np.int32))
                held += len(at)
                if held >= RANGE_ROWS:
                    yield from flush()
        yield from flush()

    schema = "range long, shared binary, rest binary, count binary, ids binary, ats binary, key binary, id long, at int, j int"
    return found.mapInArrow(run, schema)


def _window_keys(text: np.ndarray, doc: int, at: np.ndarray, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """One keyed row for every window around the anchors ``at``."""
    whole = text.tobytes()
    starts = sorted({(int(a) - j, int(a)) for a in at for j in range(length - gram + 1) if a >= j and a - j + length <= len(whole)})
    keys = [hashlib.blake2b(whole[s : s + length], digest_size=16).digest() for s, _ in starts]
    n = len(starts)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int64())] + [pa.nulls(n, pa.binary())] * 5 + [pa.array(keys, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array([a for _, a in starts], pa.int32()), pa.array([a - s for s, a in starts], pa.int32())],
        ["range", "shared", "rest", "count", "ids", "ats", "key", "id", "at", "j"],
    )


def _merged_spans(length: int, gram: int):
    """Per range: merge its runs and give (id, start, end) covered around every anchor."""
    left = length - gram
    width = 8 + length + left + 4

    def run(table: pa.Table) -> pa.Table:
        runs, counts, ids, ats = [], [], [], []
        for row in table.select(["shared", "rest", "count", "ids", "ats"]).to_pylist():
            runs.append(_decoded(row["shared"], row["rest"], width))
            counts.append(np.frombuffer(row["count"], np.int32))
            ids.append(np.split(np.frombuffer(row["ids"], np.int64), np.cumsum(counts[-1])[:-1]))
            ats.append(np.split(np.frombuffer(row["ats"], np.int32), np.cumsum(counts[-1])[:-1]))
        entries, shared, places = [], [], []
        for r, k, known in merged_runs(runs):
            if entries and known == width:
                places[-1].append((r, k))
            else:
                entries.append(runs[r][1][k])
                shared.append(known)
                places.append([(r, k)])
        runs.clear()
        rows = np.frombuffer(b"".join(entries), np.uint8).reshape(-1, width)
        entries.clear()
        low, high = _window_range(rows, np.array(shared), np.array([sum(int(counts[r][k]) for r, k in p) for p in places]), length, gram)
        out_id, out_start, out_end = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for e in np.flatnonzero(high >= 0):
            for r, k in places[e]:
                a = ats[r][k].astype(np.int64)
                out_id.append(ids[r][k])
                out_start.append(a - high[e])
                out_end.append(a - low[e] + length)
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in (out_id, out_start, out_end)], ["id", "start", "end"])

    return run


def _window_range(rows: np.ndarray, shared: np.ndarray, copies: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the least and the largest anchor offset of a repeated window, or (length, -1).

    ``rows`` are sorted; prefix groups to the right come from ``shared``, prefix
    groups to the left from sorting the bytes before the anchors.
    """
    n, left = len(rows), length - gram
    right_of = (shared - 8).clip(0, length)
    ends = np.ascontiguousarray(rows[:, -4:]).view(">u2").astype(np.int64)
    before = np.ascontiguousarray(rows[:, 8 + length : 8 + length + left])
    order = np.argsort(before.view(f"S{left}").ravel(), kind="stable")
    left_shared = _shared_with_before(before[order])
    low, high = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    lonely = copies < 2
    for j in range(left + 1):
        fits = (ends[:, 1] >= j) & (ends[:, 0] >= length - j)
        right = np.cumsum(right_of < length - j)
        # a suffix alone in its group to the right cannot share a window
        size = np.bincount(right, minlength=n + 2)
        some = fits & ((size[right] > 1) | ~lonely)
        if not some.any():
            continue
        group = np.empty(n, np.int64)
        group[order] = np.cumsum(left_shared < j) if j else 0
        at = np.flatnonzero(some)
        pair = right[at] * (n + 1) + group[at]
        sort = np.argsort(pair, kind="stable")
        put = pair[sort]
        first = np.flatnonzero(np.diff(put, prepend=put[0] - 1))
        total = np.add.reduceat(copies[at[sort]], first)
        again = np.repeat(total >= 2, np.diff(np.append(first, len(put))))
        hit = at[sort[again]]
        low[hit] = np.minimum(low[hit], j)
        high[hit] = j
    return low, high


# -- the operator ------------------------------------------------------------


def _removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, n_removed, n_spans, kept_sha256) of the texts that lose bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, count, sha = [], [], []
            for text, start, end in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                body = (text or "").encode()
                depth = np.zeros(len(body) + 1, np.int32)
                np.add.at(depth, start, 1)
                np.add.at(depth, end, -1)
                gone = np.cumsum(depth[:-1]) > 0
                size.append(int(gone.sum()))
                count.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
                sha.append(hashlib.sha256(np.frombuffer(body, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], ["id", "n_removed", "n_spans", "kept_sha256"])

    lists = spans.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return docs.join(lists, "id").select("id", "text", "starts", "ends").mapInArrow(run, "id long, n_removed long, n_spans long, kept_sha256 string")


def _salt() -> Column:
    return F.pmod(F.xxhash64("id", "place"), F.lit(SALTS)).cast("int")


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` another row has too; those of one key meet in ``SALTS`` parts only."""
    # a key's parts are the bits of one number: a task counts them in one row per key, which is shuffled once
    counts = rows.withColumn("salt", _salt()).groupBy(key).agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("parts"))
    many = counts.where("n > 1").select(F.col(key).alias("same"), "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    return rows.join(many.where("getbit(parts, part) = 1").select("same", "part"), (F.col(key) == F.col("same")) & (_salt() == F.col("part")), "left_semi")


def repeated_spans(docs: DataFrame, anchors: DataFrame, ids: DataFrame, length: int = LENGTH, gram: int = GRAM, frequent: int = FREQUENT, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(id, start, end) byte spans covered by repeated windows; they may overlap.

    Only anchors of the texts in ``ids(id)`` count. ``spent`` are staged tables
    that only ``anchors`` reads; they are used up.
    """
    each = anchors.select("id", F.explode(F.arrays_zip("at", "gram", "sides", "around")).alias("a")).select("id", "a.*")
    # rows are shuffled in few bytes: place is the hash of all around, and below it the position
    each = each.select("id", F.expr("shiftleft(bigint(around), 32) | at").alias("place"), "gram", "sides")
    again = staged(_repeated(each, "gram").join(ids, "id", "left_semi"), "repeats-again")
    del anchors, each
    discard(*spent, collect=True)
    sides = [F.when(side != 0, F.xxhash64("gram", side, F.lit(k))) for k, side in enumerate((F.shiftrightunsigned("sides", 32), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF))))]
    keyed = again.select("id", "place", "gram", F.explode(F.array(*sides)).alias("key")).where("key IS NOT NULL")
    keyed = staged(_repeated(keyed, "key").select("id", "place", "gram").distinct(), "repeats-keyed")
    discard(again, collect=True)
    # equal surroundings are one entry of a run, with its places
    kinds = keyed.groupBy("gram", F.shiftright("place", 32).alias("around")).agg(F.count("*").alias("n"))
    often = kinds.groupBy("gram").agg(F.count("*").alias("f"), F.sum("n").alias("n")).where((F.col("f") > frequent) | (F.col("n") > frequent * PLACES))
    often = often.select("gram", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("often"))
    again = keyed.withColumn("salt", _salt()).join(often, ["gram", "salt"], "left")
    again = again.select("id", F.struct(F.expr("int(place & 2147483647)").alias("at"), "gram", F.coalesce("often", F.lit(False)).alias("often")).alias("a"))
    found = staged(again.groupBy("id").agg(F.collect_list("a").alias("anchors")), "repeats-anchors")
    del again, kinds, often
    discard(keyed, collect=True)
    total = found.agg(F.sum(F.size("anchors"))).first()[0] or 0
    ranges = max(1, -(-total // RANGE_ROWS))
    runs = staged(_run_rows(docs.join(found, "id").select("id", "text", "anchors"), length, gram, ranges), "repeats-runs")
    discard(found, collect=True)
    merged = runs.where("range IS NOT NULL").groupBy("range").applyInArrow(_merged_spans(length, gram), "id long, start long, end long")
    windows = runs.where("key IS NOT NULL").select("key", "id", "at", "j")
    twice = windows.select("key", "id", (F.col("at") - F.col("j")).alias("start")).distinct().groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    hot = windows.join(twice, "key").groupBy("id", "at").agg(F.min("j").alias("low"), F.max("j").alias("high"))
    hot = hot.select("id", (F.col("at") - F.col("high")).cast("long").alias("start"), (F.col("at") - F.col("low") + length).cast("long").alias("end"))
    spans = staged(merged.unionByName(hot), "repeats-spans")
    del merged, windows, twice, hot
    discard(runs, collect=True)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per document.

    A text is its UTF-8 bytes, null counting as empty. Every byte is removed
    that is covered by a string of ``length`` bytes which starts anywhere else
    too, in another text or the same; overlaps count and all strings are judged
    on the input. Texts shorter than ``length`` lose nothing; of equal texts of
    ``length`` bytes or more all bytes go in every copy. Rows are told apart by
    their place in the input files, so repeated rows and null or repeated ids
    are texts of their own. An empty table gives no rows.
    """
    rows = numbered(located(docs.select("doc_id", "text"))).select("doc_id", "text", "id")
    texts = staged(_anchor_rows(rows, length, gram), "repeats-texts")
    sha = staged(texts.select("id", "n_bytes", "sha"), "repeats-digests")
    # equal texts: one of them stands for all in the sorting
    first = sha.where(F.col("n_bytes") >= length).groupBy("sha", "n_bytes").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    unique = first.where("copies = 1").select("id")
    anchors = texts.select("id", "at", "gram", "sides", "around")
    spans = repeated_spans(rows, anchors, first.select("id"), length, gram, frequent, (texts,))
    removed = staged(_removed(rows, spans.join(unique, "id", "left_semi")), "repeats-removed")
    del anchors
    discard(spans, collect=True)
    copied = first.where("copies > 1").select("sha", F.col("copies"))
    out = rows.select("doc_id", "id").join(sha.select("id", "n_bytes", "sha"), "id").join(removed, "id", "left").join(copied, "sha", "left")
    gone = F.col("copies").isNotNull()
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
