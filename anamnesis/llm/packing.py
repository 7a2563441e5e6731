"""Packing documents into sequences of a fixed number of tokens by sums of squares.

Every document is tokenised and ended by one id; one that is longer than a sequence
is cut into whole sequences and one shorter piece in front. Pieces are placed from
the longest to the shortest: among the open sequences with room a piece goes to the
gap that leaves the sum of the squared counts of open sequences per gap smallest, and a
new sequence is opened only where none has room. A task knows no more of its open
sequences than a stack per gap, so a place costs one pass over the gaps.

Pieces are dealt by a hash of their place in the input, so groups are of like size
whatever the ids or texts. What a group leaves in sequences that are not nearly full is
dealt again, over ever fewer groups, until one is left; each round holds a small
part of the one before. Rounds are written to the shared folder.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, placed, staged, text_of

ENDING = 0
#: Bits of a sequence's number in its group, and of a group's number in its round.
LOCAL, GROUP = 24, 32
PIECE = "doc_id long, hash long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Tokens:
    """A tokenizer's files: ``path`` defines the ids, ``ranks`` are the same vocabulary for the faster library.

    The two libraries give the same ids for every code point beside letters, digits,
    blanks and marks (a test compares them); where the faster one refuses a text, as
    with a million blanks in a row, the other one reads it. None: ``path`` alone.
    """

    path: str = public_tokenizers.path("byte_bpe_50k.json")
    ranks: str | None = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern: str = public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _plain(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str, ranks: str, pattern: str):
    import tiktoken

    special = {str(t.content): n for n, t in _plain(path).get_added_tokens_decoder().items() if t.special}
    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens=special)


def token_ids(text: str, how: Tokens = Tokens()) -> list[int]:
    """The ids of ``how.path`` without added ones; the string of a special token is that token."""
    if how.ranks:
        try:
            return _fast(how.path, how.ranks, how.pattern).encode(text, allowed_special="all")
        except ValueError:  # its pattern's stack is too small for this text
            pass
    return _plain(how.path).encode(text, add_special_tokens=False).ids


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` tokens: the first may be shorter, all others are full."""
    starts = [0, *range(n % capacity or capacity, n, capacity)]
    return list(zip(starts, [*starts[1:], n], strict=True))


def pieces(docs: DataFrame, capacity: int = 2048, how: Tokens = Tokens(), ids: bool = False) -> DataFrame:
    """(doc_id, hash, piece, start, length, ids_crc32[, ids]), one row per piece of a document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hashes, texts = (batch.column(k) for k in range(3))
            of, held = [], []
            rows: list[list[int]] = [[], [], [], []]
            for i, text in enumerate(texts):
                found = np.array([*token_ids(text.as_py(), how), ENDING], "<u4")
                for k, (a, b) in enumerate(cuts(len(found), capacity)):
                    part = found[a:b]
                    of.append(i)
                    for column, value in zip(rows, (k, a, b - a, zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
                    if ids:
                        held.append(part.astype(np.int32))
            of = pa.array(of, pa.int64())
            out = [names.take(of), hashes.take(of), pa.array(rows[0], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[1:])]
            out += [pa.array(held, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "hash", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    rows, file, row = placed(docs)
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64(file, row).alias("hash"), text_of().alias("text"))
    return rows.mapInArrow(cut, PIECE + ", ids array<int>" * ids)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces given from the longest to the shortest, and each sequence's gap."""
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for k, size in enumerate(lengths.tolist()):
        room = np.flatnonzero(counts[size:])
        if len(room):
            # taking gap g, its count falls and that of g - size grows; what is full is not open and counts nowhere
            change = 2 * (counts[room] - counts[room + size]) + 1 + (room > 0)
            gap = size + int(room[change.argmin()])
            at = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, at = capacity, len(gaps)
            gaps.append(capacity)
        sequence[k], offset[k], gaps[at] = at, capacity - gap, gap - size
        if gap > size:
            counts[gap - size] += 1
            open_at[gap - size].append(at)
    return sequence, offset, np.array(gaps, np.int64)


def _packer(base: int, capacity: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("hash", "ascending"), ("piece", "ascending")])
        sequence, offset, gaps = place(rows.column("length").to_numpy(), capacity)
        rows = rows.drop_columns(["grp"])
        number = base + (key[0].as_py() << LOCAL) + sequence
        for name, values in (("sequence_id", number), ("offset", offset), ("gap", gaps[sequence])):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    return pack


def packed(docs: DataFrame, capacity: int = 2048, how: Tokens = Tokens(), ids: bool = False, pieces_per_group: int = 50_000, slack: int = 64) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one row per piece.

    A null text is empty and has the ending id alone. Rows with null or repeated doc_ids, and repeated rows,
    are documents of their own. A text of any length is cut, and its pieces are dealt
    each by itself. Ties in length go by place in the input. No rows give no rows. Other
    columns are left out whatever their names. Sequences are numbered by round, group
    and place in the group. Sequences with a gap above ``slack`` are packed again as
    long as there is more than one group.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    out_of = PIECE + ", ids array<int>" * ids + ", sequence_id long, offset long, gap long"
    left, done, turn, groups_before = staged(pieces(docs, capacity, how, ids), "packing-pieces"), [], 0, None
    while True:
        groups = max(1, -(-left.count() // pieces_per_group))
        last = groups == 1 or groups_before is not None and groups >= groups_before
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("hash", "piece"), F.lit(groups)))
        packs = staged(dealt.groupBy("grp").applyInArrow(_packer(turn << (LOCAL + GROUP), capacity), out_of), "packing-round")
        discard(left)
        done.append(packs.where("true" if last else F.col("gap") <= slack).select(*columns, "sequence_id", "offset"))
        if last:
            break
        left, turn, groups_before = packs.where(F.col("gap") > slack).drop("sequence_id", "offset", "gap"), turn + 1, groups
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def sequences(packs: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces): the tokens of each sequence of ``packed(..., ids=True)``, in place order."""
    parts = packs.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.size("parts").alias("n_pieces"))
