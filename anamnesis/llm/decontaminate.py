"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a text with up to ``budget`` edits (a share of its
length). It is split into budget + 1 pieces; an occurrence leaves at least one
piece untouched, so exact piece hits find every candidate. Each candidate is
verified with Myers' bit-parallel edit distance, over growing groups of pieces.

The items come in blocks of bounded size: a block's automaton is all that is sent
to the tasks, and the documents are read once per block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import placed

_OTHER = re.compile(r"[\W_]+")
#: Letters of scripts written without spaces, beside which a word may begin or end anywhere.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass(frozen=True)
class Matching:
    #: Edits allowed, as a share of the item's normalised length.
    rate: float = 0.1
    #: Items whose normalised text is shorter must be found as whole words.
    least_chars: int = 32
    #: Items per block, and characters of items.
    block: int = 20_000
    block_chars: int = 8_000_000


def normalised(text: str | None) -> str:
    """Lower case, every run of other than letters and digits one space."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces_of(pattern: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece) of the budget + 1 pieces."""
    n = int(len(pattern) * rate) + 1
    cuts = [len(pattern) * k // n for k in range(n + 1)]
    return [(a, pattern[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def best_match(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """(distance, end) of the pattern's best occurrence anywhere in ``text``, the first of equals.

    Myers' bit vectors: vertical differences of the edit table's column in two
    integers, one step per character.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, at = size, 0
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up = up << 1 & full
        plus, minus = (down << 1 | ~(diagonal | up)) & full, up & diagonal
        if score < best:
            best, at = score, k + 1
    return best, at


def start_of(pattern: str, text: str, end: int, distance: int) -> int:
    """The last place from which ``text[start:end]`` is that far from the pattern: Myers' vectors backwards from ``end``."""
    size = len(pattern)
    masks, full, top = masks_of(pattern[::-1]), (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    for k, c in enumerate(reversed(text[max(0, end - size - distance) : end]), 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up = (up << 1 | 1) & full  # the match has to reach ``end``
        plus, minus = (down << 1 | ~(diagonal | up)) & full, up & diagonal
        if score == distance:
            return end - k
    return end


def _parted(text: str, at: int) -> bool:
    """Whether a word may begin or end at ``at``."""
    return at in (0, len(text)) or " " in text[at - 1 : at + 1] or bool(_SPACELESS.search(text[at - 1 : at + 1]))


def worded_match(pattern: str, budget: int, text: str, start: int) -> tuple[int, int, int] | None:
    """(distance, end, start) of the best occurrence of whole words that starts within ``budget`` of ``start``.

    The edit table is filled from every place where a word begins; for patterns
    of a few words.
    """
    best = None
    for a in range(max(0, start - budget), min(len(text), start + budget + 1)):
        if text[a] == " " or not _parted(text, a):
            continue
        column = list(range(len(pattern) + 1))
        for e, c in enumerate(text[a : a + len(pattern) + budget], a + 1):
            above, column = column, [e - a]
            for j, x in enumerate(pattern):
                column.append(min(above[j] + (x != c), above[j + 1] + 1, column[j] + 1))
            if column[-1] <= budget and c != " " and _parted(text, e) and (best is None or (column[-1], e, a) < best):
                best = (column[-1], e, a)
    return best


def groups_of(pieces: int) -> list[list[tuple[int, int]]]:
    """For each piece the groups of pieces that hold it, from two pieces up to all.

    All pieces are halved, and halved again down to single ones. A group of m
    pieces may hold m - 1 edits: an occurrence within the budget keeps to that in
    the whole, hence in at least one half of it, and so on down to a piece
    without edits. Going up from a hit, the first group that is too far off ends
    the search, after a look at a few characters.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in range(pieces)]
    todo = [(0, pieces)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            for k in range(a, b):
                out[k].insert(0, (a, b))
            middle = (a + b) // 2
            todo += [(a, middle), (middle, b)]
    return out


class Item:
    """A test item ready to be searched for."""

    def __init__(self, item_id: int, pattern: str, rate: float, worded: bool = False):
        self.worded = worded
        self.item_id, self.pattern, self.budget = item_id, pattern, int(len(pattern) * rate)
        self.pieces = pieces_of(pattern, rate)
        cuts = [a for a, _ in self.pieces] + [len(pattern)]
        spans = {g for piece in groups_of(len(self.pieces)) for g in piece}
        made = {(a, b): (cuts[a], cuts[b] - cuts[a], b - a - 1, masks_of(pattern[cuts[a] : cuts[b]])) for a, b in spans}
        self.above = [[made[g] for g in piece] for piece in groups_of(len(self.pieces))]
        self.beside = [self._beside(k, piece[0] if piece else None, cuts) for k, piece in enumerate(groups_of(len(self.pieces)))]

    def _beside(self, piece: int, group: tuple[int, int] | None, cuts: list[int]) -> list[tuple[int, int, str]]:
        """(from, to, part): the rest of the piece's smallest group in as many parts as the group may hold edits, plus one.

        The piece itself is without edits, so one of the parts stands exactly
        within that many characters of its place.
        """
        if not group:
            return []
        a, b = (cuts[piece + 1], cuts[group[1]]) if piece == group[0] else (cuts[group[0]], cuts[piece])
        edits = group[1] - group[0] - 1
        ends = [a + (b - a) * k // (edits + 1) for k in range(edits + 2)]
        return [(x - edits, y + edits, self.pattern[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def match(self, text: str, start: int, piece: int) -> tuple[int, int, int] | None:
        """(distance, end, start) of the item's best occurrence around a hit of ``piece`` that puts its start at ``start``.

        But for matches of whole words, ``start`` is left as the hit has it.
        """
        if not self.worded and start >= 0 and text.startswith(self.pattern, start):
            return 0, start + len(self.pattern), start
        for a, b, part in self.beside[piece]:
            if part in text[max(0, start + a) : max(0, start + b)]:
                break
        else:
            if self.beside[piece]:
                return None
        found = (0, 0)
        for offset, size, budget, masks in self.above[piece]:
            a = max(0, start + offset - budget)
            found = best_match(masks, size, text[a : start + offset + size + budget])
            if found[0] > budget:
                return None
            found = (found[0], a + found[1])
        if self.worded:
            return worded_match(self.pattern, self.budget, text, start)
        distance, end = found if self.above[piece] else (0, start + len(self.pattern))
        return distance, end, start


def leaks(docs: DataFrame, benchmark: DataFrame, how: Matching = Matching(), carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best occurrence of each item in each text holding it.

    Texts and items are compared in normalised form (``normalised``), whole
    texts always; ``start`` and ``end`` count characters of that form, and
    ``distance`` is at most the item's budget. Null and empty texts hold nothing;
    null items and items without letters and digits are not searched for, and items
    shorter than ``least_chars`` occur only as whole words. Of equal occurrences
    the first counts. Rows repeat where documents or items do. ``carry`` names
    columns of the documents to keep.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // how.block), -(-size[1] // how.block_chars))
    out = None
    for k in range(blocks):
        # a block has about how.block items, whatever the size of the benchmark
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        block = [(r["item_id"], p) for r in rows if (p := normalised(r["text"]))]
        found = _search(docs, spark.sparkContext.broadcast(block), how, carry)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, block, how: Matching, carry: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        items = [Item(i, p, how.rate, len(p) < how.least_chars) for i, p in block.value]
        where: dict[str, list[tuple[int, int, int]]] = {}
        for place, item in enumerate(items):
            for k, (offset, piece) in enumerate(item.pieces):
                where.setdefault(piece, []).append((place, k, offset))
        automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            automaton.add_word(piece, (len(piece), uses))
        automaton.make_automaton()
        for batch in batches:
            out: list[tuple] = []
            rows: list[int] = []
            if items:
                for row, (doc_id, raw) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                    text = normalised(raw.as_py())
                    best: dict[int, tuple[int, int, int]] = {}
                    done: set[tuple[int, int]] = set()  # other hits with the same start find the same
                    for end, (size, uses) in automaton.iter(text):
                        for place, k, offset in uses:
                            at = (place, end + 1 - size - offset)
                            if at not in done and (found := items[place].match(text, at[1], k)):
                                done.add(at)
                                if place not in best or found < best[place]:
                                    best[place] = found
                    for place, (d, end, start) in best.items():
                        item = items[place]
                        out.append((doc_id, item.item_id, d, start if item.worded else start_of(item.pattern, text, end, d), end))
                    rows += [row] * len(best)
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in carry]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], *kept], ["doc_id", "item_id", "distance", "start", "end", *carry])

    own = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "item_id", "distance", "start", "end")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(run, T.StructType(own.fields + docs.select(*carry).schema.fields))


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item occurs, each row judged by itself.

    Null and empty texts hold nothing and stay, as do all rows where the benchmark
    is empty; rows that repeat, or share a null doc_id, go or stay by their own
    text. The columns are those of ``docs``, whatever their names.
    """
    where, *place = placed(docs)
    found = leaks(where, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(place)).select(*place).distinct()
    return where.join(found, place, "left_anti").drop(*place)
