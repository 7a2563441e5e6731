"""Quality classification from weak labels.

Heuristic labellers vote good (1), bad (0) or abstain on every document. An
expectation-maximisation over all documents' vote patterns estimates how often
each labeller is right in either class and how common the classes are; the
posterior labels of a bounded sample train a hashed linear scorer, which scores
every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import placed
from .textvec import LOWER, SPACE, mix, pieces, prefix_sums, span_hash, words

LABELLERS = ("symbols", "upper", "word_length", "adjacent_repeats", "distinct_words", "stray_marks", "punctuation", "word_shape")
#: Documents that train the scorer at most: those with the least hashes of doc_id and text.
TRAIN_ROWS = 8_000
BITS = 16
#: Documents scoring less are rejected.
KEEP_FROM = 0.5
ABSTAIN = -1

_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ENDING = np.zeros(256, bool)
_ENDING[[33, 34, 39, 41, 44, 46, 58, 59, 63]] = True


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(measures per row, word starts, word ends, words before each row's end)."""
    start, end, bounds = words(data, offsets)
    count = np.maximum(np.diff(bounds), 1)
    size = np.maximum(np.diff(offsets), 1)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return np.diff(sums[offsets])

    def per_word(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return np.diff(sums[bounds])

    space, alpha = SPACE[data], _ALPHA[data]
    letters = np.maximum(per_row(alpha), 1)
    odd = ~(space | alpha | _DIGIT[data] | _ENDING[data])
    sums, inverse = prefix_sums(LOWER[data])
    word = span_hash(sums, inverse, start, end)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    first = bounds[:-1][bounds[:-1] < len(word)]
    again[first] = False
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    order = np.lexsort((word, rows))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    distinct = np.bincount(rows[order][new], minlength=len(offsets) - 1)
    last = data[end - 1] if len(end) else data[:0]
    inside = np.concatenate(([0], np.cumsum(alpha)))
    no_letter = (inside[end] - inside[start]) == 0 if len(end) else np.zeros(0, bool)
    uppers = np.concatenate(([0], np.cumsum(_UPPER[data])))
    all_upper = ((uppers[end] - uppers[start]) == (inside[end] - inside[start])) & ~no_letter & (end - start > 3) if len(end) else no_letter
    tail = _ENDING[last] & (last != 33)
    out = np.stack(
        [
            per_row(odd) / size,
            per_row(_UPPER[data]) / letters,
            per_word(end - start) / count,
            per_word(again) / count,
            distinct / np.sqrt(count),
            per_word(no_letter) / count,
            per_word(tail) / count,
            per_word(all_upper) / count,
            np.diff(bounds),
        ],
        1,
    )
    return out, word, bounds, distinct


def votes(m: np.ndarray) -> np.ndarray:
    """Votes of the labellers (columns as in ``LABELLERS``) from the measures."""

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, ABSTAIN))

    n = m[:, 8]
    some = n >= 8
    out = np.stack(
        [
            vote(m[:, 0] > 0.05, m[:, 0] < 0.02),
            vote(m[:, 1] > 0.3, m[:, 1] < 0.1),
            vote((m[:, 2] < 2.5) | (m[:, 2] > 12), (m[:, 2] > 3.5) & (m[:, 2] < 9)),
            vote(some & (m[:, 3] > 0.1), m[:, 3] < 0.03),
            vote(some & (m[:, 4] < 1.5), some & (m[:, 4] > 2.5)),
            vote(m[:, 5] > 0.1, m[:, 5] < 0.03),
            vote(some & ((m[:, 6] < 0.005) | (m[:, 6] > 0.5)), some & (m[:, 6] > 0.02) & (m[:, 6] < 0.4)),
            vote(m[:, 7] > 0.15, m[:, 7] < 0.03),
        ],
        1,
    )
    out[n == 0] = ABSTAIN
    return out


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over distinct vote patterns: (posterior of good per pattern, accuracy per labeller and class, share of good).

    Each labeller looks for one kind of fault: it may miss most bad documents,
    but calls few good ones bad. So the start doubts a document by its bad votes,
    and that fixes which class is which; labellers are taken to be independent
    given the class.
    """
    cast = patterns != ABSTAIN
    q = np.where((patterns == 0).any(1), 0.1, 0.95)
    right = np.full((patterns.shape[1], 2), 0.8)
    share = 0.5
    for _ in range(rounds):
        w1, w0 = counts * q, counts * (1 - q)
        share = float(np.clip(w1.sum() / max(counts.sum(), 1), 0.01, 0.99))
        for k in range(patterns.shape[1]):
            c = cast[:, k]
            right[k, 1] = (w1[c] @ patterns[c, k] + 1.9) / (w1[c].sum() + 2)
            right[k, 0] = (w0[c] @ (1 - patterns[c, k]) + 1) / (w0[c].sum() + 2)
        right = np.clip(right, (0.02, 0.7), (0.995, 0.999))
        up = np.where(patterns == 1, np.log(right[:, 1]), np.log(1 - right[:, 1]))
        down = np.where(patterns == 0, np.log(right[:, 0]), np.log(1 - right[:, 0]))
        logit = np.log(share / (1 - share)) + (np.where(cast, up - down, 0)).sum(1)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, right, share


def hashed(m: np.ndarray, word: np.ndarray, bounds: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each row: its words' shares, and its measures in buckets."""
    mask = np.uint64((1 << bits) - 1)
    scale = np.array([40, 10, 1, 20, 2, 20, 20, 20, 0])
    buckets = np.minimum((m * scale).astype(np.int64), 20)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        index, count = np.unique((mix(word[a:b]) & mask).astype(np.int64), return_counts=True)
        own = mix((np.arange(9) * 1000 + buckets[k] + 7).astype(np.uint64)) & mask
        yield np.concatenate((index, own.astype(np.int64))).astype(np.int32), np.concatenate((np.log1p(count) / np.sqrt(max(len(index), 1)), np.ones(9))).astype(np.float32)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, bits: int, epochs: int = 5, rate: float = 0.3) -> np.ndarray:
    """Logistic regression on posterior labels by stochastic gradient steps, in one fixed order."""
    w, g2 = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-2)
    order = np.random.default_rng(1).permutation(len(rows))
    for _ in range(epochs):
        for k in order:
            index, value = rows[k]
            p = 1 / (1 + np.exp(-np.clip(w[index] @ value + w[-1], -30, 30)))
            step = (target[k] - p) * value
            g2[index] += step**2
            w[index] += rate * step / np.sqrt(g2[index])
            w[-1] += 0.01 * (target[k] - p)
    return w


def _voted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch, "text"):
                v = votes(measures(data, offsets)[0]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(v @ 3 ** np.arange(v.shape[1]), pa.int64())], ["pattern"])

    return docs.select("text").mapInArrow(run, "pattern long")


def _features(some: DataFrame, bits: int) -> DataFrame:
    """(h, doc_id, pattern, index, value) of the texts ``some(doc_id, text, h)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch, "text"):
                m, word, bounds, _ = measures(data, offsets)
                index, value = zip(*hashed(m, word, bounds, bits), strict=True)
                ends = pa.array(np.cumsum([0, *map(len, index)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("h").slice(first, last - first), batch.column("doc_id").slice(first, last - first), pa.array((votes(m) + 1) @ 3 ** np.arange(len(LABELLERS)), pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(index))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(value))),
                    ],
                    ["h", "doc_id", "pattern", "index", "value"],
                )

    own = T.StructType(some.select("h", "doc_id").schema.fields)
    return some.select("h", "doc_id", "text").mapInArrow(run, own.add("pattern", "long").add("index", T.ArrayType(T.IntegerType())).add("value", T.ArrayType(T.FloatType())))


def _weights(sample: DataFrame, belief: dict[int, float], share: float, bits: int) -> np.ndarray:
    """The scorer fitted in one task to the bounded ``sample`` in its order; only the weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, target = [], []
        for batch in batches:
            index, value = ([x.values.to_numpy() for x in batch.column(c)] for c in ("index", "value"))
            rows += zip(index, value, strict=True)
            target += [belief.get(p, share) for p in batch.column("pattern").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([fit_scorer(rows, np.array(target), bits).astype(np.float32).tobytes()], pa.binary())], ["weights"])

    found = sample.select("pattern", "index", "value").mapInArrow(run, "weights binary").collect()
    return np.frombuffer(found[0].weights, np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def _unpacked(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def scored(docs: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS, keep_from: float = KEEP_FROM, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, posterior, score, keep), one row per document, then the columns ``carry``.

    ``posterior`` is the label model's belief that the document is good,
    ``score`` the linear scorer's; ``keep`` is score >= ``keep_from``. Vote
    patterns are counted over all documents (there are at most 3^8 of them, and
    only their counts come to the driver). The scorer is one fixed array. Null,
    empty and blank texts have no votes: posterior the share of good documents,
    score 0, not kept. An empty table gives no rows; the same table gives the
    same scores.
    """
    found = _voted(docs).groupBy("pattern").count().orderBy("pattern").collect()
    patterns = _unpacked(np.array([r["pattern"] for r in found], np.int64).reshape(-1))
    counts = np.array([r["count"] for r in found], float)
    q, right, share = fit_labellers(patterns, counts) if len(found) else (np.empty(0), np.full((len(LABELLERS), 2), 0.8), 0.5)
    belief = {int(r["pattern"]): float(p) for r, p in zip(found, q, strict=True)}

    # the least hashes of n rows lie below about train_rows / n; twice that leaves few rows to order
    below = int(min(1.0, 2 * train_rows / max(counts.sum(), 1)) * (1 << 30))
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 34)
    some = docs.where((F.length("text") > 0) & (h <= below)).select("doc_id", "text", h.alias("h"))
    sample = _features(some, bits).orderBy("h", "doc_id").limit(train_rows)
    weights = docs.sparkSession.sparkContext.broadcast(_weights(sample, belief, share, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for first, last, data, offsets in pieces(batch, "text"):
                m, word, bounds, _ = measures(data, offsets)
                pattern = (votes(m) + 1) @ 3 ** np.arange(len(LABELLERS))
                score = np.array([w[i] @ v + w[-1] for i, v in hashed(m, word, bounds, bits)])
                score = np.where(np.diff(bounds) > 0, 1 / (1 + np.exp(-np.clip(score, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first).cast(pa.int64()), pa.array([belief.get(int(x), share) for x in pattern], pa.float64()), pa.array(score, pa.float64()), pa.array(score >= keep_from), *[batch.column(c).slice(first, last - first) for c in carry]],
                    ["doc_id", "posterior", "score", "keep", *carry],
                )

    own = T.StructType().add("doc_id", "long").add("posterior", "double").add("score", "double").add("keep", "boolean")
    return docs.select("doc_id", "text", *carry).mapInArrow(run, T.StructType(own.fields + docs.select(*carry).schema.fields))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the scorer keeps, each row judged by itself.

    Null, empty and blank texts go; rows that repeat, or share a null doc_id, have
    one verdict where their texts are one. The columns are those of ``docs``,
    whatever their names. An empty table stays empty.
    """
    where, *place = placed(docs)
    rejected = scored(where, carry=tuple(place)).where("NOT keep").select(*place)
    return where.join(rejected, place, "left_anti").drop(*place)
