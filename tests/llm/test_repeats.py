import hashlib
import random

import pytest

from anamnesis.llm.common import located, numbered
from anamnesis.llm.repeats import merged_runs, remove_repeats


def brute(rows, length):
    seen = {}
    for i, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((i, k))
    gone = [bytearray(len((t or "").encode())) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i][k : k + length] = b"\1" * length
    out = []
    for (d, t), g in zip(rows, gone, strict=True):
        b = (t or "").encode()
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((d, len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [100_000, 2])
def test_equals_brute_force(spark, frequent):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(20) for _ in range(6)]
    texts = [None, "", "short", "a" * 39, "a" * 40, "a" * 100, "ab" * 80, text(30) * 3, "\0" * 45, "x\0" * 30]
    for _ in range(60):
        t = text(rng.randint(0, 25))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 30)
            t += p[a : a + rng.randint(30, 90)] + text(rng.randint(0, 6))
        texts.append(t)
    texts += [texts[-1], texts[-2], texts[-2]]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, id int").repartition(5)
    got = sorted((tuple(r) for r in remove_repeats(docs, 40, 12, frequent).collect()), key=str)
    assert got == brute(rows, 40)


def test_merge_gives_order_and_shared_prefixes():
    rng = random.Random(1)
    runs, everything = [], []
    for _ in range(7):
        rows = sorted({bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 12))})
        shared = [0] + [next((k for k in range(6) if a[k] != b[k]), 6) for a, b in zip(rows, rows[1:], strict=False)]
        runs.append((shared[: len(rows)], rows))
        everything += rows
    got = [(runs[r][1][k], known) for r, k, known in merged_runs(runs)]
    assert [t for t, _ in got] == sorted(everything)
    for (a, _), (b, known) in zip(got, got[1:], strict=False):
        assert known == next((k for k in range(6) if a[k] != b[k]), 6)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passage_among_different_texts_and_one_among_equal_ones(spark):
    """A frequent k-gram, by what stands farther off than half a window or by its places, is keyed by grouping."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, page = text(55), text(140)
    rows = [(i, text(30) + passage + text(30)) for i in range(40)]
    rows += [(100 + i, text(3) + page + text(3)) for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 40)
    for frequent in (100_000, 4):
        assert sorted((tuple(r) for r in remove_repeats(docs, 40, 12, frequent).collect()), key=str) == want


def test_rows_are_numbered_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "x")] * 50, "doc_id long, text string").repartition(7)
    for most in (100_000, 0):
        monkeypatch.setattr("anamnesis.llm.common.FILES_BROADCAST", most)
        assert numbered(located(docs)).select("id").distinct().count() == 50
