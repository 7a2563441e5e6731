import random

import numpy as np
import pytest

from anamnesis.llm.jaccard_join import Similarity, _sketch, jaccard_components


def brute(rows, how):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = how.width
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and how.den * len(sets[i] & sets[j]) >= how.num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def family(rng, size, edits, members):
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    out = []
    for _ in range(members):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("how", [Similarity(3, 9, 10), Similarity(5, 4, 5), Similarity(3, 9, 10, rounds=1)])
def test_equals_brute_force(spark, how):
    rng = random.Random(7)
    texts = [None, "", " \t ", "one", "ONE", "one two", "a b c", "A b\x0bc", "café Éa b", "CAFé Éa b"]
    for size, edits, members in ((60, 3, 12), (200, 6, 25), (30, 1, 5), (120, 12, 20), (12, 1, 6)):
        texts += family(rng, size, edits, members)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} {' '.join(f'q{rng.randrange(999)}' for _ in range(rng.randrange(30)))}" for _ in range(40)]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, node long, sample string")
    got = sorted(tuple(r) for r in jaccard_components(docs, how).collect())
    assert got == brute(rows, how)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(none).collect() == []
    text = "a b c d e f g"
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in jaccard_components(rows).collect()))) == ["(1, 3, 1)", "(1, 3, 1)", "(2, 3, 1)", "(None, 3, None)"]


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(7)
    for n, extra in ((1, 0), (1, 1), (90, 4), (300, 40), (5000, 900)):
        pool = np.unique(rng.integers(0, 2**64, n + extra, np.uint64))
        x, y = np.sort(rng.permutation(pool)[:n]), np.sort(rng.permutation(pool)[:n])
        apart = len(np.setxor1d(x, y))
        bits = sum(int(w).bit_count() for w in (_sketch(x) ^ _sketch(y)).view(np.uint64))
        assert bits <= apart and bits % 2 == apart % 2
        assert not (_sketch(x) ^ _sketch(x)).any()
