import numpy as np
import pytest

from anamnesis.operators import cells as N
from anamnesis.operators import recall as R
from anamnesis.operators import reconcile as C
from anamnesis.plans.registry import _checkpoints


def clustered(rng, n, dims=8, clusters=12):
    centres = rng.normal(size=(clusters, dims)) * 4
    v = (centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * 0.3).astype(np.float32)
    v[5] = 0
    v[11:14] = v[10]
    return v


def frame(spark, v, banks, extra=None):
    rows = [(int(i), int(b), [float(x) for x in e], *([] if extra is None else [int(extra[i])])) for i, (e, b) in enumerate(zip(v, banks, strict=True))]
    rows += [(9000, 1, None, *([] if extra is None else [0])), (9001, 1, [float("nan")] * v.shape[1], *([] if extra is None else [0]))]
    return spark.createDataFrame(rows, "memory_id long, bank_id long, embedding array<float>" + ("" if extra is None else ", at long"))


@pytest.mark.parametrize("k", [1, 10, 700])
def test_cells_give_the_rows_of_a_scan(spark, tmp_path, k):
    _checkpoints(spark)
    rng = np.random.default_rng(4)
    vectors = frame(spark, clustered(rng, 900), rng.integers(0, 3, 900) * rng.integers(0, 2, 900))
    asked = vectors.where("memory_id % 7 = 5 OR memory_id > 8000").withColumnRenamed("memory_id", "query_id")
    N.write_cells(N.cells(vectors, per_cell=20, rows_per_block=100), str(tmp_path / "cells"))
    index = N.read_cells(spark, str(tmp_path / "cells"))
    got = sorted(tuple(r) for r in N.cell_top_k(index, asked, k).collect())
    assert got == sorted(tuple(r) for r in R.vector_top_k(vectors, asked, k).collect()) and got


def test_most_cells_are_not_scored(spark):
    _checkpoints(spark)
    rng = np.random.default_rng(1)
    vectors = frame(spark, clustered(rng, 2000, clusters=40), np.zeros(2000, int))
    index = N.cells(vectors, per_cell=25)
    asked = vectors.where("memory_id % 50 = 0 AND memory_id > 0 AND memory_id < 8000").selectExpr("memory_id AS query_id", "bank_id", "embedding", "0.5D AS reach")
    pairs = N._routed(asked, index.centres, None).join(index.centres.selectExpr("bank_id", "cell", "n"), ["bank_id", "cell"]).agg({"n": "sum"}).first()[0]
    assert pairs < 0.35 * asked.count() * 2000


def test_re_mentioned_counts_created_memories(spark):
    rng = np.random.default_rng(8)
    v, t = clustered(rng, 300), rng.integers(0, 50, 300)
    banks = rng.integers(0, 2, 300)
    u = v / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-12)
    gone, made = np.arange(300) % 3 == 0, np.arange(300) % 3 == 1
    rows = frame(spark, v, banks, t)
    got = C.re_mentioned_rate(rows.where("memory_id % 3 = 1 AND memory_id < 9000").withColumnRenamed("at", "created_at"), rows.where("memory_id % 3 = 0 AND memory_id < 9000").withColumnRenamed("at", "purged_at"), 0.97)
    want = set()
    for b in (0, 1):
        hits = sum(any(gone[p] and banks[p] == b and t[p] < t[c] and round(float(u[p] @ u[c]), 9) >= 0.97 for p in range(300)) for c in range(300) if made[c] and banks[c] == b)
        n = int((gone & (banks == b)).sum())
        want.add((b, n, hits, hits / n))
    assert {tuple(r) for r in got.collect()} == want and any(w[2] for w in want)
    three = spark.createDataFrame([(k, 1, [1.0, 0.0], 5) for k in range(3)], "memory_id long, bank_id long, embedding array<float>, created_at long")
    one = spark.createDataFrame([(9, 1, [1.0, 0.1], 4)], "memory_id long, bank_id long, embedding array<float>, purged_at long")
    assert [tuple(r) for r in C.re_mentioned_rate(three, one, 0.9).collect()] == [(1, 1, 3, 3.0)]


def test_many_versions_take_one_place(spark):
    """151 versions of one memory and twelve others: ten neighbours."""
    rows = [(k, 1, "tea with milk", [1.0, 0.001 * k], False, 150) for k in range(151)] + [(200 + k, 1, "tea", [1.0, 0.3 + 0.01 * k], False, 200 + k) for k in range(12)]
    m = spark.createDataFrame(rows, "memory_id long, bank_id long, content string, embedding array<float>, retracted boolean, head_id long")
    claim = spark.createDataFrame([(1, 1, "tea with milk", [1.0, 0.0], False)], "claim_id long, bank_id long, content string, embedding array<float>, flagged boolean")
    got = C.claim_neighbours(claim, m, m.select("memory_id", "bank_id", "embedding"), m.select("memory_id", "head_id"), 0.5).orderBy("rank").collect()
    assert [r.memory_id for r in got] == [150, *range(200, 209)] and got[0].similarity == 1.0
