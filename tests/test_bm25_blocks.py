"""BM25 of queries as long as texts: in blocks equal to the scan, and no row per pair of a claim and a memory."""

import random

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import recall as R
from anamnesis.operators import reconcile as C


@pytest.mark.parametrize(("words", "queries"), [(4_000_000, 1_000), (60, 3)])
def test_blocks_equal_the_scan(spark, words, queries):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("a b c d e f g Ä zwei x1".split()) for _ in range(rng.randrange(12)))
    rows = [(i, i % 3, text() if i % 11 else "a b") for i in range(150)] + [(150, 0, None), (151, 1, ""), (152, 2, "a" * 9)]
    memories = spark.createDataFrame(rows, "memory_id long, bank_id long, content string")
    heads = memories.where("memory_id % 13 <> 4").select("memory_id", (F.col("memory_id") - F.col("memory_id") % 12 + F.col("memory_id") % 3).alias("head_id"))
    asked = spark.createDataFrame([(q, q % 4, text() if q else None) for q in range(20)], "query_id long, bank_id long, query string")
    said = R.bm25_scores(memories, asked).join(heads, "memory_id").groupBy("query_id", F.col("head_id").alias("memory_id")).agg(F.max("score").alias("score"))
    plain = lambda df: sorted((r.query_id, r.rank, r.memory_id, round(r.score, 9)) for r in df.collect())
    want = plain(R.top_k(said, 4))
    assert len(want) > 40 and plain(R.bm25_best(memories, asked, heads, 4, words, queries)) == want


def test_neighbours_make_no_row_per_pair(spark, monkeypatch):
    """Scores of all pairs of a claim and a memory went through a shuffle, a row per word they share."""

    def never(*_):
        raise AssertionError("scores of all pairs were asked for")

    monkeypatch.setattr(R, "bm25_scores", never)
    m = spark.createDataFrame([(i, 0, f"said {i % 7} again", False, [1.0, float(i)]) for i in range(60)], "memory_id long, bank_id long, content string, retracted boolean, embedding array<double>")
    claims = m.where("memory_id % 20 = 0").select(F.col("memory_id").alias("claim_id"), "bank_id", "content", "embedding", F.lit(True).alias("flagged"))
    got = C.claim_neighbours(claims, m, m.select("memory_id", "bank_id", "embedding"), m.select("memory_id", F.col("memory_id").alias("head_id")), 0.2)
    assert got.count() == 30
