import random

import pytest

from anamnesis.operators import postings as P
from anamnesis.operators import recall as R
from anamnesis.plans.registry import _checkpoints

SCHEMA = "memory_id long, bank_id long, content string"


def texts(rng, ids):
    words = [f"w{k}" for k in range(60)]
    return [(k, rng.randrange(3), " ".join(["the"] * rng.randrange(4) + rng.choices(words, [1 / (n + 1) for n in range(60)], k=rng.randrange(30)))) for k in ids]


def rows(df):
    return sorted((r.query_id, r.memory_id, r.rank, round(r.score, 8)) for r in df.collect())


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(2)
    found = [(k, k % 3, " ".join(["the", *rng.choices([f"w{n}" for n in range(70)], k=rng.randrange(5))])) for k in range(40)]
    return spark.createDataFrame([*found, (90, 1, ""), (91, 7, "the w1"), (92, 0, "nowhere")], "query_id long, bank_id long, query string")


@pytest.mark.parametrize("k", [1, 5, 100])
def test_index_gives_the_rows_of_a_scan_and_is_updated(spark, tmp_path, asked, k):
    _checkpoints(spark)
    rng = random.Random(k)
    old = texts(rng, range(400)) + [(990, 1, ""), (991, 1, "!!")]
    one = spark.createDataFrame(old, SCHEMA)
    path = P.write_index(one, str(tmp_path / "one"), block=4, part=50)
    assert rows(P.index_top_k(spark, path, asked, k)) == rows(R.bm25_top_k(one, asked, k))
    more = spark.createDataFrame(old + texts(rng, range(400, 480)), SCHEMA)
    assert P.update_index(more, path, str(tmp_path / "unused"), block=4, part=50) == path
    assert rows(P.index_top_k(spark, path, asked, k)) == rows(R.bm25_top_k(more, asked, k))
    other = spark.createDataFrame(old[30:] + texts(rng, range(10, 20)) + [(600, 2, "the the w1")], SCHEMA)
    path = P.update_index(other, path, str(tmp_path / "two"), block=4, part=50)
    assert path == str(tmp_path / "two")
    assert rows(P.index_top_k(spark, path, asked, k)) == rows(R.bm25_top_k(other, asked, k))


def test_common_words_open_few_blocks(spark, tmp_path):
    _checkpoints(spark)
    m = spark.createDataFrame([(k, 0, "the " * (1 + k % 3) + f"name{k % 100} and so on") for k in range(2000)], SCHEMA)
    path = P.write_index(m, str(tmp_path / "names"), block=16)
    asked = spark.createDataFrame([(1, 0, "the name7 and")], "query_id long, bank_id long, query string")
    assert P.candidates(spark, path, asked, 10)[0].count() <= 100
    assert rows(P.index_top_k(spark, path, asked, 10)) == rows(R.bm25_top_k(m, asked, 10))
