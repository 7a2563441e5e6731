"""The kept index is written from counts made where the texts are, and pairs found carry no words of their query."""

from anamnesis.operators import postings as P
from anamnesis.operators import recall as R
from anamnesis.plans.registry import _checkpoints

SCHEMA = "memory_id long, bank_id long, content string"


def test_counts_and_plan(spark, tmp_path):
    _checkpoints(spark)
    m = spark.createDataFrame([(1, 0, "a b a"), (2, 0, ""), (3, 0, None), (4, 1, "B ß"), (5, 0, "a c")], SCHEMA)
    path = P.write_index(m, str(tmp_path / "one"))
    got = {r.memory_id: (r["size"], r.words and sorted(tuple(w) for w in r.words)) for r in spark.read.parquet(f"{path}/texts").collect()}
    assert got == {1: (3, [("a", 2), ("b", 1)]), 2: (0, []), 3: (None, []), 4: (2, [("b", 1), ("ß", 1)]), 5: (2, [("a", 1), ("c", 1)])}
    asked = spark.createDataFrame([(1, 0, "a b"), (2, 1, "ß")], "query_id long, bank_id long, query string")
    found = P.index_top_k(spark, path, asked)
    plain = lambda df: sorted((r.query_id, r.memory_id, r.rank, round(r.score, 8)) for r in df.collect())
    assert plain(found) == plain(R.bm25_top_k(m, asked))
    assert "map_from_entries" not in found._jdf.queryExecution().optimizedPlan().toString()
