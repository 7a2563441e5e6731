"""Queries against their DuckDB SQL where the smallest tables have no such rows."""

import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from anamnesis.operators import ingest as I
from anamnesis.plans import lifecycle, registry, retrieval
from tests.test_queries_equal_sql import SF, TABLES, bag


def test_cut_falls_behind_a_line_break(spark):
    texts = ["a " * 149 + "b\n" + "rest", "a " * 148 + "b\r\n" + "c" * 9, "a\x0bb" + "c" * 400, "a b\x0bc" + "d" * 400, "a\x85b" * 150, "x" * 297 + " b\x85" + "z" * 50, "a  b" + " " * 400, "\n" * 400, "x" * 300 + "\n"]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {lifecycle._CUT.format(x='t')} FROM (SELECT CAST(? AS VARCHAR) AS t)", [t]).fetchone()[0] for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", I.cut_back(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == want


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_happened_in_takes_no_undated_fact_into_an_open_range(spark, tmp_path):
    for t in TABLES:
        if t not in ("documents", "benchmark"):
            shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS doc_id, 'a' AS text, 'en' AS lang, 's' AS source, 1 AS n_chars FROM range(240) r(i)) TO '{tmp_path}/documents.parquet'")
    # item 51 has no bound, of the facts of its bank 35 and 115 have no date
    con.execute(f"COPY (SELECT i AS item_id, 'a' AS text FROM range(50, 60) r(i)) TO '{tmp_path}/benchmark.parquet'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()["happened_in"])
    want = bag([c[0] for c in want.description], want.fetchall())
    df = retrieval.happened_in(spark, str(tmp_path))
    assert bag(df.columns, df.collect()) == want
    asked = {r.memory_id for r in df.where("query_id = 51").collect()}
    assert 36 in asked and not asked & {35, 115}
