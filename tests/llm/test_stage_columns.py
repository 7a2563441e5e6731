"""Stages keep tables of any column names, files or not, and empty tables."""

import pytest
from pyspark.sql import functions as F

from anamnesis.llm.common import free_names
from anamnesis.llm.decontaminate import decontaminate_stage
from anamnesis.llm.exact_dedup import exact_stage
from anamnesis.llm.jaccard_join import jaccard_stage
from anamnesis.llm.mixing import mix_stage
from anamnesis.llm.quality import quality_stage

PROSE = "The people of the town were glad to see that the old bridge had been built again, and they said so to each other on the way to the market. "
NAMES = ("_metadata", "_row", "_file", "_id", "epoch", "size", "taken", "file", "row", "node", "end", "keep", "mix_epoch", "digest")
STAGES = {"quality": quality_stage, "exact": exact_stage, "jaccard": jaccard_stage, "decontaminate": decontaminate_stage, "mix": mix_stage}


def test_free_names():
    assert free_names(["a", "A_", "b"], "a", "c", "a") == ["a__", "c", "a___"]


@pytest.mark.parametrize("name", STAGES)
def test_clashing_names_and_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([(1, "no such passage is in any of these documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.createDataFrame([(k, PROSE * 3 + f"It was day {k} of {'xyz'[k % 3] * 9}.", "ab"[k % 2]) for k in range(12)], "doc_id long, text string, source string")
    docs = rows.select("*", *[F.lit(n).alias(n) for n in NAMES])
    out = STAGES[name](spark, docs, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.collect()
    assert got and all(r["_metadata"] == "_metadata" and r["size"] == "size" for r in got)
    assert STAGES[name](spark, docs.where("false"), str(tmp_path)).collect() == []
