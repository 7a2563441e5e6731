"""A corpus pipeline of the training-data operators; each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import discard, staged, table
from anamnesis.llm.decontaminate import decontaminate_stage
from anamnesis.llm.exact_dedup import exact_stage
from anamnesis.llm.jaccard_join import jaccard_stage
from anamnesis.llm.mixing import mix_stage
from anamnesis.llm.quality import quality_stage

STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mix_stage),
]

#: The classifier and the edit matching have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before, collect=True)
    return docs
