"""Run reports and labelling material: JSON files to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The parts of a report that are compared number by number, and
# those that are series by day or week.
NUMBERS = (
    "purged_then_re_mentioned", "extraction_lag", "injected_tokens", "injection_usage", "profile_tokens", "call1_input",
    "call2_rate", "restatements", "significance_histogram", "kind_histogram", "llm",
)
SERIES = ("purges_per_day", "fade_outs_per_week", "bands_per_week", "refresh_calls_per_day", "agenda_lines_per_day")
#: Levels of nesting within a part that are walked.
DEPTH = 6
_CANDIDATES = "candidates array<struct<id:string,memory:string,score:double,sentence:string,logit:double,strength:double,rank:int,cited:boolean,taken:string,input:string>>"
MATERIAL = (
    f"version int, recall array<struct<sample:string,at:string,session:string,query:string,rerank_query:string,raw_query:string,{_CANDIDATES.replace(' ', ':', 1)}>>, "
    f"call2 array<struct<sample:string,at:string,chunk:string,ordinal:int,claim:string,{_CANDIDATES.replace(' ', ':', 1)}>>, "
    f"refresh array<struct<sample:string,at:string,model:string,facet:string,facet_index:int,query:string,rerank_query:string,reranked:boolean,{_CANDIDATES.replace(' ', ':', 1)}>>"
)
LABELS = (
    "recall array<struct<query:string,memory:string,relevant:boolean>>, "
    "call2 array<struct<chunk:string,ordinal:int,memory:string,relevant:boolean>>, facet array<struct<query:string,memory:string,relevant:boolean>>"
)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(report, body): one row per JSON file, its parts not yet taken apart."""
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(rows.metadataColumn("_metadata")["file_path"].alias("report"), F.parse_json("value").alias("body"))


def report_numbers(reports: DataFrame) -> DataFrame:
    """(report, path, value): every number of the compared parts by its dotted path.

    Items of a series go by their day or week, of other lists by their place.
    Text, even of digits, booleans and nulls are no numbers.
    """
    spark = reports.sparkSession
    level = spark.sql("SELECT report, p.key AS path, p.value AS value FROM {r}, LATERAL variant_explode(body) AS p", r=reports)
    label = "coalesce(try_variant_get(p.value, '$.day', 'string'), try_variant_get(p.value, '$.week', 'string'))"
    series = spark.sql(f"SELECT report, concat(path, '[', {label}, ']') AS path, p.value AS value FROM {{r}}, LATERAL variant_explode(value) AS p", r=level.where(F.col("path").isin(*SERIES)))
    level = level.where(F.col("path").isin(*NUMBERS)).unionByName(series.where("path IS NOT NULL"))
    step = "SELECT report, CASE WHEN p.key IS NULL THEN concat(path, '[', p.pos, ']') ELSE concat(path, '.', p.key) END AS path, p.value AS value FROM {r}, LATERAL variant_explode(value) AS p"
    found = []
    for _ in range(DEPTH):
        kind = F.schema_of_variant("value")
        found.append(level.where((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")).select("report", "path", F.try_variant_get("value", "$", "double").alias("value")))
        level = spark.sql(step, r=level)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def report_probes(reports: DataFrame) -> DataFrame:
    """(report, id, passed)."""
    items = F.try_variant_get("body", "$.probes", "array<struct<id:string,passed:boolean>>")
    return reports.select("report", F.inline(items)).where("id IS NOT NULL AND passed IS NOT NULL")


def report_fates(reports: DataFrame) -> DataFrame:
    """(report, id, faded, purged) of the memories that a run made."""
    items = F.try_variant_get("body", "$.memories", "array<struct<id:string,faded_at:string,purged_at:string>>")
    rows = reports.select("report", F.inline(items))
    return rows.where("id IS NOT NULL").select("report", "id", F.col("faded_at").isNotNull().alias("faded"), F.col("purged_at").isNotNull().alias("purged"))


def read_material(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Rows of candidates for recall, call2 and refresh, each with its sample's own columns."""
    whole = spark.read.schema(MATERIAL).json(path, multiLine=True)
    out = {}
    for part in ("recall", "call2", "refresh"):
        rows = whole.select(F.inline(part))
        own = [c for c in rows.columns if c != "candidates"]
        out[part] = rows.select(*own, F.inline("candidates"))
    return out


def read_labels(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Rows of labels: recall and facet by query and memory, call2 by chunk, ordinal and memory."""
    whole = spark.read.schema(LABELS).json(path, multiLine=True)
    return {part: whole.select(F.inline(part)) for part in ("recall", "call2", "facet")}
