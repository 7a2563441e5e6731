"""Listings of memories: filters, totals by status, and pages of a kept order that are reached by place or by the row before."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.operators.strength import TUNING
from anamnesis.operators.upkeep import prefix_search, status_totals

#: Each order's columns, those that run downwards marked; what has no value comes last in either direction, ids are unique.
SORTS = {
    "created": [("created_at", True), ("memory_id", True)],
    "fade": [("fades_in_days", False), ("memory_id", False)],
    "fade_latest": [("fades_in_days", True), ("memory_id", False)],
    "strength": [("value", True), ("memory_id", False)],
}


@dataclass(frozen=True)
class Listing:
    """What a listing asks for; what is None does not narrow it. ``words`` must all begin a word of the sentence."""

    kind: str | None = None
    words: str | None = None
    entity: int | None = None
    significance: str | None = None
    kept: bool | None = None
    source_kind: str | None = None
    document_id: str | None = None
    session_id: str | None = None
    observed_from: datetime | None = None
    observed_to: datetime | None = None
    phases: tuple[str, ...] | None = None
    fading: str | None = None


def fades(fading: str, tau: float = TUNING.tau) -> Column:
    """Whether a memory with ``value`` and ``fades_in_days`` is faded, fades within a week or a month, later (over_month), or never."""
    days, recallable = F.col("fades_in_days"), F.coalesce(F.col("value") >= tau, F.lit(False))
    found = {"faded": ~recallable, "week": recallable & (days <= 7), "month": recallable & (days <= 30), "over_month": recallable & (days > 30), "never": days.isNull()}
    return F.coalesce(found[fading], F.lit(False))


def listed(memories: DataFrame, asked: Listing, links: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """The memories that every filter but that of status lets through.

    Only the columns that a filter names are read. An entity is met by
    ``links(memory_id, entity_id)`` to it or to what ``entities(entity_id,
    merged_into)`` merged into it.
    """
    rows, significance = memories, F.coalesce("owner_significance", "significance") if asked.significance else None
    for name in ("kind", "source_kind", "document_id", "session_id"):
        if (wanted := getattr(asked, name)) is not None:
            rows = rows.where(F.col(name) == wanted)
    if significance is not None:
        rows = rows.where(significance == asked.significance)
    if asked.kept is not None:
        rows = rows.where(F.coalesce(F.col("owner_significance") == "kept", F.lit(False)) == asked.kept)
    if asked.observed_from is not None:
        rows = rows.where(F.col("observed_at") >= F.lit(asked.observed_from).cast("timestamp"))
    if asked.observed_to is not None:
        rows = rows.where(F.col("observed_at") < F.lit(asked.observed_to).cast("timestamp"))
    if asked.phases is not None:
        rows = rows.where(F.col("phase").isin(*asked.phases))
    if asked.fading is not None:
        rows = rows.where(fades(asked.fading))
    if asked.words is not None and asked.words.strip():
        rows = prefix_search(rows, "content", asked.words)
    if asked.entity is not None:
        members = entities.where((F.col("entity_id") == asked.entity) | (F.col("merged_into") == asked.entity)).select("entity_id")
        rows = rows.join(links.join(members, "entity_id").select("memory_id"), "memory_id", "left_semi")
    return rows


def listed_totals(rows: DataFrame, status: str | None = None) -> DataFrame:
    """(status, memories, total) of ``listed`` rows: counts over every status, and how many the chosen one (None: any) has."""
    return status_totals(rows, F.col("status"), [status] if status else None)


def place(rows: DataFrame, sort: str) -> Column:
    """A row's place in an order as one struct without nulls, the least first."""
    types, parts = dict(rows.dtypes), []
    for i, (name, down) in enumerate(SORTS[sort]):
        at = F.unix_micros(name) if types[name] == "timestamp" else F.col(name)
        parts += [F.col(name).isNull().alias(f"none{i}"), F.coalesce(-at if down else at, F.lit(0)).alias(f"at{i}")]
    return F.struct(*parts)


def write_listing(rows: DataFrame, sort: str, folder: str, parts: int | None = None, per_part: int = 100_000) -> str:
    """Keep ``rows`` in an order, in ranges of about ``per_part`` rows, and a table of the ranges' sizes and last places.

    A page is sorted out of the ranges that it lies in. Without ``parts``, the
    number of ranges, rows are counted first; checkpoint what is dear to compute.
    """
    parts = parts or -(-rows.count() // per_part) or 1
    kept = rows.withColumn("place", place(rows, sort)).repartitionByRange(parts, "place").withColumn("part", F.spark_partition_id())
    kept.where("false").write.mode("overwrite").parquet(f"{folder}/shape")  # an empty listing has no file to tell the columns
    kept.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows")
    written = rows.sparkSession.read.schema(kept.schema).parquet(f"{folder}/rows")
    written.groupBy("part").agg(F.count("*").alias("n"), F.max("place").alias("top")).write.mode("overwrite").parquet(f"{folder}/parts")
    return folder


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    """(part, n, top, before): the kept ranges and how many rows lie before each; one row a range."""
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return spark.read.parquet(f"{folder}/parts").withColumn("before", before)


def _within(spark: SparkSession, folder: str, chosen: list[int]) -> DataFrame:
    shape = spark.read.parquet(f"{folder}/shape").schema
    return spark.read.schema(shape).parquet(f"{folder}/rows").where(F.col("part").isin(*chosen) if chosen else F.lit(False)).drop("part")


def page_at(spark: SparkSession, folder: str, page: int, size: int) -> DataFrame:
    """The page of that number, from 0, and ``number``, a row's place from 1: only the ranges that the page lies in are read."""
    skip = page * size
    found = _ranges(spark, folder).where((F.col("before") + F.col("n") > skip) & (F.col("before") < skip + size)).select("part", "before").collect()
    base = min((r["before"] for r in found), default=0)
    rows = _within(spark, folder, [r["part"] for r in found]).orderBy("place").limit(skip - base + size)
    return rows.withColumn("number", F.row_number().over(W.orderBy("place")) + base).where(F.col("number") > skip)


def page_after(spark: SparkSession, folder: str, size: int, last: Any = None) -> DataFrame:
    """The ``size`` rows that follow the one at ``last`` (a row's ``place``; None: the first page), whatever has gone from before it.

    Read are the range that ``last`` lies in and as many behind it as surely hold a page.
    """
    ranges = _ranges(spark, folder)
    if last is None:
        found = ranges.where(F.col("before") < size).select("part").collect()
        return _within(spark, folder, [r["part"] for r in found]).orderBy("place").limit(size)
    fields = ranges.schema["top"].dataType.fields
    at = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, fields, strict=True)])
    left = ranges.where(F.col("top") > at)
    full = F.min(F.col("before") + F.col("n")).over(W.partitionBy())  # rows up to the end of the first range left
    found = left.withColumn("full", full).where(F.col("before") - F.col("full") < size).select("part").collect()
    return _within(spark, folder, [r["part"] for r in found]).where(F.col("place") > at).orderBy("place").limit(size)
