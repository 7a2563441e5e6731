"""Access streams: counts per day and per sliding week, and activity windows per bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_counts(accesses: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """(bank_id, start, kind, accesses) of a stream or table with ``accessed_at``; rows later than ``late`` are dropped by a stream."""
    rows = accesses.withWatermark("accessed_at", late)
    at = F.window("accessed_at", length, slide) if slide else F.window("accessed_at", length)
    return rows.groupBy(at.alias("w"), "bank_id", "kind").agg(F.count("*").alias("accesses")).select("bank_id", F.col("w.start").alias("start"), "kind", "accesses")


def stream_bank_activity(turns: DataFrame, late: str = "7 days") -> DataFrame:
    """(bank_id, start, end, turns): a bank's full-speed windows as session windows with a gap of 24 hours."""
    rows = turns.withWatermark("message_at", late)
    return rows.groupBy(F.session_window("message_at", "24 hours").alias("w"), "bank_id").agg(F.count("*").alias("turns")).select("bank_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")
