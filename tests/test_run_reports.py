"""Day series by banks' own days, look-ups' tokens, latencies: cases worked out by hand."""

from datetime import date

from pyspark.sql import functions as F

from anamnesis.operators import reports as P


def at(spark, rows, columns):
    names = ["bank_id long", "at string", *[f"{c} long" for c in columns]]
    return spark.createDataFrame(rows, ", ".join(names)).withColumn("at", F.col("at").cast("timestamp"))


def test_day_series(spark):
    banks = spark.createDataFrame([(1, "Europe/Berlin"), (2, None)], "bank_id long, timezone string")
    # Berlin's clocks go forward on March 31: 22:30 UTC is 23:30 the day before, and 00:30 of the next day that night
    sweeps = at(spark, [(1, "2024-03-30 22:30:00", 2, 7), (1, "2024-03-31 22:30:00", 0, 3), (1, "2024-04-01 10:00:00", 4, 5), (1, "2024-04-01 10:00:00", 1, 6), (2, "2024-03-31 22:30:00", 0, 9)], ["purged", "agenda_lines"])
    refreshes = at(spark, [(2, "2024-03-31 22:30:00", 2), (2, "2024-03-31 01:00:00", 1)], ["calls"])
    got = {tuple(r) for r in P.day_series(sweeps, refreshes, banks).collect()}
    d = date
    assert got == {
        ("purges", 1, d(2024, 3, 30), 2), ("purges", 1, d(2024, 4, 1), 5), ("agenda_lines", 1, d(2024, 3, 30), 7),
        ("agenda_lines", 1, d(2024, 4, 1), 6), ("agenda_lines", 2, d(2024, 3, 31), 9), ("refresh_calls", 2, d(2024, 3, 31), 3),
    }


def test_turn_tokens(spark):
    rows = [("a", 10, False, False), ("a", 30, False, True), ("b", 20, None, None), ("c", 99, True, False)]
    df = spark.createDataFrame(rows, "session_id string, tokens long, cron boolean, prefetch_only boolean")
    got = {r["of"]: tuple(r)[1:] for r in P.turn_tokens(df, {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"turns": (3, 60, 2, 20, 20), "cron": (1, 99, 0, None, None)}
    assert P.turn_tokens(df.where("false"), {"p50": 0.5}).count() == 0


def test_latency_summary(spark):
    df = spark.createDataFrame([(1, 5, True), (1, 9, None), (1, 7, True), (2, 4, False)], "level long, value long, reranked boolean")
    got = {r["level"]: (r["samples"], r["max"], round(r["reranked_share"], 6), r["p50"]) for r in P.latency_summary(df, {"p50": 0.5}).collect()}
    assert got == {1: (3, 9, 0.666667, 7), 2: (1, 4, 0.0, 4)}
