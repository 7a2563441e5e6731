from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import retrieval as V
from anamnesis.operators import strength as S

BERLIN = "Europe/Berlin"


def at(text):
    return datetime.fromisoformat(text)


def plain_shift(t, unit, zone, n):
    """Hours and minutes by the clock; longer units on the wall, resolved by zoneinfo."""
    t = t.replace(tzinfo=UTC)
    if unit in ("hour", "minute"):
        return (t + n * timedelta(**{unit + "s": 1})).replace(tzinfo=None)
    wall = t.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    if unit == "day":
        wall += timedelta(days=n)
    else:
        months = wall.year * 12 + wall.month - 1 + n * (12 if unit == "year" else 1)
        for day in range(wall.day, 27, -1):
            try:
                wall = wall.replace(year=months // 12, month=months % 12 + 1, day=day)
                break
            except ValueError:
                continue
        else:
            wall = wall.replace(year=months // 12, month=months % 12 + 1)
    return wall.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC).replace(tzinfo=None)


@pytest.mark.parametrize("zone", ["UTC", BERLIN, "Pacific/Auckland"])
def test_shift_over_clock_changes(spark, zone):
    times = ["2024-10-27 00:30", "2024-10-26 23:10", "2024-03-31 00:30", "2024-03-30 01:30", "2024-02-29 12:00", "2024-01-31 23:00", "2024-09-28 13:00", "2023-12-31 23:30"]
    rows = [(at(t), u, n) for t in times for u in ("year", "month", "day", "hour", "minute") for n in (1, -1)]
    df = spark.createDataFrame(rows, "t timestamp, u string, n int")
    for n in (1, -1):
        got = df.where(F.col("n") == n).select("t", "u", S.shift(F.col("t"), F.col("u"), F.lit(zone), n).alias("x")).collect()
        assert [(r.t, r.u, r.x) for r in got] == [(r.t, r.u, plain_shift(r.t, r.u, zone, n)) for r in got]


def test_units_of_hours_are_absolute(spark):
    r = spark.range(1).select(S.unit_end(F.lit("2024-10-27 00:30:00").cast("timestamp"), F.lit("hour"), F.lit(BERLIN)).alias("x")).first()
    assert r.x == at("2024-10-27 01:30")


MEMORIES = "memory_id long, kind string, observed_at timestamp, valid_from timestamp, valid_from_precision string, valid_until timestamp, valid_until_precision string, due_at timestamp, low_confidence boolean, timezone string"


def memory(i, kind, said, start=None, unit="day", until=None, until_unit="day", low=False, zone="UTC"):
    return (i, kind, at(said), start and at(start), unit, until and at(until), until_unit, None, low, zone)


def test_phase_goes_by_when_it_was_said_and_by_units(spark):
    rows = [
        memory(1, "event", "2024-03-15", "2024-03-01", "month"),  # said within the month
        memory(2, "event", "2024-03-20 09:00", "2024-03-20 10:00", "hour"),
        memory(3, "event", "2024-02-01", "2024-03-01", "month"),
        memory(4, "event", "2024-03-20 10:00", "2024-03-20 10:00", "hour"),
        memory(5, "fact", "2024-03-01"),
    ]
    df = spark.createDataFrame(rows, MEMORIES)
    got = {r.memory_id: r.phase for r in V.dated(df, "2024-03-20 10:30:00").collect()}
    assert got == {1: "current", 2: "upcoming", 3: "upcoming", 4: "current", 5: "current"}


def test_range_of_what_happened(spark):
    rows = [
        memory(1, "event", "2024-01-01", "2024-01-05"),
        memory(2, "fact", "2024-01-01", "2024-02-01"),
        memory(3, "state", "2024-01-01"),
        memory(4, "fact", "2024-01-01"),
        memory(5, "event", "2024-01-01", "2024-01-01", "month", low=True),
        memory(6, "event", "2024-01-01", "2024-01-01", "month"),
        memory(7, "state", "2024-01-01", None, until="2024-01-31", until_unit="month"),
        memory(8, "event", "2024-01-01", "2024-02-10 13:00", "hour", low=True),
        memory(9, "task", "2024-01-01", until="2024-02-01 11:00", until_unit="hour", low=True),
        memory(10, "fact", "2024-01-01", None, until="2024-02-01"),
        memory(11, "event", "2024-01-01", "2024-02-05", until="2024-02-03"),  # ends before it begins
        memory(12, "event", "2024-01-01", "2024-02-05", until="2024-02-04"),
    ]
    df = spark.createDataFrame(rows, MEMORIES)
    keep = V.recall_filter(happened=("2024-02-01 12:00:00", "2024-02-10 12:00:00"))
    got = {r.memory_id for r in V.dated(df, "2024-03-01").where(keep).collect()}
    assert got == {2, 3, 5, 7, 8, 9, 10, 11, 12}
    begins, ends = V.happened_span(df)
    windows = df.select("memory_id", F.lit(1).cast("long").alias("bank_id"), begins.alias("begins"), ends.alias("ends"))
    asked = [(1, 1, at("2024-02-01 12:00"), at("2024-02-10 12:00")), (2, 1, None, at("2024-01-06")), (3, 1, at("2024-02-11"), None), (4, 1, None, None), (5, 1, at("2024-02-10"), at("2024-01-01")), (6, 2, None, None)]
    found = V.happened_in(windows, spark.createDataFrame(asked, "query_id long, bank_id long, lo timestamp, hi timestamp")).collect()
    assert len(found) == len({tuple(r) for r in found})
    for q, bank, lo, hi in asked:
        one = V.dated(df, "2024-03-01").where(V.recall_filter(happened=(lo and str(lo), hi and str(hi)))) if lo or hi else df
        assert {r.memory_id for r in found if r.query_id == q} == ({r.memory_id for r in one.collect()} if bank == 1 else set())
