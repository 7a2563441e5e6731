"""Bank clock, chains, strength and phase of memories, for all banks at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400_000_000


@dataclass(frozen=True)
class Tuning:
    """The numeric contract of strength (fixed values)."""

    s: float = 2.5
    tau: float = -0.7
    a: float = 0.35
    c: float = 0.2
    d_max: float = 2.0
    g: float = 0.8
    n0: int = 18
    min_age_days: float = 0.01
    floor_spacing_days: int = 3
    quiet_rate: float = 0.1
    strong: float = 0.3
    purge_margin: float = 0.15
    recently_past_days: int = 30


TUNING = Tuning()
WEIGHTS = {"created": 1.0, "used": 1.0, "mentioned_again": 1.5, "confirmed": 2.0}
SIGNIFICANCE = {"trivial": 0.0, "minor": 0.2, "notable": 0.35, "major": 0.7, "critical": 0.9, "kept": 1.0}
VOLATILITY_DAYS = {"hours": 0.125, "days": 3.0, "weeks": 21.0, "months": 91.31, "years": 1826.2}


def of_map(column: Column, values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


def micros(column: str | Column) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def bank_windows(turns: DataFrame) -> DataFrame:
    """(bank_id, start_us, end_us, full_before_us): unions of [turn, turn + 24 h); touching windows are one.

    Turns of one day are less than 24 hours apart, so a bank's day is one stretch
    from its first turn to its last; the windows run over days, not turns.
    """
    own = W.partitionBy("bank_id").orderBy("start_us")
    at = micros("message_at")
    rows = turns.select("bank_id", at.alias("at")).groupBy("bank_id", F.floor(F.col("at") / DAY).alias("day")).agg(F.min("at").alias("start_us"), F.max("at").alias("last_us"))
    last = F.max("last_us").over(own.rowsBetween(W.unboundedPreceding, -1)) + DAY
    rows = rows.withColumn("island", F.sum(F.when(F.col("start_us") <= last, 0).otherwise(1)).over(own))
    merged = rows.groupBy("bank_id", "island").agg(F.min("start_us").alias("start_us"), (F.max("last_us") + DAY).alias("end_us"))
    before = F.coalesce(F.sum(F.col("end_us") - F.col("start_us")).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return merged.select("bank_id", "start_us", "end_us", before.alias("full_before_us"))


def full_before(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Add ``full_us``, the full-speed time before ``at_us``: an as-of join over days.

    Windows start more than 24 hours apart, so a bank's day has one start at most;
    what a point sees is that one, if it is past, or the last of an earlier day.
    Only the table of a bank's days goes through a window.
    """
    day = F.floor(F.col("at_us") / DAY).alias("_day")
    starts = windows.select("bank_id", F.floor(F.col("start_us") / DAY).alias("_day"), F.struct("start_us", "end_us", "full_before_us").alias("w"))
    days = points.select("bank_id", day).distinct().withColumn("w", F.lit(None).cast(starts.schema["w"].dataType)).unionByName(starts)
    own = W.partitionBy("bank_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.groupBy("bank_id", "_day").agg(F.max("w").alias("w")).withColumn("before", F.last("w", ignorenulls=True).over(own))
    seen = points.withColumn("_day", F.floor(F.col("at_us") / DAY)).join(days, ["bank_id", "_day"])
    w = F.when(F.col("w.start_us") <= F.col("at_us"), F.col("w")).otherwise(F.col("before"))
    seen = seen.withColumn("w", w)
    full = F.col("w.full_before_us") + F.least(F.col("at_us"), F.col("w.end_us")) - F.col("w.start_us")
    return seen.withColumn("full_us", F.coalesce(full, F.lit(0))).drop("w", "before", "_day")


def bank_days(spans: DataFrame, windows: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """Add ``days`` to ``spans(bank_id, from_us, to_us, ..)``: full-speed time and the quiet share of the rest; 0 if the span is empty."""
    at = spans.withColumn("at_us", F.col("from_us"))
    at = full_before(at, windows).withColumnRenamed("full_us", "_full_from").withColumn("at_us", F.col("to_us"))
    full = F.col("full_us") - F.col("_full_from")
    days = (full + tuning.quiet_rate * (F.col("to_us") - F.col("from_us") - full)) / float(DAY)
    return full_before(at, windows).withColumn("days", F.when(F.col("to_us") > F.col("from_us"), days).otherwise(0.0)).drop("at_us", "_full_from", "full_us")


def closure(edges: DataFrame) -> DataFrame:
    """(memory_id, heir): every memory that ``superseded_by`` leads to, one or more steps on.

    Paths double each round, so a chain of n versions takes about log2 n joins;
    pairs already known end a round, which also ends cycles.
    """
    pairs = edges.select("memory_id", F.col("superseded_by").alias("heir")).where("heir IS NOT NULL").distinct().checkpoint()
    size = pairs.count()
    while True:
        steps = pairs.select(F.col("memory_id").alias("heir"), F.col("heir").alias("next"))
        pairs = pairs.union(pairs.join(steps, "heir").select("memory_id", F.col("next").alias("heir"))).distinct().checkpoint()
        grown = pairs.count()
        if grown == size:
            return pairs
        size = grown


def survivors(rows: DataFrame, key: str, to: str, name: str) -> DataFrame:
    """(key, name): where the pointers ``to`` of ``rows(key, to)`` end; a pointer to nothing ends before it.

    Each round every pointer jumps to where its target points, so a chain of n
    takes about log2 n joins of n rows. A row of a cycle has no end and keeps its own key.
    """
    rows = rows.select(key, to)
    ends = rows.where(F.col(to).isNull()).select(F.col(key).alias("at"))
    known = rows.select(F.col(key).alias("at"))
    links = rows.where(F.col(to).isNotNull()).select(key, F.col(to).alias("at"))
    ends = ends.union(links.join(known, "at", "left_anti").select(F.col(key).alias("at"))).distinct()
    open_, done = links.join(known, "at").checkpoint(), None
    left = open_.count()
    while left:
        closed = open_.join(ends, "at", "left_semi").select(key, F.col("at").alias(name))
        done = (closed if done is None else done.union(closed)).checkpoint()
        steps = open_.select(F.col(key).alias("at"), F.col("at").alias("next"))
        ended = done.select(F.col(key).alias("at"), F.col(name).alias("last"))
        going = open_.join(ends, "at", "left_anti").join(steps, "at", "left").join(ended, "at", "left")
        open_ = going.select(key, F.coalesce("last", "next", "at").alias("at")).checkpoint()
        before, left = left, open_.count()
        if left == before:
            break  # cycles
    if done is None:
        return rows.select(key, F.col(key).alias(name))
    return rows.select(key).join(done, key, "left").select(key, F.coalesce(name, key).alias(name))


def chain_heads(memories: DataFrame) -> DataFrame:
    """(memory_id, head_id): the last of each memory's heirs."""
    return survivors(memories, "memory_id", "superseded_by", "head_id")


def chain_members(memories: DataFrame) -> DataFrame:
    """(head_id, memory_id): the whole tree of each chain, the head too."""
    return chain_heads(memories).select("head_id", "memory_id")


def inherited(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Accesses by the memory that counts them: its own and those of all it replaced."""
    heirs = closure(memories).select("memory_id", F.col("heir").alias("counting"))
    own = accesses.withColumn("counting", F.col("memory_id"))
    return own.unionByName(accesses.join(heirs, "memory_id").select(*own.columns))


def occasions(accesses: DataFrame, now: str, tuning: Tuning = TUNING) -> DataFrame:
    """(memory_id, occasions): accesses at least three days after the last one counted."""
    spacing = tuning.floor_spacing_days * DAY
    times = F.array_sort(F.collect_list(micros("accessed_at")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("last"))

    def step(acc, at):
        counted = acc["last"].isNull() | (at - acc["last"] >= spacing)
        return F.struct(F.when(counted, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(counted, at).otherwise(acc["last"]).alias("last"))

    rows = accesses.where(F.col("accessed_at") <= F.lit(now).cast("timestamp")).groupBy("memory_id").agg(times.alias("times"))
    return rows.select("memory_id", F.aggregate("times", zero, step, lambda acc: acc["n"]).cast("long").alias("occasions"))


def recent_use(at_us: np.ndarray, full_us: np.ndarray, weight: np.ndarray, now_us: int, now_full: float, tuning: Tuning = TUNING) -> float:
    """ln of the sum of w * age^-d over accesses in order, -inf without any.

    Each access decays by d = min(d_max, a + c * what was there before it); the
    sum before is taken newest first and left once d is at its cap.
    """
    rate, cap = tuning.quiet_rate, (tuning.d_max - tuning.a) / tuning.c
    clock = (full_us + rate * (at_us - full_us)) / DAY
    now = (now_full + rate * (now_us - now_full)) / DAY
    decay = np.empty(len(at_us))
    for j in range(len(at_us)):
        before, k = 0.0, j
        while k > 0 and before < cap:
            lo = max(0, k - 256)
            before += float((weight[lo:k] * np.maximum(clock[j] - clock[lo:k], tuning.min_age_days) ** -decay[lo:k]).sum())
            k = lo
        decay[j] = min(tuning.d_max, tuning.a + tuning.c * before)
    total = float((weight * np.maximum(now - clock, tuning.min_age_days) ** -decay).sum())
    return float(np.log(total)) if total > 0 else float("-inf")


def _column(rows: DataFrame, name: str, default: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(default)


def closes_at(memories: DataFrame) -> Column:
    """End of the unit of ``valid_until``; of an event without it, of ``valid_from``.

    Units and timezone are those of the columns valid_until_precision,
    valid_from_precision and timezone; without them days and UTC.
    """
    zone = _column(memories, "timezone", "UTC")
    until = unit_end(F.col("valid_until").cast("timestamp"), _column(memories, "valid_until_precision", "day"), zone)
    start = unit_end(F.col("valid_from").cast("timestamp"), _column(memories, "valid_from_precision", "day"), zone)
    return F.coalesce(until, F.when(F.col("kind") == "event", start))


def has_ended(memories: DataFrame, now: Column) -> Column:
    end = unit_end(F.col("valid_until").cast("timestamp"), _column(memories, "valid_until_precision", "day"), _column(memories, "timezone", "UTC"))
    return F.coalesce(end <= now, F.lit(False))


def window_close(memories: DataFrame) -> DataFrame:
    """(memory_id, closes_at, known_at) of the memories whose window closes; known when the memory that ended it was said, else its own."""
    rows = memories.select("memory_id", "ended_by", F.col("observed_at").cast("timestamp").alias("own"), closes_at(memories).alias("closes_at")).where("closes_at IS NOT NULL")
    ends = memories.select(F.col("memory_id").alias("ended_by"), F.col("observed_at").cast("timestamp").alias("said"))
    return rows.join(ends, "ended_by", "left").select("memory_id", "closes_at", F.coalesce("said", "own").alias("known_at"))


def strength(memories: DataFrame, accesses: DataFrame, turns: DataFrame, now: str, tuning: Tuning = TUNING) -> DataFrame:
    """(memory_id, bank_id, occasions, recent_use, lasting, value), one row per memory.

    Accesses after ``now`` are ignored; a memory that counts none has strength
    -infinity. Once a window's close has passed and is known, recent use starts
    over from one access of weight 1 at that time and those after the close; the
    lasting floor goes on counting all. Accesses are dealt out and sorted by
    memory and run through in batches; a memory's list is the unit of the recurrence.
    """
    at, moment = pd.Timestamp(now), F.lit(now).cast("timestamp")
    now_us = int(at.value // 1000)
    close = window_close(memories).withColumn("restart", F.greatest("closes_at", "known_at")).where(F.col("restart") <= moment)
    close = close.select(F.col("memory_id").alias("counting"), micros("closes_at").alias("closes_us"), micros("restart").alias("restart_us"))
    banks = memories.select(F.col("memory_id").alias("counting"), "bank_id").join(close, "counting", "left")
    counted = inherited(memories, accesses).where(F.col("accessed_at") <= moment)
    counted = counted.select("counting", micros("accessed_at").alias("at_us"), of_map(F.col("kind"), WEIGHTS).alias("weight"))
    points = counted.join(banks, "counting").select("bank_id", "counting", "at_us", F.when(F.col("closes_us").isNull() | (F.col("at_us") > F.col("closes_us")), F.col("weight")).otherwise(0.0).alias("weight"), F.lit(True).alias("said"))
    fresh = banks.where("restart_us IS NOT NULL").select("bank_id", "counting", F.col("restart_us").alias("at_us"), F.lit(1.0).alias("weight"), F.lit(False).alias("said"))
    marks = memories.select("bank_id").distinct().select("bank_id", F.lit(None).cast("long").alias("counting"), F.lit(now_us).cast("long").alias("at_us"), F.lit(0.0).alias("weight"), F.lit(False).alias("said"))
    timed = full_before(points.unionByName(fresh).unionByName(marks), bank_windows(turns))
    clock = timed.where("counting IS NULL").select("bank_id", F.col("full_us").alias("now_full"))
    timed = timed.where("counting IS NOT NULL").join(clock, "bank_id").select("counting", "at_us", "full_us", "weight", "said", "now_full")
    spacing = tuning.floor_spacing_days * DAY

    def one(rows: pd.DataFrame) -> tuple[int, float]:
        n, last = 0, None
        for x in rows["at_us"].to_numpy()[rows["said"].to_numpy()]:
            if last is None or x - last >= spacing:
                n, last = n + 1, x
        rows = rows[rows["weight"].to_numpy() > 0]
        if not len(rows):
            return n, float("-inf")
        use = recent_use(rows["at_us"].to_numpy(), rows["full_us"].to_numpy(float), rows["weight"].to_numpy(), now_us, float(rows["now_full"].iloc[0]), tuning)
        return n, use

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the last memory of a batch may go on in the next

        def told(rows: pd.DataFrame) -> pd.DataFrame:
            key = rows["counting"].to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            found = [(key[a], *one(rows.iloc[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pd.DataFrame(found, columns=["counting", "occasions", "recent_use"])

        for b in batches:
            if not len(b):
                continue
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            cut = int(np.searchsorted(rows["counting"].to_numpy() == rows["counting"].iloc[-1], True))
            if cut:
                yield told(rows.iloc[:cut])
            held = rows.iloc[cut:]
        if held is not None:
            yield told(held)

    sorted_ = timed.repartition("counting").sortWithinPartitions("counting", "at_us", F.desc("weight"))
    used = sorted_.mapInPandas(run, "counting long, occasions long, recent_use double")
    sig = of_map(F.coalesce("owner_significance", "significance"), SIGNIFICANCE)
    floor = F.when(F.col("occasions") > 0, tuning.tau - tuning.g * float(np.log(tuning.n0)) + tuning.g * F.log(F.col("occasions").cast("double"))).otherwise(F.lit(float("-inf")))
    rows = memories.select("memory_id", "bank_id", sig.alias("sig")).join(used.withColumnRenamed("counting", "memory_id"), "memory_id", "left").fillna({"occasions": 0})
    recent = F.coalesce("recent_use", F.lit(float("-inf")))
    return rows.select("memory_id", "bank_id", "occasions", recent.alias("recent_use"), (tuning.s * F.col("sig") + floor).alias("lasting"), (tuning.s * F.col("sig") + F.greatest(recent, floor)).alias("value"))


def band(value: Column, tuning: Tuning = TUNING) -> Column:
    return F.when(value > tuning.strong, "strong").when(value >= tuning.tau, "fading").otherwise("faded")


def shift(at: Column, precision: Column, timezone: Column, units: int = 1) -> Column:
    """A time moved by units of its precision: years, months and days by the calendar of its timezone, hours and minutes by the clock.

    A local time that a clock change leaves out is the one as long after the change;
    of one that it gives twice, the first is meant.
    """
    of = lambda name: F.when(precision == name, units).otherwise(0)
    calendar = F.to_utc_timestamp(F.from_utc_timestamp(at, timezone) + F.make_interval(years=of("year"), months=of("month"), days=of("day")), timezone)
    return F.when(precision.isin("hour", "minute"), at + F.make_interval(hours=of("hour"), mins=of("minute"))).otherwise(calendar)


def unit_end(at: Column, precision: Column, timezone: Column) -> Column:
    """End of the unit that a time starts."""
    return shift(at, precision, timezone)


def phase(now: Column, observed: Column, starts: Column, starts_end: Column, closes: Column, due: Column, due_end: Column, is_task: Column, tuning: Tuning = TUNING) -> Column:
    """upcoming, recently_past, long_past, overdue or current, the first that holds.

    Upcoming is what was said before it started, until the unit of its start is over.
    """
    past = F.when(now < closes + F.expr(f"INTERVAL {tuning.recently_past_days * 24} HOURS"), "recently_past").otherwise("long_past")
    return (
        F.when((observed < starts) & (now < starts_end), "upcoming")
        .when(closes <= now, past).when(is_task & (observed < due) & (now >= due_end), "overdue").otherwise("current")
    )


def state_confidence(observed: Column, refreshed: Column, volatility: Column, now: Column) -> Column:
    """1 / (1 + (age / T)^2) in world days since the state was last seen or said; 1 without volatility."""
    since = F.greatest(micros(observed), F.coalesce(micros(refreshed), micros(observed)))
    age = F.greatest(F.lit(0.0), (micros(now) - since) / float(DAY))
    return F.when(volatility.isNull(), F.lit(1.0)).otherwise(1 / (1 + F.pow(age / of_map(volatility, VOLATILITY_DAYS), 2)))
