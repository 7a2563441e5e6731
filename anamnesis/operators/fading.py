"""When memories fade, had faded, and may be purged: strength read as a function of time.

Between two breakpoints, accesses or the restart that a window's close brings, a memory counts
the same accesses and its strength only falls with the bank's clock. So the past is read at the
ends of all stretches at once, and only the first that ends below the threshold is halved; the future has
one stretch, or two where a restart is still ahead. Occasions are those of the time that is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.operators import strength as S
from anamnesis.operators.upkeep import NEVER_PURGED_MARGIN, overdue_until

MINUTE, HORIZON = 1 / 1440, 200 * 365.25
ACCESS, RESTART, NOW = 0, 1, 2


def decays(clock: np.ndarray, weight: np.ndarray, tuning: S.Tuning = S.TUNING) -> np.ndarray:
    """Each access's decay, which those before it set."""
    out = np.empty(len(clock))
    for j in range(len(clock)):
        before = weight[:j] @ np.maximum(clock[j] - clock[:j], tuning.min_age_days) ** -out[:j]
        out[j] = min(tuning.d_max, tuning.a + tuning.c * before)
    return out


class Use:
    """Recent use and occasions of a list of accesses in time order, at any reading of the clock."""

    def __init__(self, at: np.ndarray, clock: np.ndarray, weight: np.ndarray, tuning: S.Tuning):
        self.at, self.clock, self.weight, self.tuning = at, clock, weight, tuning
        self.decay = decays(clock, weight, tuning)

    def read(self, clock: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """At each reading, over the first ``counted`` accesses; -infinity over none."""
        out = np.full(len(clock), -np.inf)
        for a in range(0, len(clock), 256):
            some = slice(a, a + 256)
            n = int(counted[some].max(initial=0))
            age = np.maximum(clock[some, None] - self.clock[None, :n], self.tuning.min_age_days)
            total = np.where(np.arange(n) < counted[some, None], self.weight[:n] * age ** -self.decay[:n], 0.0).sum(1)
            out[some][total > 0] = np.log(total[total > 0])
        return out


def halved(value: Callable[[float], float], low: float, high: float, threshold: float, near: float = MINUTE) -> float:
    """The reading from which a falling value is below the threshold, at most ``near`` after it."""
    while high - low > near:
        middle = (low + high) / 2
        low, high = (low, middle) if value(middle) < threshold else (middle, high)
    return high


def floors(at: np.ndarray, tuning: S.Tuning) -> np.ndarray:
    """The lasting floor after each access: occasions at least the spacing after the last one counted."""
    counted, last, out = 0, None, np.empty(len(at))
    for k, t in enumerate(at):
        if last is None or t - last >= tuning.floor_spacing_days * S.DAY:
            counted, last = counted + 1, t
        out[k] = counted
    return tuning.tau - tuning.g * np.log(tuning.n0) + tuning.g * np.log(out)


def outlook(at: np.ndarray, clock: np.ndarray, weight: np.ndarray, kind: np.ndarray, sig: float, closes: float, restart: float, held_days: float, tuning: S.Tuning = S.TUNING) -> tuple[float | None, float | None, float | None, float, float]:
    """(fades_in_days, faded_clock, purges_in_days, value, lasting) of one memory.

    Rows are its accesses up to now, its restart if that has passed, and now. ``closes`` and ``restart`` are
    microseconds, NaN without a close; ``held_days`` is when the last guard of time clears.
    """
    said, now_at, now = kind == ACCESS, at[kind == NOW][0], float(clock[kind == NOW][0])
    first = Use(at[said], clock[said], weight[said], tuning)
    floor_after = floors(at[said], tuning)
    base = tuning.s * sig

    def after(extra_at: float, extra_clock: float) -> Use:
        later = first.at > closes
        t, c, w = np.append(first.at[later], extra_at), np.append(first.clock[later], extra_clock), np.append(first.weight[later], 1.0)
        order = np.lexsort((-w, t))
        return Use(t[order], c[order], w[order], tuning)

    passed = restart <= now_at
    second = after(restart, float(clock[kind == RESTART][0])) if passed else None
    points, start = np.unique(at[kind != NOW], return_index=True)
    start = clock[kind != NOW][start]
    end = np.append(start[1:], now)[: len(points)]
    occasions = np.searchsorted(first.at, points, "right")
    floor = np.where(occasions > 0, floor_after[np.maximum(occasions, 1) - 1] if len(floor_after) else -np.inf, -np.inf)
    fresh = points >= restart
    uses = [(first, ~fresh), *([(second, fresh)] if passed else [])]
    use = np.full(len(points), -np.inf)
    for one, rows in uses:
        use[rows] = one.read(end[rows], np.searchsorted(one.at, points[rows], "right"))
    faded, below = None, np.flatnonzero((end > start) & (base + np.maximum(use, floor) < tuning.tau))
    if len(below):
        k = below[0]
        one = second if fresh[k] else first
        counted = np.array([np.searchsorted(one.at, points[k], "right")])
        faded = halved(lambda c: base + max(one.read(np.array([c]), counted)[0], floor[k]), start[k], end[k], tuning.tau, MINUTE * min(1.0, tuning.quiet_rate or 1.0))

    lasting = base + (floor_after[-1] if len(floor_after) else -np.inf)
    ahead = (restart - now_at) / S.DAY if restart > now_at else np.inf
    parts = [(0.0, min(ahead, HORIZON), second or first)]
    if ahead < HORIZON:
        parts.append((ahead, HORIZON, after(restart, now + ahead)))

    def value(one: Use, days: float) -> float:
        return max(base + one.read(np.array([now + days]), np.array([len(one.at)]))[0], lasting)

    def first_below(threshold: float, least: float) -> float | None:
        for a, b, one in parts:
            a = max(a, least)
            if a < b and value(one, a) < threshold:
                return a
            if a < b and value(one, b) < threshold:
                return halved(lambda d: value(one, d), a, b, threshold)  # noqa: B023
        return None

    never = lasting >= tuning.tau - NEVER_PURGED_MARGIN
    purges = None if never else first_below(tuning.tau - tuning.purge_margin, held_days)
    return first_below(tuning.tau, 0.0), faded, purges, value(parts[0][2], 0.0), lasting


def fading(memories: DataFrame, accesses: DataFrame, turns: DataFrame, heads: DataFrame, now: str, tuning: S.Tuning = S.TUNING) -> DataFrame:
    """(memory_id, bank_id, fades_in_days, faded_at, purges_in_days, guards), one row per memory.

    ``fades_in_days``: bank days at full speed until strength is below tau, to a minute, 0 if it is, null beyond
    200 years. ``faded_at``: the first time at which it was, to a minute. The last two are those of the
    chain's head: when it may be purged, and what holds it now: forgotten, date_ahead, overdue_task, strength, lasting.
    Accesses after ``now`` are ignored. A bank's memories are dealt out; one memory's accesses are read by one task.
    """
    moment = F.lit(now).cast("timestamp")
    now_us, zone = int(pd.Timestamp(now).value // 1000), S._column(memories, "timezone", "UTC")
    end = lambda c: S.unit_end(F.col(c).cast("timestamp"), S._column(memories, f"{c}_precision", "day"), zone)
    close = S.window_close(memories).select("memory_id", S.micros("closes_at").alias("closes_us"), S.micros(F.greatest("closes_at", "known_at")).alias("restart_us"))
    hidden = heads.join(memories.where("hidden").select("memory_id"), "memory_id").select(F.col("head_id").alias("memory_id"), F.lit(True).alias("forgotten")).distinct()
    due = F.when((F.col("kind") == "task") & (F.col("observed_at") < F.col("due_at")), overdue_until(end("due_at"), S.closes_at(memories)))
    date = F.greatest(end("valid_from"), end("valid_until"))
    own = memories.select("memory_id", "bank_id", S.of_map(F.coalesce("owner_significance", "significance"), S.SIGNIFICANCE).alias("sig"), date.alias("date"), due.alias("due"))
    own = own.join(close, "memory_id", "left").join(hidden, "memory_id", "left")
    held = F.greatest(F.lit(0.0), F.coalesce((S.micros(F.greatest("date", "due")) - now_us) / float(S.DAY), F.lit(0.0)))
    facts = own.select("memory_id", "bank_id", "sig", F.col("closes_us").cast("double").alias("closes"), F.col("restart_us").cast("double").alias("restart"), held.alias("held"))
    counted = S.inherited(memories, accesses).where(F.col("accessed_at") <= moment)
    point = lambda rows, at, weight, kind: rows.select("memory_id", at.cast("long").alias("at_us"), weight.cast("double").alias("weight"), F.lit(kind).alias("kind"))
    points = point(counted.select(F.col("counting").alias("memory_id"), "accessed_at", F.col("kind").alias("of")), S.micros("accessed_at"), S.of_map(F.col("of"), S.WEIGHTS), ACCESS)
    points = points.unionByName(point(facts.where(F.col("restart") <= now_us), F.col("restart"), F.lit(1.0), RESTART)).unionByName(point(facts, F.lit(now_us), F.lit(0.0), NOW))
    windows = S.bank_windows(turns)
    timed = S.full_before(points.join(facts, "memory_id"), windows)
    rate = tuning.quiet_rate
    timed = timed.withColumn("clock", (F.col("full_us") + rate * (F.col("at_us") - F.col("full_us"))) / float(S.DAY)).drop("full_us")
    timed = timed.repartition("memory_id").sortWithinPartitions("memory_id", "at_us", "kind", F.desc("weight"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None  # the last memory of a batch may go on in the next

        def told(rows: pd.DataFrame) -> pd.DataFrame:
            key = rows["memory_id"].to_numpy()
            columns = [rows[c].to_numpy(dtype) for c, dtype in (("at_us", float), ("clock", float), ("weight", float), ("kind", int))]
            facts = [rows[c].to_numpy(float) for c in ("sig", "closes", "restart", "held")]
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            found = [(key[a], rows["bank_id"].iloc[a], *outlook(*(c[a:b] for c in columns), *(f[a] for f in facts), tuning)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pd.DataFrame(found, columns=["memory_id", "bank_id", "fades_in_days", "faded_clock", "purges_in_days", "value", "lasting"])

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            cut = int(np.searchsorted(rows["memory_id"].to_numpy() == rows["memory_id"].iloc[-1], True))
            if cut:
                yield told(rows.iloc[:cut])
            kept = rows.iloc[cut:]
        if kept is not None:
            yield told(kept)

    read = timed.mapInPandas(run, "memory_id long, bank_id long, fades_in_days double, faded_clock double, purges_in_days double, value double, lasting double")
    read = read.join(own.drop("bank_id", "sig"), "memory_id").checkpoint()
    # back from the clock to the world: on the clock's own axis the full-speed windows are as long as in the world
    axis = windows.select("bank_id", *[F.round(F.col("full_before_us") + rate * (F.col("start_us") - F.col("full_before_us")) + shift).cast("long").alias(c) for c, shift in (("start_us", F.lit(0)), ("end_us", F.col("end_us") - F.col("start_us")))], "full_before_us")
    back = S.full_before(read.where("faded_clock IS NOT NULL").select("memory_id", "bank_id", F.ceil(F.col("faded_clock") * S.DAY).alias("at_us")), axis)
    world = F.col("at_us") if rate == 1 else F.col("full_us") + (F.col("at_us") - F.col("full_us")) / rate
    back = back.select("memory_id", F.timestamp_micros(F.ceil(world).cast("long")).alias("faded_at"))
    holds = {
        "forgotten": F.col("forgotten"), "date_ahead": F.col("date") > moment, "overdue_task": F.col("due") > moment,
        "strength": F.col("value") >= tuning.tau - tuning.purge_margin, "lasting": F.col("lasting") >= tuning.tau - NEVER_PURGED_MARGIN,
    }
    guards = F.array_compact(F.array(*[F.when(test, name) for name, test in holds.items()]))
    purge = read.select(F.col("memory_id").alias("head_id"), F.when(F.col("forgotten").isNull(), F.col("purges_in_days")).alias("purges_in_days"), guards.alias("guards"))
    rows = read.select("memory_id", "bank_id", "fades_in_days").join(back, "memory_id", "left").join(heads, "memory_id").join(purge, "head_id")
    return rows.select("memory_id", "bank_id", "fades_in_days", "faded_at", "purges_in_days", "guards")
