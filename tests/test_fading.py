import bisect
import math
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest

from anamnesis.operators import fading as Z
from anamnesis.operators import strength as S
from anamnesis.plans.registry import _checkpoints

T, D = S.TUNING, 86_400_000_000


def micros(t):
    return int(t.replace(tzinfo=UTC).timestamp()) * 1_000_000


class Plain:
    """Strength of one memory at any time, straight from the definition."""

    def __init__(self, turns, accesses, sig, closes=None, known=None, speed_from=None):
        merged = []
        for s in sorted(turns):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s + D)
            else:
                merged.append([s, s + D])
        self.turns, self.windows, self.accesses, self.sig, self.closes, self.known, self.speed_from = turns, merged, sorted(accesses), sig, closes, known, speed_from

    def clock(self, t):
        cut = self.speed_from or t
        full = sum(max(0, min(t, cut, e) - s) for s, e in self.windows if s < min(t, cut)) + max(0, t - cut)
        return (full + T.quiet_rate * (t - full)) / D

    def value(self, t):
        said = [a for a in self.accesses if a[0] <= t]
        n, last = 0, None
        for a, _ in said:
            if last is None or a - last >= 3 * D:
                n, last = n + 1, a
        rows = said
        if self.closes is not None and t >= max(self.closes, self.known):
            rows = [a for a in said if a[0] > self.closes] + [(max(self.closes, self.known), 1.0)]
        rows = sorted(rows, key=lambda a: (a[0], -a[1]))
        clocks, decay = [self.clock(a) for a, _ in rows], []
        for j, c in enumerate(clocks):
            before = sum(rows[i][1] * max(c - clocks[i], 0.01) ** -decay[i] for i in range(j))
            decay.append(min(T.d_max, T.a + T.c * before))
        now = self.clock(t)
        total = sum(w * max(now - c, 0.01) ** -d for (_, w), c, d in zip(rows, clocks, decay, strict=True))
        floor = T.tau - T.g * math.log(T.n0) + T.g * math.log(n) if n else -math.inf
        return T.s * self.sig + max(math.log(total) if total else -math.inf, floor)

    def faded(self, now):
        points = sorted({a for a, _ in self.accesses if a <= now} | ({max(self.closes, self.known)} if self.closes is not None and max(self.closes, self.known) <= now else set()))
        for a, b in zip(points, [*points[1:], now + 1], strict=False):
            times = range(a, b, 30_000_000)
            k = bisect.bisect_left(times, True, key=lambda t: self.value(t) < T.tau)
            if k < len(times) or self.value(b - 1) < T.tau and b - 1 > a:
                return times[k] if k < len(times) else b - 1
        return None

    def below(self, now, threshold, least=0.0):
        ahead = Plain(self.turns, [a for a in self.accesses if a[0] <= now], self.sig, self.closes, self.known, now)
        at = lambda days: ahead.value(now + round(days * D))
        restart = None if self.closes is None else (max(self.closes, self.known) - now) / D
        spans = [(0.0, Z.HORIZON)] if restart is None or restart <= 0 else [(0.0, restart - 1e-9), (restart, Z.HORIZON)]
        for a, b in spans:
            a = max(a, least)
            if a >= b:
                continue
            if at(a) < threshold:
                return a
            if at(b) >= threshold:
                continue
            while b - a > 1 / 2880:
                a, b = (a, (a + b) / 2) if at((a + b) / 2) < threshold else ((a + b) / 2, b)
            return b
        return None


def day(n, hours=0.0):
    return datetime(2024, 1, 1) + timedelta(days=n, hours=hours)


def test_fading_equals_a_plain_definition(spark):
    _checkpoints(spark)
    rng = random.Random(6)
    now = day(200)
    turns = [(1, day(rng.uniform(0, 210))) for _ in range(60)]
    memories, accesses, plain = [], [], {}
    levels = ["trivial", "minor", "notable", "major", "kept"]
    for k in range(60):
        kind, said = rng.choice(["fact", "event", "state", "task"]), day(rng.uniform(0, 100) // 1)
        start = day(rng.randrange(300)) if kind == "event" else None
        until = day(rng.randrange(300)) if rng.random() < 0.4 else None
        own = [] if k == 7 else sorted(day(rng.uniform(0, 230 if k % 3 else 30)).replace(microsecond=0) for _ in range(rng.choice([1, 1, 2, 5, 30])))
        if k == 3:  # many uses late do not hide that it had faded before
            own = [day(1), *(day(60, h) for h in range(40))]
        weights = [rng.choice(list(S.WEIGHTS)) for _ in own]
        level = "trivial" if k == 3 else rng.choice(levels)
        memories.append((k, 1, kind, level, None, said, start, until, day(150) if kind == "task" else None, None, None, False, False))
        accesses += [(k, w, a) for a, w in zip(own, weights, strict=True)]
        closes = until or (start if kind == "event" else None)
        plain[k] = Plain([micros(t) for _, t in turns], [(micros(a), S.WEIGHTS[w]) for a, w in zip(own, weights, strict=True)], S.SIGNIFICANCE[level], closes and micros(closes) + D, micros(said))
    m = spark.createDataFrame(memories, "memory_id long, bank_id long, kind string, significance string, owner_significance string, observed_at timestamp, valid_from timestamp, valid_until timestamp, due_at timestamp, superseded_by long, ended_by long, hidden boolean, retracted boolean")
    a = spark.createDataFrame(accesses, "memory_id long, kind string, accessed_at timestamp")
    t = spark.createDataFrame(turns, "bank_id long, message_at timestamp")
    got = {r.memory_id: r for r in Z.fading(m, a, t, m.selectExpr("memory_id", "memory_id AS head_id"), str(now)).collect()}
    assert len(got) == 60
    us, faded, ahead = micros(now), 0, 0
    for k, p in plain.items():
        r, want = got[k], p.faded(us)
        assert (r.faded_at is None) == (want is None), k
        if want is not None:
            faded += 1
            assert abs(micros(r.faded_at) - want) <= 90_000_000, (k, r.faded_at, want)
        kind, start, until, due = memories[k][2], memories[k][6], memories[k][7], memories[k][8]
        want = p.below(us, T.tau)
        assert (r.fades_in_days is None) == (want is None) and (want is None or r.fades_in_days == pytest.approx(want, abs=0.002)), k
        ahead += want is not None and want > 0
        dates = [micros(x) + D for x in (start, until) if x]
        held = [*dates, *([min(micros(due) + 31 * D, micros(until) + D if until else 1 << 62)] if due else [])]
        guards = [g for g, holds in (("date_ahead", any(x > us for x in dates)), ("overdue_task", due is not None and held[-1] > us)) if holds]
        assert [g for g in r.guards if g in ("date_ahead", "overdue_task")] == guards
        if "lasting" not in r.guards:
            want = p.below(us, T.tau - T.purge_margin, max([0.0, *((x - us) / D for x in held)]))
            assert (r.purges_in_days is None) == (want is None) and (want is None or r.purges_in_days == pytest.approx(want, abs=0.002)), k
    assert faded >= 10 and ahead >= 10  # the fixture holds both kinds


def test_one_mention_fades_in_closed_form():
    for level, days in (("trivial", 7.39), ("minor", 30.83), ("notable", 90.02)):
        one = np.array([0.0, 0.0]), np.array([0.0, 0.0]), np.array([1.0, 0.0]), np.array([Z.ACCESS, Z.NOW])
        assert Z.outlook(*one, S.SIGNIFICANCE[level], math.nan, math.nan, 0.0)[0] == pytest.approx(days, rel=0.001)


def test_what_is_hidden_is_not_purged(spark):
    _checkpoints(spark)
    m = spark.createDataFrame([(1, 1, "fact", "trivial", None, day(0), None, None, None, 2, None, True, False), (2, 1, "fact", "trivial", None, day(0), None, None, None, None, None, False, False)], "memory_id long, bank_id long, kind string, significance string, owner_significance string, observed_at timestamp, valid_from timestamp, valid_until timestamp, due_at timestamp, superseded_by long, ended_by long, hidden boolean, retracted boolean")
    a = spark.createDataFrame([(1, "created", day(0)), (2, "created", day(1))], "memory_id long, kind string, accessed_at timestamp")
    t = spark.createDataFrame([(1, day(0))], "bank_id long, message_at timestamp")
    got = Z.fading(m, a, t, S.chain_heads(m), str(day(400))).collect()
    assert {(r.memory_id, r.purges_in_days, tuple(r.guards)) for r in got} == {(1, None, ("forgotten",)), (2, None, ("forgotten",))}
