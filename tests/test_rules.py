"""Repetition rules against a calendar that is walked second by second, minute by minute or day by day."""

import random
from calendar import monthrange
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from anamnesis.operators.rules import WEEKDAYS, next_occurrence

UTC = ZoneInfo("UTC")


def in_list(values, *found):
    return not values or any(f in values for f in found)


def walked(rule, start, after, zone, days=1500):
    """Every local time from start on, tried one by one: its period, its lists, its place within the period."""
    given = dict(p.split("=") for p in rule.split(";"))
    freq, step = given["FREQ"], int(given.get("INTERVAL", 1))
    ints = lambda k: [int(x) for x in given[k].split(",")] if k in given else []
    month, dom, doy, setpos = ints("BYMONTH"), ints("BYMONTHDAY"), ints("BYYEARDAY"), ints("BYSETPOS")
    hours, minutes = ints("BYHOUR") or [start.hour], ints("BYMINUTE") or [start.minute]
    days_of = [(int(x[:-2] or 0), WEEKDAYS.index(x[-2:])) for x in given.get("BYDAY", "").split(",") if x]
    months = bool(month)
    if not (dom or doy or days_of):
        if freq == "YEARLY" and not month:
            month = [start.month]
        if freq in ("YEARLY", "MONTHLY"):
            dom = [start.day]
        if freq == "WEEKLY":
            days_of = [(0, start.weekday())]

    def period(d):
        if freq == "YEARLY":
            return d.year - start.year
        if freq == "MONTHLY":
            return (d.year - start.year) * 12 + d.month - start.month
        if freq == "WEEKLY":
            first = WEEKDAYS.index(given.get("WKST", "MO"))
            week = lambda x: x.toordinal() - (x.weekday() - first) % 7
            return (week(d) - week(start)) // 7
        return d.toordinal() - start.toordinal()

    def day_fits(d):
        of_month, of_year = monthrange(d.year, d.month)[1], datetime(d.year, 12, 31).timetuple().tm_yday
        at = d.timetuple().tm_yday
        place, of = (at, of_year) if freq == "YEARLY" and not months else (d.day, of_month)
        nth = lambda n: n == 0 or freq not in ("YEARLY", "MONTHLY") or n == (place - 1) // 7 + 1 or -n == (of - place) // 7 + 1
        weekday = not days_of or any(w == d.weekday() and nth(n) for n, w in days_of)
        return in_list(month, d.month) and in_list(dom, d.day, d.day - of_month - 1) and in_list(doy, at, at - of_year - 1) and weekday

    groups = {}
    first = start.replace(day=1, month=1) - timedelta(days=7)
    for k in range(days):
        d = (first + timedelta(days=k)).replace(hour=0, minute=0, second=0)
        p = period(d)
        if p >= 0 and p % step == 0 and day_fits(d):
            groups.setdefault(p, []).extend(d + timedelta(hours=h, minutes=m, seconds=start.second) for h in sorted(hours) for m in sorted(minutes))
    out = []
    for p in sorted(groups):
        times = groups[p]
        out += sorted({times[x - 1 if x > 0 else x] for x in setpos if abs(x) <= len(times)}) if setpos else times
    out = [t for t in out if t >= start]
    if "UNTIL" in given:
        until = datetime.strptime(given["UNTIL"].replace("T", "").rstrip("Z").ljust(14, "0"), "%Y%m%d%H%M%S")
        if given["UNTIL"].endswith("Z"):
            until = until.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
        out = [t for t in out if t <= until]
    if "COUNT" in given:
        out = out[: int(given["COUNT"])]
    instants = [t.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC).replace(tzinfo=None) for t in out]
    return min((t for t in instants if t >= after), default=None)


def drawn(rng):
    freq = rng.choice(["YEARLY", "MONTHLY", "WEEKLY", "DAILY"])
    parts = [f"FREQ={freq}"]
    if rng.random() < 0.5:
        parts.append(f"INTERVAL={rng.choice([2, 3] if freq == 'YEARLY' else [2, 3, 5])}")
    some = lambda values, most=3: ",".join(map(str, rng.sample(values, rng.randint(1, most))))
    if rng.random() < 0.3:
        parts.append("BYMONTH=" + some(list(range(1, 13))))
    lists = rng.random()
    if lists < 0.25:
        parts.append("BYMONTHDAY=" + some([1, 13, 15, 28, 31, -1, -2, -30]))
    elif lists < 0.35 and freq == "YEARLY":
        parts.append("BYYEARDAY=" + some([1, 60, 200, 366, -1, -300]))
    elif lists < 0.75:
        numbers = ["", "1", "2", "-1", "+5", "-3"] if freq in ("YEARLY", "MONTHLY") else [""]
        parts.append("BYDAY=" + ",".join(rng.choice(numbers) + w for w in rng.sample(WEEKDAYS, rng.randint(1, 3))))
    if rng.random() < 0.2:
        parts.append("BYHOUR=" + some([2, 9, 23]))
    if rng.random() < 0.2:
        parts.append("BYSETPOS=" + some([1, 2, -1, -2], 2))
    if rng.random() < 0.3:
        parts.append("WKST=" + rng.choice(WEEKDAYS))
    end = rng.random()
    if end < 0.2:
        parts.append(f"COUNT={rng.randint(0, 12)}")
    elif end < 0.35:
        parts.append(f"UNTIL=2024{rng.randint(1, 12):02d}15" + rng.choice(["", "T120000", "T020000Z"]))
    rng.shuffle(parts)
    return ";".join(parts)


def of(spark, rows):
    t = spark.createDataFrame([(k, r, str(s), str(a), z) for k, (r, s, a, z) in enumerate(rows)], "k int, r string, s string, a string, z string").repartition(8)
    at = lambda c: F.col(c).cast("timestamp")
    got = t.select("k", next_occurrence("r", at("s"), at("a"), "z").cast("string").alias("n")).collect()
    return [x["n"] for x in sorted(got, key=lambda x: x["k"])]


def test_rules_equal_a_walk(spark):
    rng = random.Random(11)
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Pacific/Auckland"]
    rows = []
    for _ in range(120):
        start = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(0, 200 * 86_400))
        rows.append((drawn(rng), start, start + timedelta(seconds=rng.randrange(-40 * 86_400, 500 * 86_400)), rng.choice(zones)))
    rows += [("FREQ=DAILY", datetime(2024, 10, 20, 0, 30), datetime(2024, 10, 27, k // 2, 30 * (k % 2), 1), "Europe/Berlin") for k in range(5)]
    rows += [("FREQ=DAILY", datetime(2024, 3, 20, 1, 30), datetime(2024, 3, 31, k // 2, 30 * (k % 2)), "Europe/Berlin") for k in range(5)]
    local = lambda s, z: s.replace(tzinfo=UTC).astimezone(ZoneInfo(z)).replace(tzinfo=None)
    want = [walked(r, local(s, z), a, z, 2600) for r, s, a, z in rows]
    got = of(spark, rows)
    wrong = [(row, w, g) for row, w, g in zip(rows, want, got, strict=True) if (w and str(w)) != g]
    assert not wrong, wrong[:5]
    assert sum(w is not None for w in want) > 80


def test_rules_below_a_day_and_far_ones(spark):
    s, a = datetime(2024, 1, 1, 10, 30, 5), datetime(2024, 1, 3, 12, 0, 0)
    rows = [
        ("FREQ=HOURLY;INTERVAL=7", s, a, "UTC"),
        ("FREQ=HOURLY;BYMINUTE=0,45", s, a, "UTC"),
        ("FREQ=HOURLY;BYMINUTE=0,45;BYSETPOS=-1", s, a, "UTC"),
        ("FREQ=MINUTELY;INTERVAL=90;BYHOUR=7", s, a, "UTC"),
        ("FREQ=SECONDLY;INTERVAL=50000", s, a, "UTC"),
        ("FREQ=HOURLY;COUNT=3", s, a, "UTC"),
        ("FREQ=HOURLY;COUNT=51", s, a, "UTC"),
        ("FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29", datetime(2097, 1, 1), datetime(2097, 1, 1), "UTC"),
        ("FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=30", s, a, "UTC"),
        ("FREQ=YEARLY;BYWEEKNO=1;BYDAY=MO", s, a, "UTC"),
        ("FREQ=YEARLY;BYWEEKNO=53;BYDAY=FR", s, a, "UTC"),
        ("FREQ=YEARLY;BYWEEKNO=-1;BYDAY=SU", s, a, "UTC"),
        ("RRULE:freq=weekly;byday=we", s, a, "UTC"),
    ]
    assert of(spark, rows) == [
        "2024-01-03 18:30:05", "2024-01-03 12:00:05", "2024-01-03 12:45:05", "2024-01-04 07:30:05", "2024-01-03 18:03:25", None, "2024-01-03 12:30:05",
        "2104-02-29 00:00:00", None, "2024-12-30 10:30:05", "2027-01-01 10:30:05", "2024-12-29 10:30:05", "2024-01-10 10:30:05",
    ]


def test_unreadable_rules(spark):
    s = datetime(2024, 1, 1)
    rules = ["", "FREQ=DAILY;INTERVAL=0", "FREQ=DAILY;BYDAY=XX", "FREQ=DAILY;BYMONTH=13", "FREQ=DAILY;BYMONTHDAY=0", "FREQ=DAILY;X=1", "FREQ=DAILY;UNTIL=soon", "FREQ=DAILY;;COUNT=1", "INTERVAL=2", "FREQ=DAILY\nFREQ=WEEKLY", "DTSTART:20240101;FREQ=DAILY", "FREQ=DAILY;FREQ=WEEKLY"]
    assert of(spark, [(r, s, s, "UTC") for r in rules] + [("FREQ=DAILY", s, s, "Mars/Olympus")]) == [None] * (len(rules) + 1)
