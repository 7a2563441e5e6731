"""Repetition rules as column expressions: periods become days, days become times, the first time from a given one is the answer.

A rule is read once into a struct. Its periods (years, months, weeks, days; for
hours and less the days that hold their ticks) are laid out as a sequence from
the one that ``after`` falls in, each gives its days that pass the by-lists, and
each day its times. A few periods are tried first, then more, then blocks of a whole cycle
of the calendar, after which a rule without a time has none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of repetition rules.
FREQUENCIES = ("YEARLY", "MONTHLY", "WEEKLY", "DAILY", "HOURLY", "MINUTELY", "SECONDLY")
WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
LISTS = {"BYMONTH": (1, 12), "BYMONTHDAY": (-31, 31), "BYYEARDAY": (-366, 366), "BYWEEKNO": (-53, 53), "BYHOUR": (0, 23), "BYMINUTE": (0, 59), "BYSECOND": (0, 59), "BYSETPOS": (-366, 366)}
#: Counted from one at either end, so without a zero.
SIGNED = ("BYMONTHDAY", "BYYEARDAY", "BYWEEKNO", "BYSETPOS")
YEARLY, MONTHLY, WEEKLY, DAILY, HOURLY, MINUTELY, SECONDLY = range(7)
DAY, LAST_YEAR = 86_400, 9999
#: Periods tried at first, then, and in a whole cycle of 400 years, by frequency; after the second in blocks of equal size.
FIRST, SECOND, CYCLE = (2, 2, 2, 8, 2, 2, 2), (12, 60, 60, 400, 400, 400, 400), (400, 4_800, 20_871, 146_097, 146_097, 146_097, 146_097)
BLOCK = 4_096

_Body = Callable[[Column], Column]


def _let(value: Column, body: _Body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@cache
def _zones() -> list[str]:
    return sorted(z for z in available_timezones() if "/" in z or z in ("UTC", "GMT"))


def _by(places: tuple[int, ...], freq: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in places]), freq + 1)


def _date(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day)


def _number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def _never() -> Column:
    return F.timestamp_seconds(F.lit(-62_000_000_000))


def _any(values: Column, *found: Column) -> Column:
    """An empty list lets everything pass."""
    return (F.size(values) == 0) | F.exists(values, lambda v: v.isin(*found))


def _week(day: Column, first: Column) -> Column:
    """(number, weeks of its year) of a day's week; a week belongs to the year of its fourth day."""

    def number(d: Column) -> Column:
        middle = d - F.pmod(F.weekday(_date(d)) - first, F.lit(7)) + 3
        return F.struct(F.ceil(F.dayofyear(_date(middle)) / 7).cast("int").alias("n"), F.year(_date(middle)).alias("y"))

    return _let(number(day), lambda w: F.struct(w.n.alias("n"), number(_number(F.make_date(w.y, F.lit(12), F.lit(28)))).n.alias("of")))


def _within(low: int, high: int, signed: bool) -> _Body:
    return lambda v: F.coalesce(v.between(low, high) & (v != 0 if signed else F.lit(True)), F.lit(False))


def _read(rule: Column, start: Column, after: Column, zone: Column) -> Column:
    """The rule as a struct, its lists filled from ``start`` where it names none; null where it cannot be read."""
    parts = F.transform(F.split(F.regexp_replace(F.upper(F.trim(rule)), "^RRULE:", ""), ";"), lambda p: F.regexp_replace(p, r"\s*=\s*", "="))
    return _let(F.transform(parts, lambda p: F.trim(p)), lambda p: _understood(p, start, after, zone))


def _understood(parts: Column, start: Column, after: Column, zone: Column) -> Column:
    """The struct of a rule's parts."""

    def value(key: str) -> Column:
        return F.get(F.transform(F.filter(parts, lambda p: p.startswith(key + "=")), lambda p: F.substr(p, F.lit(len(key) + 2))), F.lit(0))

    def numbers(key: str) -> Column:
        return F.coalesce(F.transform(F.split(value(key), ","), lambda v: v.try_cast("int")), F.array().cast("array<int>"))

    lists = {k: numbers(k) for k in LISTS}
    names = "|".join(WEEKDAYS)
    place = lambda name: F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), name).cast("int") - 1
    days = F.transform(F.split(value("BYDAY"), ","), lambda v: F.struct(F.coalesce(F.regexp_extract(v, r"^([+-]?\d{1,2})", 1).try_cast("int"), F.lit(0)).alias("n"), place(F.right(v, F.lit(2))).alias("w")))
    until = value("UNTIL")
    digits = F.rpad(F.regexp_replace(until, "[TZ]", ""), 14, "0")
    part = lambda at, size: F.substring(digits, at, size).try_cast("int")
    last = F.concat_ws("-", *[F.substring(digits, at, size) for at, size in ((1, 4), (5, 2), (7, 2))]).try_cast("date")
    stamp = _number(last).cast("long") * DAY + part(9, 2) * 3600 + part(11, 2) * 60 + part(13, 2)
    clock = lambda t: F.unix_seconds(F.from_utc_timestamp(t, zone))
    ends = F.when(until.endswith("Z"), clock(F.timestamp_seconds(stamp))).otherwise(stamp)
    keys = "|".join(["FREQ", "INTERVAL", "COUNT", "UNTIL", "WKST", "BYDAY", *LISTS])
    sound = (
        F.forall(parts, lambda p: p.rlike(rf"^({keys})=\S+$"))
        & (F.size(F.array_distinct(F.transform(parts, lambda p: F.substring_index(p, "=", 1)))) == F.size(parts))
        & F.coalesce(value("INTERVAL").rlike(r"^0*[1-9]\d{0,5}$"), F.lit(True))
        & F.coalesce(value("COUNT").rlike(r"^\d{1,9}$"), F.lit(True))
        & (until.isNull() | (until.rlike(r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(T([01]\d|2[0-3])[0-5]\d[0-5]\dZ?)?$") & last.isNotNull()))
        & F.coalesce(value("WKST").isin(*WEEKDAYS), F.lit(True))
        & F.coalesce(value("BYDAY").rlike(rf"^([+-]?0*[1-9]\d?)?({names})(,([+-]?0*[1-9]\d?)?({names}))*$"), F.lit(True))
    )
    for key, (low, high) in LISTS.items():
        sound &= F.forall(lists[key], _within(low, high, key in SIGNED))
    raw = F.struct(
        (F.array_position(F.array(*[F.lit(f) for f in FREQUENCIES]), value("FREQ")).cast("int") - 1).alias("freq"),
        F.coalesce(value("INTERVAL").cast("int"), F.lit(1)).alias("step"),
        value("COUNT").cast("int").alias("count"),
        ends.alias("until"),
        F.coalesce(place(value("WKST")), F.lit(0)).alias("first"),
        F.coalesce(days, F.array().cast("array<struct<n:int,w:int>>")).alias("day"),
        *[v.alias(k[2:].lower()) for k, v in lists.items()],
        clock(start).alias("start"),
        # a day early: a time that the clock skips is later than its digits say
        F.greatest(clock(start), clock(after) - DAY).alias("since"),
    )
    readable = sound & value("FREQ").isin(*FREQUENCIES) & start.isNotNull() & after.isNotNull() & zone.isNotNull()
    return F.when(readable, raw)


def _filled(r: Column) -> Column:
    """Days and times that a rule leaves open are those of its start; setpos of ticks below a day is applied to a tick's own times."""
    day = _date(F.floor(r.start / DAY).cast("int"))
    at = F.pmod(r.start, F.lit(DAY))
    none = (F.size(r.weekno) == 0) & (F.size(r.yearday) == 0) & (F.size(r.monthday) == 0) & (F.size(r.day) == 0)
    empty = F.array().cast("array<int>")
    own = lambda given, value, upto: F.when((F.size(given) == 0) & (r.freq < upto), F.array(value.cast("int"))).when(r.freq >= upto, F.array(F.lit(0))).otherwise(given)
    hours = own(r.hour, F.floor(at / 3600), HOURLY)
    minutes = own(r.minute, F.floor(at / 60) % 60, MINUTELY)
    seconds = own(r.second, at % 60, SECONDLY)
    times = F.flatten(F.transform(hours, lambda h: F.flatten(F.transform(minutes, lambda m: F.transform(seconds, lambda s: h * 3600 + m * 60 + s)))))
    unit = _by((DAY, DAY, DAY, DAY, 3600, 60, 1), r.freq)
    weekday = F.struct(F.lit(0).alias("n"), F.weekday(day).alias("w"))
    return F.struct(
        *[r[k].alias(k) for k in ("freq", "step", "count", "until", "first", "yearday", "weekno", "hour", "minute", "second", "setpos", "start", "since")],
        F.when(none & (r.freq == YEARLY) & (F.size(r.month) == 0), F.array(F.month(day))).otherwise(r.month).alias("month"),
        F.when(none & (r.freq <= MONTHLY), F.array(F.dayofmonth(day))).otherwise(r.monthday).alias("monthday"),
        F.when(none & (r.freq == WEEKLY), F.array(weekday)).otherwise(r.day).alias("day"),
        _let(F.array_sort(F.array_distinct(times)), lambda t: F.when((r.freq >= HOURLY) & (F.size(r.setpos) > 0), _placed(t, r.setpos)).otherwise(t)).alias("times"),
        F.when(r.freq < HOURLY, r.setpos).otherwise(empty).alias("places"),
        unit.alias("unit"),
        day.alias("from_day"),
        F.floor(r.start / DAY).cast("int").alias("from_number"),
        _date(F.floor(r.since / DAY).cast("int")).alias("since_day"),
        _date(F.floor(r.until / DAY).cast("int")).alias("until_day"),
    )


def _placed(values: Column, places: Column) -> Column:
    """The values at the given places from either end, in order."""
    return F.filter(values, lambda v, k: F.exists(places, lambda p: (p == k + 1) | (p == k - F.size(values))))


def _passes(r: Column, d: Column) -> Column:
    """Whether a day passes all lists of days."""
    date = _date(d)
    dom, of_month = F.dayofmonth(date), F.dayofmonth(F.last_day(date))
    doy, of_year = F.dayofyear(date), F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))
    week = F.when(F.size(r.weekno) == 0, True).otherwise(_let(_week(d, r["first"]), lambda w: F.exists(r.weekno, lambda v: (v == w.n) | (v == w.n - w.of - 1))))
    in_year = (r.freq == YEARLY) & (F.size(r.month) == 0)
    place, of = F.when(in_year, doy).otherwise(dom), F.when(in_year, of_year).otherwise(of_month)
    nth = lambda x: (x.n == 0) | (r.freq > MONTHLY) | (x.n == F.ceil(place / 7)) | (-x.n == F.floor((of - place) / 7) + 1)
    weekday = (F.size(r.day) == 0) | F.exists(r.day, lambda x: (x.w == F.weekday(date)) & nth(x))
    return _any(r.month, F.month(date)) & _any(r.monthday, dom, dom - of_month - 1) & _any(r.yearday, doy, doy - of_year - 1) & week & weekday


def _times(r: Column, period: Column) -> Column:
    """The local seconds that a period gives, in order."""
    year = F.year(r.from_day) + period
    month = F.add_months(F.trunc(r.from_day, "MM"), period)
    monday = r.from_number - F.pmod(F.weekday(r.from_day) - r["first"], F.lit(7)) + period * 7
    one = r.from_number + period
    low = F.when(r.freq == YEARLY, _number(F.make_date(year, F.lit(1), F.lit(1)))).when(r.freq == MONTHLY, _number(month)).when(r.freq == WEEKLY, monday).otherwise(one)
    high = F.when(r.freq == YEARLY, _number(F.make_date(year, F.lit(12), F.lit(31)))).when(r.freq == MONTHLY, _number(F.last_day(month))).when(r.freq == WEEKLY, monday + 6).otherwise(one)
    days = F.filter(F.sequence(low, high), lambda d: _passes(r, d))

    def ticks(d: Column) -> Column:
        base, wide = r.start - F.pmod(r.start, r.unit), r.step.cast("long") * r.unit
        first = base + F.ceil((d.cast("long") * DAY - base) / wide).cast("long") * wide
        all_ = F.when(first < (d.cast("long") + 1) * DAY, F.sequence(first, (d.cast("long") + 1) * DAY - 1, wide)).otherwise(F.array().cast("array<bigint>"))
        fits = lambda t: _any(r.hour, (F.floor(t / 3600) % 24).cast("int")) & ((r.freq < MINUTELY) | _any(r.minute, (F.floor(t / 60) % 60).cast("int"))) & ((r.freq < SECONDLY) | _any(r.second, (t % 60).cast("int")))
        return F.filter(all_, fits)

    bases = F.when(r.freq < HOURLY, F.transform(days, lambda d: d.cast("long") * DAY)).otherwise(F.flatten(F.transform(days, ticks)))
    out = F.flatten(F.transform(bases, lambda b: F.transform(r.times, lambda t: b + t)))
    return _let(out, lambda o: F.when(F.size(r.places) == 0, o).otherwise(_placed(o, r.places)))


def _found(r: Column, after: Column, zone: Column, block: Column) -> Column:
    """The first instant in the periods of a block, no later than the rule's end; counted rules are laid out from their start."""
    low = F.when(block == 0, 0).when(block == 1, _by(FIRST, r.freq)).otherwise(_by(SECOND, r.freq) + (block - 2) * BLOCK)
    high = F.when(block == 0, _by(FIRST, r.freq)).otherwise(F.least(_by(SECOND, r.freq) + (block - 1) * BLOCK, _by(CYCLE, r.freq)))
    step = F.when(r.freq < HOURLY, r.step).otherwise(1)
    lead = F.when(r.freq == WEEKLY, F.pmod(F.weekday(r.from_day) - r["first"], F.lit(7))).otherwise(0)

    def periods_to(day: Column) -> Column:
        years = F.year(day) - F.year(r.from_day)
        days = F.floor((F.datediff(day, r.from_day) + lead) / F.when(r.freq == WEEKLY, 7).otherwise(1)).cast("int")
        return F.when(r.freq == YEARLY, years).when(r.freq == MONTHLY, years * 12 + F.month(day) - F.month(r.from_day)).otherwise(days)

    at = F.floor(periods_to(r.since_day) / step).cast("int")
    most = periods_to(F.coalesce(r.until_day, F.make_date(F.lit(LAST_YEAR), F.lit(12), F.lit(30))))
    begin = F.when(r["count"].isNotNull(), 0).otherwise(at + low)
    end = F.least(at + high - 1, F.floor(most / step).cast("int"))
    periods = F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<int>"))
    times = F.flatten(F.transform(periods, lambda k: _times(r, (k * step).cast("int"))))
    times = F.filter(times, lambda t: (t >= r.start) & (r.until.isNull() | (t <= r.until)))
    return _let(F.slice(times, 1, F.coalesce(r["count"], F.lit(2**31 - 1))), lambda t: _first(r, t, after, zone))


def _first(r: Column, times: Column, after: Column, zone: Column) -> Column:
    """The first of the times; an instant before all where a count is used up."""
    instants = F.transform(F.filter(times, lambda t: t >= r.since), lambda t: F.to_utc_timestamp(F.timestamp_seconds(t), zone))
    spent = F.when(F.size(times) == r["count"], _never())
    return F.coalesce(F.array_min(F.filter(instants, lambda t: t >= after)), spent)


def next_occurrence(rule: Column | str, start: Column, after: Column, zone: Column | str) -> Column:
    """The first time at or after ``after`` that a rule gives, on the clock of its timezone.

    Frequencies from years to seconds with interval, count, until and all by-lists but
    Easter's; weekdays with a number count within the month, or within the year of a
    yearly rule without months. Null for rules of several lines, with a colon or unreadable,
    for unknown timezones and null times. A local time that the clock skips is taken as much
    later; one that comes twice is the first. Rules of hours and less that give nothing for 400
    years give nothing.
    """
    rule, zone = (F.col(c) if isinstance(c, str) else c for c in (rule, zone))
    known = F.when(zone.isin(_zones()), zone)
    body = F.when(~F.regexp_replace(F.trim(rule), "^RRULE:", "").rlike(r"[:\n\r]"), rule)
    safe = F.coalesce(known, F.lit("UTC"))
    blocks = lambda r: F.sequence(F.lit(0), (F.ceil((_by(CYCLE, r.freq) - _by(SECOND, r.freq)) / BLOCK) + 1).cast("int"))
    none = F.lit(None).cast("timestamp")
    answer = lambda r: F.nullif(F.aggregate(blocks(r), none, lambda found, k: F.coalesce(found, _found(r, after, safe, k))), _never())
    read = F.when(known.isNotNull(), _read(body, start, after, safe))
    return _let(read, lambda raw: F.when(raw.isNotNull(), _let(_filled(raw), answer)))
