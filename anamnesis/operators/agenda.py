"""What lies ahead: repetition rules, dated lines, routines and undated tasks per bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.operators import strength as S
from anamnesis.operators.rules import next_occurrence

# Fixed values of the agenda: days ahead and back, and lines of each part.
HORIZON, OVERDUE, UNDATED = 7, 30, 30
DATED_LINES, ROUTINES, UNDATED_LINES = 15, 4, 5
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def short_period(rule: Column) -> Column:
    """Whether a rule repeats at least weekly; null where it cannot be read."""
    body = F.regexp_replace(F.trim(rule), "^RRULE:", "")
    parts = F.split(body, ";")
    sound = F.forall(parts, lambda p: p.contains("="))
    value = lambda k: F.get(F.transform(F.filter(parts, lambda p: F.upper(F.trim(F.substring_index(p, "=", 1))) == k), lambda p: F.trim(F.substr(p, F.instr(p, "=") + 1))), F.lit(0))
    freq, step = F.upper(value("FREQ")), F.coalesce(value("INTERVAL"), F.lit("1")).try_cast("int")
    return F.when(
        sound & step.isNotNull(),
        F.when(freq.isin("SECONDLY", "MINUTELY", "HOURLY"), True).when(freq == "DAILY", step <= 7).when(freq == "WEEKLY", step <= 1).when(freq.isin("MONTHLY", "YEARLY"), False),
    )


def annual_rule(text: Column) -> Column:
    """"every year on November 12" as a rule; null where no month and day is named."""
    low = F.lower(text)
    pattern = rf"\b({'|'.join(_MONTHS)})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b"
    other = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({'|'.join(_MONTHS)})\b"
    month = F.coalesce(F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(low, other, 2), F.lit("")))
    day = F.coalesce(F.nullif(F.regexp_extract(low, pattern, 2), F.lit("")), F.nullif(F.regexp_extract(low, other, 1), F.lit(""))).cast("int")
    number = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), month)
    yearly = low.rlike(r"\b(every|each) year\b|\bannually\b|\byearly\b")
    return F.when(yearly & month.isNotNull() & day.between(1, 31), F.concat(F.lit("FREQ=YEARLY;BYMONTH="), number.cast("string"), F.lit(";BYMONTHDAY="), day.cast("string")))


def agenda(memories: DataFrame, mentioned: DataFrame, now: str) -> DataFrame:
    """(bank_id, part, memory_id, position, line_at, folded): dated lines, routines and undated tasks of each bank.

    ``memories`` has value, recurrence_rrule, recurrence_start and timezone beside
    the usual columns; ``mentioned(memory_id, said)`` the last time a memory was
    mentioned again or confirmed. Only heads that are not retracted, hidden or
    ended. Dated are events still to start and tasks due within a week or overdue
    by at most 30 days, and long repetitions within a week; beyond 15 lines the
    faded fold first, then the least significant, then the furthest from today.
    ``folded`` counts them on each line of the part.
    """
    at = F.lit(now).cast("timestamp")
    rows = memories.where("NOT retracted AND NOT hidden AND superseded_by IS NULL AND kind IN ('event', 'task', 'recurring')").where(~S.has_ended(memories, at))
    zone = F.col("timezone")
    local = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    today = local(at)
    level = S.of_map(F.coalesce("owner_significance", "significance"), S.SIGNIFICANCE)
    rows = rows.join(mentioned, "memory_id", "left").withColumn("_short", F.coalesce(short_period(F.col("recurrence_rrule")), F.lit(True))).withColumn("_level", level).withColumn("_today", today)
    observed, start, due = (F.col(c).cast("timestamp") for c in ("observed_at", "valid_from", "due_at"))
    midnight = F.to_utc_timestamp(F.col("_today").cast("timestamp"), zone)
    coming = rows.where("kind = 'recurring' AND NOT _short").withColumn("_line", next_occurrence("recurrence_rrule", F.col("recurrence_start").cast("timestamp"), midnight, zone))
    events = rows.where((F.col("kind") == "event") & (observed < start) & (at < S.unit_end(start, S._column(memories, "valid_from_precision", "day"), zone))).withColumn("_line", start)
    tasks = rows.where((F.col("kind") == "task") & (observed < due) & (local(due) >= F.date_sub("_today", OVERDUE))).withColumn("_line", due)
    dated = coming.unionByName(events).unionByName(tasks).where(local(F.col("_line")) <= F.date_add("_today", HORIZON)).withColumn("part", F.lit("dated"))
    routines = rows.where("kind = 'recurring' AND _short").withColumn("_line", F.lit(None).cast("timestamp")).withColumn("part", F.lit("routine"))
    seen = F.greatest(observed, F.coalesce("said", observed))
    undated = rows.where((F.col("kind") == "task") & due.isNull() & local(seen).between(F.date_sub("_today", UNDATED), F.col("_today"))).withColumn("_line", F.lit(None).cast("timestamp")).withColumn("part", F.lit("undated"))
    own = W.partitionBy("bank_id")
    dated = dated.withColumn("_place", F.row_number().over(own.orderBy("_line", "memory_id")))
    apart = F.abs(F.datediff(local(F.col("_line")), "_today"))
    keep = F.row_number().over(own.orderBy((F.col("value") >= S.TUNING.tau).desc(), F.desc("_level"), apart, "_place"))
    dated = dated.withColumn("_keep", keep).withColumn("folded", F.greatest(F.lit(0), F.count("*").over(own) - DATED_LINES)).where(F.col("_keep") <= DATED_LINES)
    dated = dated.withColumn("position", F.row_number().over(own.orderBy("_place")))
    rest = routines.unionByName(undated).where(F.col("value") >= S.TUNING.tau).withColumn("folded", F.lit(0).cast("long"))
    rest = rest.withColumn("position", F.row_number().over(W.partitionBy("bank_id", "part").orderBy(F.desc("value"), F.desc("_level"), "memory_id")))
    rest = rest.where(F.col("position") <= F.when(F.col("part") == "routine", ROUTINES).otherwise(UNDATED_LINES))
    out = ("bank_id", "part", "memory_id", "position", F.col("_line").alias("line_at"), F.col("folded").cast("long").alias("folded"))
    return dated.select(*out).unionByName(rest.select(*out))


def upcoming_events(memories: DataFrame, now: str, most: int = 5) -> DataFrame:
    """(bank_id, memory_id, rank): the next upcoming events of each bank that stand and have not ended."""
    at = F.lit(now).cast("timestamp")
    end = S.unit_end(F.col("valid_from").cast("timestamp"), S._column(memories, "valid_from_precision", "day"), S._column(memories, "timezone", "UTC"))
    rows = memories.where("kind = 'event' AND NOT retracted AND NOT hidden AND superseded_by IS NULL").where((F.col("observed_at") < F.col("valid_from")) & (at < end) & ~S.has_ended(memories, at))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("bank_id").orderBy("valid_from", "memory_id"))).where(F.col("rank") <= most).select("bank_id", "memory_id", "rank")
