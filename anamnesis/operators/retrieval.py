"""Recall and injection for batches of queries: arms, clean-up, filters, fusion, reranking, scores, gate, log and lines."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.operators import recall as R
from anamnesis.operators import strength as S
from anamnesis.operators.recall import PER_ARM, tokens

# Fixed values of ranking.
RERANKED, LIMIT, MOST = 40, 10, 30
UPCOMING_DAYS, OVERDUE_FULL, OVERDUE_ZERO, GRACE, PAST = 7.0, 14.0, 60.0, 7.0, 30.0
W_INJECT, W_RECALL, BONUS, PENALTY, LEAST_CONFIDENCE, AGE_SHOWN_BELOW = 0.5, 0.2, 1.0, 1.0, -3.0, 0.9
DIMENSIONS = 384
_FNV, _PRIME, _64 = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


@lru_cache(maxsize=200_000)
def _slot(word: str) -> tuple[int, float]:
    h = _FNV
    for b in word.encode():
        h = (h ^ b) * _PRIME & _64
    return h % DIMENSIONS, 1.0 if h >> 32 & 1 else -1.0


def bag_of_words(text: str | None) -> np.ndarray:
    """Unit vector of hashed lower-case words; a text without any is the first axis."""
    out = np.zeros(DIMENSIONS, np.float32)
    for word in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split():
        at, sign = _slot(word)
        out[at] += sign
    norm = float(np.linalg.norm(out))
    if norm == 0:
        out[0] = norm = 1.0
    return out / norm


def embed(model=bag_of_words):
    """A vectorised UDF of texts to vectors; any function from a text to a float array will do."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(model)

    return run


def reembed(memories: DataFrame, model=bag_of_words) -> DataFrame:
    """(memory_id, bank_id, embedding) anew for every memory."""
    return memories.select("memory_id", "bank_id", embed(model)("content").alias("embedding"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def entity_arm(named: DataFrame, links: DataFrame, entities: DataFrame, memories: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = PER_ARM) -> DataFrame:
    """(query_id, memory_id, rank): memories linked to the entities ``named(query_id, bank_id, entity_id)`` or to ones merged into them.

    Seeded entities, to which nearly every memory links, are left out before the
    join. By cosine to the query's vector, then newer, then the lower id; memories
    without a vector come last.
    """
    lasts = S.survivors(entities, "entity_id", "merged_into", "survivor_id").join(entities.where("NOT seeded").select(F.col("entity_id").alias("survivor_id")), "survivor_id", "left_semi")
    wanted = named.join(lasts, "entity_id").select("query_id", "bank_id", "survivor_id").distinct()
    hits = links.join(lasts, "entity_id").select("memory_id", "bank_id", "survivor_id").join(wanted, ["survivor_id", "bank_id"]).select("query_id", "memory_id").distinct()
    rows = hits.join(memories.select("memory_id", "observed_at"), "memory_id").join(vectors.select("memory_id", "embedding"), "memory_id", "left")
    rows = rows.join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id", "left").withColumn("near", F.round(cosine(F.col("embedding"), F.col("asked")), 9))
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("near"), F.desc("observed_at"), "memory_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "memory_id", "rank")


def clean_candidates(hits: DataFrame, memories: DataFrame, heads: DataFrame) -> DataFrame:
    """(query_id, arm, memory_id, rank): hits that are not retracted or hidden, replaced by their chain's head, each head once at its best rank, ranked anew."""
    up = memories.where("NOT retracted AND NOT hidden").select("memory_id")
    rows = hits.join(up, "memory_id", "left_semi").join(heads, "memory_id").join(up.select(F.col("memory_id").alias("head_id")), "head_id", "left_semi")
    best = rows.groupBy("query_id", "arm", F.col("head_id").alias("memory_id")).agg(F.min("rank").alias("rank"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "arm").orderBy("rank", "memory_id")))


def injection_filter(rows: DataFrame, context: DataFrame, tuning: S.Tuning = S.TUNING) -> DataFrame:
    """Rows whose strength ``value`` has not faded, less what ``context(query_id, memory_id)`` already holds."""
    return rows.where(F.col("value") >= tuning.tau).join(context.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")


def undated() -> Column:
    """A fact without a start and an end: no bound of a range lets it in, a range without bounds does not ask."""
    return (F.col("kind") == "fact") & F.col("valid_from").isNull() & F.col("valid_until").isNull()


def happened_span(memories: DataFrame) -> tuple[Column, Column]:
    """When a memory's window holds: from the first instant up to the second, null where it is open.

    A fact without an end stands in the unit of its stated start alone; without a start no bound
    of a range lets it in, as it begins in the year 9999 and ends in the year 1000. A low-confidence window is one unit of its own dates wider on both sides.
    """
    zone, low = S._column(memories, "timezone", "UTC"), F.coalesce(F.col("low_confidence"), F.lit(False))
    start, start_unit = F.col("valid_from").cast("timestamp"), S._column(memories, "valid_from_precision", "day")
    until_unit = S._column(memories, "valid_until_precision", "day")
    wider = lambda at, unit, n: F.when(low, S.shift(at, unit, zone, n)).otherwise(at)
    point = (F.col("kind") == "fact") & F.col("valid_until").isNull()
    nowhere = undated()
    late, early = (F.lit(x).cast("timestamp") for x in ("9999-12-31", "1000-01-01"))
    ends_unit = F.when(F.col("valid_until").isNull(), start_unit).otherwise(until_unit)
    begins = F.when(nowhere, late).otherwise(wider(start, start_unit, -1))
    ends = F.when(nowhere, early).when(point, wider(S.unit_end(start, start_unit, zone), start_unit, 1)).otherwise(wider(S.closes_at(memories), ends_unit, 1))
    return begins, ends


def recall_filter(kinds: list[str] | None = None, phases: list[str] | None = None, said: tuple[str | None, str | None] | None = None, happened: tuple[str | None, str | None] | None = None) -> Column:
    """A condition on (kind, phase, observed_at, begins, ends), the last two as ``dated`` adds them.

    ``current`` takes overdue in, ``past`` both pasts. ``said`` is inclusive.
    ``happened`` asks for windows that begin by the range's end and end after its
    start; an open end of a window or of a range has no limit. Many ranges at once go
    through ``happened_in``.
    """
    keep = F.lit(True)
    if kinds:
        keep &= F.col("kind").isin(*kinds)
    if phases:
        groups = {"current": ["current", "overdue"], "past": ["recently_past", "long_past"], "upcoming": ["upcoming"]}
        keep &= F.col("phase").isin(*[p for g in phases for p in groups[g]])
    at = lambda x: F.lit(x).cast("timestamp")
    if said:
        for bound, test in zip(said, (F.col("observed_at").cast("timestamp") >= at(said[0]), F.col("observed_at").cast("timestamp") <= at(said[1])), strict=True):
            keep &= test if bound else F.lit(True)
    if happened and any(happened):
        lo, hi = happened
        keep &= F.coalesce(F.col("begins") <= at(hi), F.lit(True)) if hi else F.lit(True)
        keep &= F.coalesce(F.col("ends") > at(lo), F.lit(True)) if lo else F.lit(True)
    return F.coalesce(keep, F.lit(False))


#: Widths of buckets in powers of two of microseconds: from about a minute up to 9,000 years, each 16 times the one before.
LEVELS = range(26, 62, 4)
FAR = 1 << 61


def happened_in(windows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query_id, memory_id): the windows that meet each query's range, for many ranges at once.

    ``windows(memory_id, bank_id, begins, ends)`` as ``happened_span`` gives them,
    ``ranges(query_id, bank_id, lo, hi)``; null ends are open. A window meets a range if it begins in it,
    or if it holds the range's start. For the first, each window's beginning stands in one bucket per
    level and a range looks at the level of its own length; for the second, a window stands in the buckets of
    the level of its length, and a range's start looks at one bucket per level. Either side
    takes at most 17 buckets a level whatever its length, and no pair is met twice. A range open on
    both sides takes every window, those of ``undated`` facts too; leave them out where it should not.
    """
    bounded = lambda c, far: F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.coalesce(S.micros(c), F.lit(far))))
    own = windows.select("memory_id", "bank_id", bounded("begins", -FAR).alias("b"), bounded("ends", FAR).alias("e"))
    asked = ranges.select("query_id", "bank_id", bounded("lo", -FAR).alias("lo"), bounded("hi", FAR).alias("hi"))
    fits = lambda size: reduce(lambda found, n: F.when(size <= 1 << n + 4, n).otherwise(found), reversed(LEVELS), F.lit(LEVELS[-1]))
    bucket = lambda at, level: F.expr(f"shiftright({at}, {level})")
    spread = lambda a, b: F.explode(F.sequence(bucket(a, "level"), bucket(b, "level"))).alias("bucket")
    every = F.explode(F.array(*[F.lit(n) for n in LEVELS])).alias("level")
    meets = (F.col("b") <= F.col("hi")) & (F.col("e") > F.col("lo"))
    key = ["bank_id", "level", "bucket"]
    starts = own.select("*", every).withColumn("bucket", bucket("b", "level"))
    over = asked.withColumn("level", fits(F.col("hi") - F.col("lo"))).where("lo <= hi").select("*", spread("lo", "hi"))
    inside = over.join(starts, key).where(meets & (F.col("b") > F.col("lo")))
    held = own.where("b < e").withColumn("level", fits(F.col("e") - F.col("b"))).select("*", spread("b", "e - 1"))
    at_start = asked.select("*", every).withColumn("bucket", bucket("lo", "level"))
    around = at_start.join(held, key).where(meets & (F.col("b") <= F.col("lo")))
    return inside.select("query_id", "memory_id").unionByName(around.select("query_id", "memory_id"))


def entity_filter(named: DataFrame, links: DataFrame, entities: DataFrame, heads: DataFrame) -> DataFrame:
    """(query_id, memory_id): memories of the entities ``named(query_id, bank_id, entity_id)``, and the heads of their chains.

    Seeded entities count here, and so do those merged into a named one, at
    any depth. A head counts as linked when any version of it is.
    """
    lasts = S.survivors(entities, "entity_id", "merged_into", "survivor_id")
    wanted = named.join(lasts, "entity_id").select("query_id", "bank_id", "survivor_id").distinct()
    direct = links.join(lasts, "entity_id").select("memory_id", "bank_id", "survivor_id").join(wanted, ["survivor_id", "bank_id"]).select("query_id", "memory_id")
    through = direct.join(heads, "memory_id").select("query_id", F.col("head_id").alias("memory_id"))
    return direct.unionByName(through).distinct()


def lexical_logit(query: Column, sentence: Column) -> Column:
    """How many different words of the query the sentence has, less a half."""
    return F.size(F.array_intersect(F.array_distinct(tokens(query)), tokens(sentence))) - F.lit(0.5)


def rescore_pools(pools: DataFrame, logit: Column) -> DataFrame:
    """Add ``logit`` and ``position`` to ``pools(pool_id, place, ..)``: a fixed pool in order of another query's logits, ties as they stood."""
    rows = pools.withColumn("logit", logit)
    return rows.withColumn("position", F.row_number().over(W.partitionBy("pool_id").orderBy(F.desc("logit"), "place")))


def phase_term(phase: Column, now: Column, starts: Column, due_end: Column, closes: Column, low: Column, bonus: float = BONUS, penalty: float = PENALTY) -> Column:
    """The bonus before a start or after a due date and the penalty after a close, halved where the window is uncertain."""
    days = lambda a, b: F.greatest(F.lit(0.0), (S.micros(b) - S.micros(a)) / float(S.DAY))
    ahead, late, since = days(now, starts), days(due_end, now), days(closes, now)
    term = (
        F.when(phase == "upcoming", F.greatest(F.lit(0.0), bonus * (1 - ahead / UPCOMING_DAYS)))
        .when(phase == "overdue", bonus * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (OVERDUE_ZERO - late) / (OVERDUE_ZERO - OVERDUE_FULL))))
        .when(phase.isin("recently_past", "long_past"), -penalty * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (since - GRACE) / (PAST - GRACE))))
    )
    term = F.coalesce(term, F.lit(0.0))
    return F.when(low, term / 2).otherwise(term)


def score(logit: Column, value: Column, confidence: Column, phase: Column, weight: float, scale: float = 1.0) -> Column:
    """Relevance, weighted strength, the clamped log of confidence and the phase term; -infinity stays so."""
    sure = F.when(confidence > 0, F.greatest(F.lit(LEAST_CONFIDENCE), F.log(confidence))).otherwise(F.lit(LEAST_CONFIDENCE))
    return logit / scale + weight * value + sure + phase


def dated(memories: DataFrame, now: str) -> DataFrame:
    """Add the phase and the times that ranking and filters need: phase, closes, due_end, valid_end, begins, ends."""
    at, zone = F.lit(now).cast("timestamp"), S._column(memories, "timezone", "UTC")
    end = lambda c: S.unit_end(F.col(c).cast("timestamp"), S._column(memories, f"{c}_precision", "day"), zone)
    task = F.col("kind") == "task"
    phase = S.phase(at, F.col("observed_at").cast("timestamp"), F.col("valid_from").cast("timestamp"), end("valid_from"), S.closes_at(memories), F.col("due_at").cast("timestamp"), end("due_at"), task)
    return memories.select("*", phase.alias("phase"), S.closes_at(memories).alias("closes"), F.when(task, end("due_at")).alias("due_end"), end("valid_until").alias("valid_end"), *(c.alias(n) for c, n in zip(happened_span(memories), ("begins", "ends"), strict=True)))


def arms(queries: DataFrame, memories: DataFrame, vectors: DataFrame, named: DataFrame | None = None, links: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(query_id, arm, memory_id, rank) of the vector, full-text and, where entities are given, entity arms."""
    found = [R.vector_top_k(vectors, queries).select("query_id", F.lit("vector").alias("arm"), "memory_id", "rank"), R.bm25_top_k(memories, queries).select("query_id", F.lit("bm25").alias("arm"), "memory_id", "rank")]
    if named is not None:
        found.append(entity_arm(named, links, entities, memories, vectors, queries).select("query_id", F.lit("entity").alias("arm"), "memory_id", "rank"))
    return reduce(DataFrame.unionByName, found)


def ranked(hits: DataFrame, queries: DataFrame, memories: DataFrame, now: str, weight: float, phased: bool) -> DataFrame:
    """Fused and scored candidates of cleaned ``hits(query_id, arm, memory_id, rank)``.

    ``memories`` has value, confidence and what ``dated`` adds. The first 40 by
    fusion are reranked; the rest follow them in fused order with no logit.
    Columns: rrf, rrf_rank, logit, the parts of the score, score, place.
    """
    fused = R.rrf_fuse(hits).withColumnRenamed("rank", "rrf_rank")
    rows = fused.join(memories, "memory_id").join(queries.select("query_id", "query"), "query_id")
    at = F.lit(now).cast("timestamp")
    term = phase_term(F.col("phase"), at, F.col("valid_from").cast("timestamp"), F.col("due_end"), F.col("closes"), F.col("low_confidence")) if phased else F.lit(0.0)
    logit = F.when(F.col("rrf_rank") <= RERANKED, lexical_logit(F.col("query"), F.col("content")))
    rows = rows.withColumn("logit", logit.cast("double")).withColumn("phase_term", F.when(F.col("logit").isNotNull(), term))
    rows = rows.withColumn("score", score(F.col("logit"), F.col("value"), F.col("confidence"), F.col("phase_term"), weight))
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("score", 9)), "rrf_rank")
    return rows.withColumn("place", F.row_number().over(order))


def recall(queries: DataFrame, memories: DataFrame, hits: DataFrame, heads: DataFrame, now: str, keep: Column | None = None, limit: int = LIMIT, phased: bool = False) -> DataFrame:
    """(query_id, memory_id, place, rrf_rank, logit, score): the best ``limit`` (1 to 30) memories of each query that ``keep`` admits."""
    rows = clean_candidates(hits, memories, heads)
    some = dated(memories, now)
    if keep is not None:
        rows = rows.join(some.where(keep).select("memory_id"), "memory_id", "left_semi")
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "arm").orderBy("rank")))
    out = ranked(rows, queries, some, now, W_RECALL, phased)
    return out.where(F.col("place") <= min(max(limit, 1), MOST)).select("query_id", "memory_id", "place", "rrf_rank", "logit", "score")


def _injected(queries: DataFrame, memories: DataFrame, hits: DataFrame, heads: DataFrame, context: DataFrame, now: str, floor: float) -> tuple[DataFrame, DataFrame]:
    some = dated(memories, now)
    clean = clean_candidates(hits, memories, heads)
    kept = injection_filter(clean.join(some.select("memory_id", "value"), "memory_id"), context).drop("value")
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "arm").orderBy("rank")))
    rows = ranked(kept, queries, some, now, W_INJECT, True)
    lines = rows.where("logit IS NOT NULL").withColumn("line", render_line(now))
    gated = R.gate(lines.select("query_id", "memory_id", (-F.col("place")).cast("double").alias("score"), F.length("line").cast("long").alias("chars"), "logit"), floor, by="logit")
    decided = rows.join(gated.select("query_id", "memory_id", "decision"), ["query_id", "memory_id"], "left")
    return clean, decided.withColumn("decision", F.coalesce("decision", F.lit("outside_rerank_pool")))


def prefetch(queries: DataFrame, memories: DataFrame, hits: DataFrame, heads: DataFrame, context: DataFrame, now: str, floor: float = 0.0) -> DataFrame:
    """(query_id, memory_id, place, logit, score, decision): what enters each prompt, and why the rest does not."""
    return _injected(queries, memories, hits, heads, context, now, floor)[1].select("query_id", "memory_id", "place", "logit", "score", "decision")


def explain(queries: DataFrame, memories: DataFrame, hits: DataFrame, heads: DataFrame, context: DataFrame, now: str, floor: float = 0.0) -> DataFrame:
    """Every candidate of injection: ranks by arm, fused rank, logit, score, band, whether included, and the reason if not."""
    clean, decided = _injected(queries, memories, hits, heads, context, now, floor)
    by_arm = clean.groupBy("query_id", "memory_id").pivot("arm", ["vector", "bm25", "entity"]).agg(F.min("rank"))
    values = memories.select("memory_id", "value")
    rows = by_arm.join(values, "memory_id").join(decided.select("query_id", "memory_id", "rrf_rank", "logit", "score", "decision"), ["query_id", "memory_id"], "left")
    held = context.select("query_id", "memory_id", F.lit(True).alias("_held"))
    rows = rows.join(held, ["query_id", "memory_id"], "left")
    reason = F.when(F.col("decision") == "taken", None).when(F.col("decision").isNotNull(), F.col("decision")).when(F.col("_held"), "in_context").otherwise("below_tau")
    return rows.select("query_id", "memory_id", "vector", "bm25", "entity", "rrf_rank", "logit", "score", S.band(F.col("value")).alias("band"), F.coalesce(F.col("decision") == "taken", F.lit(False)).alias("included"), reason.alias("reason"))


def recall_log(found: DataFrame, queries: DataFrame, kind: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(recalls, recall_results): one row per query, also of those that found nothing, and its ranked results; no access is made."""
    recalls = queries.select(F.col("query_id").alias("recall_id"), "bank_id", F.lit(kind).alias("kind"), "query", F.lit(at).cast("timestamp").alias("recalled_at"))
    return recalls, found.select(F.col("query_id").alias("recall_id"), "memory_id", F.col("place").alias("rank"), "score", F.coalesce(F.col("decision") == "taken", F.lit(False)).alias("injected"))


def date_text(at: Column, precision: Column, zone: Column, now: Column) -> Column:
    """A time as its precision allows, in its own timezone; the year with a day only where it is not this one."""
    local, here = F.from_utc_timestamp(at, zone), F.from_utc_timestamp(now, zone)
    day = F.when(F.year(local) == F.year(here), F.date_format(local, "E d MMM")).otherwise(F.date_format(local, "E d MMM yyyy"))
    return (
        F.when(precision == "year", F.date_format(local, "yyyy")).when(precision == "month", F.date_format(local, "MMM yyyy"))
        .when(precision == "day", day).otherwise(F.concat_ws(" ", day, F.date_format(local, "HH:mm")))
    )


def annotations(now: str, columns: set[str] = frozenset()) -> Column:
    """What a line says beside its sentence, as an array; ``columns`` names which optional ones the rows have."""
    at = F.lit(now).cast("timestamp")
    has = lambda name, default: F.col(name) if name in columns else default
    zone = has("timezone", F.lit("UTC"))
    date = lambda c: date_text(F.col(c).cast("timestamp"), has(f"{c}_precision", F.lit("day")), zone, at)
    observed = has("last_observed", F.col("observed_at")).cast("timestamp")
    days = F.floor(F.greatest(F.lit(0), S.micros(at) - S.micros(observed)) / S.DAY)
    ago = F.when(days == 0, "today").when(days == 1, "1 day ago").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    parts = (
        F.when((F.col("phase") == "upcoming") & F.col("valid_from").isNotNull(), F.concat(F.lit("upcoming "), date("valid_from"))),
        F.when((F.col("phase") == "overdue") & F.col("due_at").isNotNull(), F.concat(F.lit("overdue since "), date("due_at"))),
        F.when(F.col("phase").isin("recently_past", "long_past") & F.col("valid_until").isNotNull(), F.concat(F.lit("ended "), date("valid_until"))),
        F.when(F.col("kind") == "recurring", F.concat(F.lit("recurring: "), has("recurrence_text", F.lit(None).cast("string")))),
        F.when((F.col("kind") == "state") & (F.col("confidence") < AGE_SHOWN_BELOW), F.concat(F.lit("observed "), ago, F.lit(", "), F.date_format(F.from_utc_timestamp(observed, zone), "E d MMM"))),
        F.when(F.col("low_confidence") & (F.col("valid_from").isNotNull() | F.col("valid_until").isNotNull() | F.col("due_at").isNotNull()), "date uncertain"),
    )
    return F.array_compact(F.array(*parts))


def render_line(now: str, columns: set[str] = frozenset()) -> Column:
    """The sentence and, in brackets, its annotations."""
    said = annotations(now, columns)
    return F.when(F.size(said) > 0, F.concat(F.col("content"), F.lit(" ["), F.array_join(said, "; "), F.lit("]"))).otherwise(F.col("content"))
