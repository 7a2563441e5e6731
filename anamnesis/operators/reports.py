"""Browsing, health, audit and run reports over the tables of all banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.operators import strength as S
from anamnesis.operators.history import nearest_rank


def _n(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def list_sources(sources: DataFrame, chunks: DataFrame, memories: DataFrame, most: int) -> DataFrame:
    """(source_id, bank_id, number, chunks, queued, failed, live_memories): each bank's newest sources with counts made before they are joined."""
    own = W.partitionBy("bank_id").orderBy(F.desc("ingested_at"), F.desc("source_id"))
    page = sources.withColumn("number", F.row_number().over(own)).where(F.col("number") <= most)
    c = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"), _n(F.col("queued")).alias("queued"), _n(F.col("failed")).alias("failed"))
    m = memories.where("NOT retracted AND NOT hidden AND superseded_by IS NULL").groupBy("source_id").agg(F.count("*").alias("live_memories"))
    rows = page.select("source_id", "bank_id", "number").join(c, "source_id", "left").join(m, "source_id", "left")
    return rows.fillna(0, ["chunks", "queued", "failed", "live_memories"])


def bank_overview(memories: DataFrame, sources: DataFrame, status: Column) -> DataFrame:
    """One row per bank: memories by status and kind as maps, kept ones, and what its sources are and wait for."""
    counted = lambda c, name: memories.groupBy("bank_id", c.alias("k")).agg(F.count("*").alias("n")).groupBy("bank_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    rows = counted(status, "by_status").join(counted(F.col("kind"), "by_kind"), "bank_id")
    rows = rows.join(memories.groupBy("bank_id").agg(_n(F.coalesce(F.col("owner_significance") == "kept", F.lit(False))).alias("kept")), "bank_id")
    s = sources.groupBy("bank_id").agg(
        _n(F.col("kind") == "turn").alias("turns"), _n(F.col("kind") == "document").alias("versions"), F.count_distinct("document_id").alias("documents"),
        _n(F.col("tombstoned")).alias("tombstoned"), _n(F.col("removed")).alias("removed"), _n(F.col("queued")).alias("queued"), _n(F.col("failed")).alias("failed"),
    )
    return rows.join(s, "bank_id", "full_outer")


def bank_health(sources: DataFrame, refreshes: DataFrame) -> DataFrame:
    """(bank_id, queued, failed, failed_refreshes, attention): what waits, what failed, and what to look at."""
    a = sources.groupBy("bank_id").agg(_n(F.col("queued")).alias("queued"), _n(F.col("failed")).alias("failed"))
    b = refreshes.groupBy("bank_id").agg(_n(F.col("failed")).alias("failed_refreshes"))
    rows = a.join(b, "bank_id", "full_outer").fillna(0, ["queued", "failed", "failed_refreshes"])
    say = [F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" failed chunks"))), F.when(F.col("failed_refreshes") > 0, F.concat(F.col("failed_refreshes").cast("string"), F.lit(" failed refreshes")))]
    return rows.withColumn("attention", F.concat_ws("; ", *say))


def audit_lists(edits: DataFrame, memories: DataFrame, most: int) -> DataFrame:
    """(bank_id, kind, edit_id, number, memories, pending): each bank's newest purges and forgets.

    ``edits(edit_id, bank_id, kind, details, at)``; the details name the memories
    as JSON. A forget is pending while one of them is still there.
    """
    named = edits.withColumn("ids", F.from_json("details", "struct<memories:array<bigint>>")["memories"])
    there = named.select("edit_id", F.explode("ids").alias("memory_id")).join(memories.select("memory_id"), "memory_id", "left_semi").select("edit_id").distinct().withColumn("_there", F.lit(True))
    own = W.partitionBy("bank_id", "kind").orderBy(F.desc("edited_at"), F.desc("edit_id"))
    rows = named.withColumn("number", F.row_number().over(own)).where(F.col("number") <= most).join(there, "edit_id", "left")
    pending = (F.col("kind") == "forget") & F.coalesce("_there", F.lit(False))
    return rows.select("bank_id", "kind", "edit_id", "number", F.size("ids").alias("memories"), pending.alias("pending"))


def bank_attention(health: DataFrame, rebuilds: DataFrame, stored: str | None = None, current: str | None = None) -> DataFrame:
    """(bank_id, attention): a line for each thing to look at; null bank_id for what concerns all.

    ``health`` is that of ``bank_health``, ``rebuilds(bank_id, completed, acked)``.
    Purging is paused while the ``current`` deletion fingerprint is not the ``stored``.
    """
    lines = health.where("attention <> ''").select("bank_id", F.explode(F.split("attention", "; ")).alias("attention"))
    say = F.when(F.col("completed"), "its rebuild is complete and its sweep waits").otherwise("its memories are being rebuilt, so recall is off")
    lines = lines.unionByName(rebuilds.where("NOT acked").select("bank_id", say.alias("attention")))
    if stored is not None and stored != current:
        pause = f"purge is paused: the deletion fingerprint changed from {stored} to {current}"
        lines = lines.unionByName(health.limit(1).select(F.lit(None).cast(health.schema["bank_id"].dataType).alias("bank_id"), F.lit(pause).alias("attention")))
    return lines


def newest(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """Each bank's ``most`` newest rows with their number: sweeps, recalls, edits of one kind."""
    own = W.partitionBy("bank_id").orderBy(F.desc(at), F.desc(key))
    return rows.withColumn("number", F.row_number().over(own)).where(F.col("number") <= most)


def recall_lists(recalls: DataFrame, results: DataFrame, memories: DataFrame, most: int) -> DataFrame:
    """Each bank's newest recalls with ``results``: by rank, the memories that are still there."""
    there = newest(recalls, "at", "recall_id", most)
    got = results.join(memories.select("memory_id"), "memory_id", "left_semi").join(there.select("recall_id"), "recall_id")
    got = got.groupBy("recall_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda r: r["memory_id"]).alias("results"))
    return there.join(got, "recall_id", "left").withColumn("results", F.coalesce("results", F.array().cast(got.schema["results"].dataType)))


def fade_outs(snapshots: DataFrame, tuning: S.Tuning = S.TUNING) -> DataFrame:
    """(bank_id, week, fade_outs): how many memories crossed into faded from one daily snapshot to the next, by ISO week."""
    own = W.partitionBy("bank_id", "memory_id").orderBy("taken_at")
    rows = snapshots.withColumn("_before", F.lag("value").over(own))
    crossed = (F.col("_before") >= tuning.tau) & (F.col("value") < tuning.tau)
    return rows.groupBy("bank_id", F.date_trunc("week", "taken_at").cast("date").alias("week")).agg(_n(F.coalesce(crossed, F.lit(False))).alias("fade_outs"))


def injected_tokens(prefetches: DataFrame, synced: DataFrame) -> DataFrame:
    """(session_id, prefetches, tokens): of the sessions that have a synced turn."""
    rows = prefetches.join(synced.select("session_id").distinct(), "session_id", "left_semi")
    return rows.groupBy("session_id").agg(F.count("*").alias("prefetches"), F.sum("tokens").alias("tokens"))


def turn_tokens(prefetches: DataFrame, points: dict[str, float]) -> DataFrame:
    """(of, prefetches, tokens, samples, and the ``points`` of the samples' tokens), one row for ``turns`` and one for ``cron``.

    ``prefetches(session_id, tokens, cron, prefetch_only)``. Samples are the synced
    turns of sessions that are not cron's; cron has none.
    """
    cron, only = (F.coalesce(c, F.lit(False)) for c in ("cron", "prefetch_only"))
    rows = prefetches.select(F.when(cron, "cron").otherwise("turns").alias("of"), "tokens", (~cron & ~only).alias("told"))
    sums = rows.groupBy("of").agg(F.count("*").alias("prefetches"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), _n(F.col("told")).alias("samples"))
    return sums.join(nearest_rank(rows.where("told"), ["of"], "tokens", points), "of", "left")


def day_series(sweeps: DataFrame, refreshes: DataFrame, banks: DataFrame) -> DataFrame:
    """(series, bank_id, day, n) by the day of the bank's own ``timezone``: purges, refresh_calls, agenda_lines.

    ``sweeps(bank_id, at, purged, agenda_lines)``: days on which something was
    purged, and how long the agenda was after the day's last sweep, the longer of two at
    one instant. ``refreshes(bank_id, at, calls)``.
    """
    zones = banks.select("bank_id", F.coalesce("timezone", F.lit("UTC")).alias("_zone"))
    local = lambda rows: rows.join(zones, "bank_id").withColumn("day", F.to_date(F.from_utc_timestamp("at", F.col("_zone"))))
    swept = local(sweeps).groupBy("bank_id", "day").agg(F.sum("purged").alias("purges"), F.max(F.struct("at", "agenda_lines"))["agenda_lines"].alias("agenda_lines"))
    called = local(refreshes).groupBy("bank_id", "day").agg(F.sum("calls").alias("n"))
    of = lambda rows, name, n: rows.select(F.lit(name).alias("series"), "bank_id", "day", F.col(n).cast("long").alias("n"))
    return of(swept.where("purges > 0"), "purges", "purges").unionByName(of(called, "refresh_calls", "n")).unionByName(of(swept, "agenda_lines", "agenda_lines"))


def latency_summary(samples: DataFrame, points: dict[str, float]) -> DataFrame:
    """(level, samples, the ``points`` of value, max, reranked_share) of ``samples(level, value, reranked)``."""
    whole = samples.groupBy("level").agg(F.count("*").alias("samples"), F.max("value").alias("max"), F.avg(F.coalesce("reranked", F.lit(False)).cast("double")).alias("reranked_share"))
    return whole.join(nearest_rank(samples, ["level"], "value", points), "level", "left")


def review_rate(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """(chunks, reviewed, rate, promoted, rejected, across_kinds): one row over ``chunks(chunk_id, review)`` and the lines of ``plan_reconcile``."""
    a = chunks.agg(F.count("*").alias("chunks"), _n(F.col("review")).alias("reviewed")).withColumn("rate", F.try_divide("reviewed", "chunks"))
    odd = F.col("action") == "mismatch"
    b = plan.agg(F.coalesce(_n(F.coalesce(F.col("detail") == "promoted", F.lit(False))), F.lit(0)).alias("promoted"), F.coalesce(_n(odd & F.col("detail").endswith(":rejected")), F.lit(0)).alias("rejected"), F.coalesce(_n(odd), F.lit(0)).alias("across_kinds"))
    return a.crossJoin(b)  # one row each


def extraction_lag(synced: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """(key, lag_us) from a turn's sync to the end of its extraction."""
    return synced.join(completed, key).select(key, (S.micros("completed_at") - S.micros("synced_at")).alias("lag_us"))


def memory_outcomes(memories: DataFrame, created: DataFrame, faded: DataFrame, purged: DataFrame) -> DataFrame:
    """(memory_id, created_at, faded_at, purged_at), nulls where it has not."""
    rows = memories.select("memory_id").join(created, "memory_id", "left").join(faded, "memory_id", "left").join(purged, "memory_id", "left")
    return rows.select("memory_id", "created_at", "faded_at", "purged_at")


def facet_curves(labelled: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(curve, kept citations): (query_id, score, kept, relevant, precision) of each query and, as query_id null, of all together; (floor, inputs, cited, retained) at each floor.

    ``labelled(query_id, memory_id, score, relevant)``, ``cited(memory_id)``.
    """
    steps = labelled.groupBy("query_id", "score").agg(F.count("*").alias("n"), F.sum("relevant").alias("r"))
    steps = steps.unionByName(labelled.groupBy("score").agg(F.count("*").alias("n"), F.sum("relevant").alias("r")).withColumn("query_id", F.lit(None).cast(labelled.schema["query_id"].dataType)))
    down = W.partitionBy("query_id").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    curve = steps.select("query_id", "score", F.sum("n").over(down).alias("kept"), F.sum("r").over(down).alias("relevant")).withColumn("precision", F.col("relevant") / F.col("kept"))
    best = labelled.groupBy("memory_id").agg(F.max("score").alias("best")).join(cited.distinct().withColumn("_c", F.lit(1)), "memory_id", "left")
    at = best.groupBy(F.col("best").alias("floor")).agg(F.count("*").alias("n"), F.coalesce(F.sum("_c"), F.lit(0)).alias("c"))
    run = W.orderBy(F.desc("floor")).rowsBetween(W.unboundedPreceding, 0)  # one row per floor
    sizes = at.select("floor", F.sum("n").over(run).alias("inputs"), F.sum("c").over(run).alias("cited"))
    total = cited.distinct().agg(F.count("*").alias("_all"))
    return curve, sizes.crossJoin(total).select("floor", "inputs", "cited", F.try_divide("cited", "_all").alias("retained"))
