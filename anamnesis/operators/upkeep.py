"""Purge, entities, mental models, browsing and run reports over the tables of all banks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.operators.passages import FACTOR, bit_maps, marked, mixed, spots_of
from anamnesis.operators.recall import tokens
from anamnesis.operators.strength import TUNING, Tuning, band

OVERDUE_DAYS, NEVER_PURGED_MARGIN, MODEL_POOL, MODEL_INPUT = 30, 1.0, 90, 100


def overdue_until(due_end: Column, closes: Column, days: int = OVERDUE_DAYS) -> Column:
    """Thirty days after the due unit ends, no later than the close of a completed task."""
    return F.least(due_end + F.expr(f"INTERVAL {24 * days} HOURS"), closes)


def purge_eligible(value: Column, lasting: Column, ahead: list[Column], held_until: Column, hidden: Column, now: Column, tuning: Tuning = TUNING) -> Column:
    """Whether a chain's head may go: faded below the margin, no date of ``ahead`` still to end, no overdue task held."""
    free = ~hidden & (lasting < tuning.tau - NEVER_PURGED_MARGIN) & (value < tuning.tau - tuning.purge_margin)
    for end in (*ahead, held_until):
        free &= F.coalesce(end <= now, F.lit(True))
    return free


def corroborate_used(accesses: DataFrame, heads: DataFrame) -> DataFrame:
    """Add ``state``: ``used`` accesses in a chain's first such turn are pending, all others counted."""
    rows = accesses.join(heads, "memory_id")
    first = rows.where("kind = 'used'").groupBy("head_id").agg(F.min("turn").alias("_first"))
    held = (F.col("kind") == "used") & (F.col("turn") == F.col("_first"))
    return rows.join(first, "head_id", "left").withColumn("state", F.when(held, "pending").otherwise("counted")).drop("_first")


def _word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _key_spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pc.split_pattern(batch.column(0), " ")
        h, size = _word_hashes(words.flatten()), words.value_lengths().to_numpy()
        first = np.cumsum(size) - size
        keys = np.where(size > 1, mixed(h[first] * FACTOR + h[first + size - 1]), h[first])
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int64)), pa.array(spots_of(mixed(keys)))], ["kind", "spot"])


def _keys_said(passages: DataFrame, keys: DataFrame, scope: list[str]) -> DataFrame:
    """(passage_id, *scope, key): the words and pairs of neighbouring words of ``passages(passage_id, *scope, words)``, each once, that can be among ``keys(key)``.

    A map of hashed bits, of fixed size, keeps out the others where the text is, before anything is
    shuffled; it lets some through that are no key.
    """
    held = passages.sparkSession.sparkContext.broadcast(bit_maps(keys.select("key").distinct().mapInArrow(_key_spots, "kind long, spot long"))[0])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            words, code, row = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size)
            known = _word_hashes(words)
            one = np.unique((row * len(words) + code)[marked(held.value, mixed(known))[code]])
            h = known[code]
            two = np.flatnonzero((row[1:] == row[:-1]) & marked(held.value, mixed(mixed(h[:-1] * FACTOR + h[1:]))))
            pair, back = np.unique(row[two] * len(words) + code[two], return_inverse=True)
            both = np.unique(back * len(words) + code[two + 1])
            left, right = pair[both // len(words)], both % len(words)
            said = [words.take(pa.array(one % len(words))), pc.binary_join_element_wise(words.take(pa.array(left % len(words))), words.take(pa.array(right)), " ")]
            at = pa.array(np.concatenate((one, left)) // len(words))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(batch.num_columns - 1)), pa.concat_arrays([x.cast(pa.string()) for x in said])], [*batch.schema.names[:-1], "key"])

    rows = passages.select("passage_id", *scope, "words")
    return rows.mapInArrow(found, rows.select("passage_id", *scope, F.lit("").alias("key")).schema)


def phrases_found(passages: DataFrame, aliases: DataFrame, scope: list[str], salts: int = 8) -> DataFrame:
    """(passage_id, entity_id): where ``aliases(.., words)`` stand in ``passages(.., words)`` as whole words, within the columns ``scope``.

    They meet by the alias's first two words, or its one; only longer aliases are
    verified against the passage, which is joined again for that. What is found is told apart by
    passage and key before they meet, so only entities of several aliases need it of their pairs.
    """
    called = aliases.where(F.size("words") > 0).select("entity_id", *scope, "words", F.array_join(F.slice("words", 1, 2), " ").alias("key")).distinct()
    several = called.groupBy("entity_id").agg((F.count("*") > 1).alias("_several"))
    called = called.join(several, "entity_id").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    said = _keys_said(passages, called, scope).withColumn("_salt", F.pmod(F.xxhash64("passage_id"), F.lit(salts)))
    said = said.repartition(*scope, "key", "_salt").distinct()
    short, long = F.size("words") <= 2, F.size("words") > 2
    met = lambda rows: said.join(rows, [*scope, "key", "_salt"])
    single = met(called.where(short & ~F.col("_several"))).select("passage_id", "entity_id")
    repeated = met(called.where(short & F.col("_several"))).select("passage_id", "entity_id")
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    texts = passages.select("passage_id", spaced(F.col("words")).alias("said"))
    longer = met(called.where(long)).select("passage_id", "entity_id", "words").join(texts, "passage_id").where(F.contains(F.col("said"), spaced(F.col("words"))))
    rest = repeated.unionByName(longer.select("passage_id", "entity_id")).distinct()
    return single.unionByName(rest)


def entities_named(passages: DataFrame, aliases: DataFrame) -> DataFrame:
    """(passage_id, entity_id): aliases that occur as whole words."""
    return phrases_found(passages.select("passage_id", tokens(F.col("text")).alias("words")), aliases.select("entity_id", tokens(F.col("alias")).alias("words")), [])


def entity_summary(links: DataFrame, live: Column) -> DataFrame:
    """(entity_id, memories, live_memories, newest): one aggregate over the links."""
    return links.groupBy("entity_id").agg(
        F.count_distinct("memory_id").alias("memories"), F.count_distinct(F.when(live, F.col("memory_id"))).alias("live_memories"), F.max("memory_id").alias("newest")
    )


def interleave_facets(ranked: DataFrame, size: int = MODEL_POOL) -> DataFrame:
    """(model_id, memory_id, facet, position): facets take turns by rank, each memory once, where it came first."""
    best = ranked.groupBy("model_id", "memory_id").agg(F.min(F.struct("rank", "facet")).alias("at"))
    order = W.partitionBy("model_id").orderBy("at.rank", "at.facet", "memory_id")
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= size).select("model_id", "memory_id", "at.facet", "position")


def model_fingerprint(inputs: DataFrame) -> DataFrame:
    """(model_id, fingerprint) over (model_id, memory_id, content, significance); a model's input is at most a hundred rows."""
    line = F.concat_ws(":", F.lpad(F.col("memory_id").cast("string"), 20, "0"), F.sha2("content", 256), "significance")
    return inputs.groupBy("model_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


def current_answers(models: DataFrame, cites: DataFrame, memories: DataFrame, gone: Column) -> DataFrame:
    """(model_id, current): a model has cites, and all the memories it cites are there and still stand."""
    rows = cites.join(memories.select("memory_id", F.coalesce(gone, F.lit(False)).alias("_gone")), "memory_id", "left")
    rows = rows.groupBy("model_id").agg((~F.bool_or(F.coalesce("_gone", F.lit(True)))).alias("_current"))
    return models.select("model_id").join(rows, "model_id", "left").select("model_id", F.coalesce("_current", F.lit(False)).alias("current"))


def refresh_due(first: Column, last: Column, refreshed: Column, urgent: Column) -> Column:
    """Five quiet minutes after the last trigger, thirty after the first at most, thirty after the last refresh unless urgent."""
    waits = F.least(last + F.expr("INTERVAL 5 MINUTES"), first + F.expr("INTERVAL 30 MINUTES"))
    return F.when(urgent, waits).otherwise(F.greatest(waits, refreshed + F.expr("INTERVAL 30 MINUTES")))


def _begins(word: str):
    return lambda token: token.startswith(word)


def prefix_search(rows: DataFrame, text: str, query: str) -> DataFrame:
    """The rows in whose text every word of ``query`` begins a word."""
    said = tokens(F.col(text))
    wanted = [w for w in query.lower().split() if w]
    hit = F.lit(bool(wanted))
    for w in wanted:
        hit &= F.exists(said, _begins(w))
    return rows.where(hit)


def list_memories(memories: DataFrame, order: list[Column], size: int, page: int = 0) -> DataFrame:
    """One page in the given order, with its rows' numbers; only what the page needs is sorted to the end."""
    numbered = memories.orderBy(*order).limit((page + 1) * size).withColumn("number", F.row_number().over(W.orderBy(*order)))
    return numbered.where(F.col("number") > page * size)


def status_totals(memories: DataFrame, status: Column, chosen: list[str] | None = None) -> DataFrame:
    """(status, memories, total): a listing's rows by status before the choice of status, and how many are chosen."""
    rows = memories.groupBy(status.alias("status")).agg(F.count("*").alias("memories"))
    taken = F.col("status").isin(*chosen) if chosen else F.lit(True)
    return rows.withColumn("total", F.coalesce(F.sum(F.when(taken, F.col("memories"))).over(W.partitionBy()), F.lit(0)))  # one row per status


def week_bands(snapshots: DataFrame) -> DataFrame:
    """(bank_id, week, band, memories): each memory's last snapshot of an ISO week, Monday named."""
    week = F.date_trunc("week", F.col("taken_at")).cast("date")
    last = snapshots.groupBy("bank_id", "memory_id", week.alias("week")).agg(F.max(F.struct("taken_at", "value")).alias("at"))
    return last.groupBy("bank_id", "week", band(F.col("at.value")).alias("band")).agg(F.count("*").alias("memories"))


def report_diff(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(path, before, after) of two reports' (path, value) where they differ, a missing side null."""
    both = left.select("path", F.col("value").alias("before")).join(right.select("path", F.col("value").alias("after")), "path", "full_outer")
    scale = F.greatest(F.lit(1.0), F.abs("before"), F.abs("after"))
    return both.where(F.col("before").isNull() | F.col("after").isNull() | (F.abs(F.col("before") - F.col("after")) > tolerance * scale))


def probe_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, before, after) of the probes of two reports that did not end alike, a missing side null."""
    both = left.select("id", F.col("passed").alias("before")).join(right.select("id", F.col("passed").alias("after")), "id", "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def fate_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, difference) over two reports' (id, faded, purged): what only one of them made, faded or purged."""
    side = lambda df, n: df.select("id", F.struct("faded", "purged").alias(n))
    both = side(left, "a").join(side(right, "b"), "id", "full_outer")
    found = []
    for one, other in (("a", "b"), ("b", "a")):
        found.append(F.when(F.col(other).isNull(), F.lit(f"only_in_{one}")))
        for fate in ("faded", "purged"):
            mine, theirs = (F.coalesce(F.col(f"{x}.{fate}"), F.lit(False)) for x in (one, other))
            found.append(F.when(mine & ~theirs, F.lit(f"{fate}_only_in_{one}")))
    return both.select("id", F.explode(F.array_compact(F.array(*found))).alias("difference"))


def top_recall(scored: DataFrame, k: int = 8) -> DataFrame:
    """(sample, found, relevant): relevant candidates among a sample's k best and in all."""
    order = W.partitionBy("sample").orderBy(F.desc("score"), "memory_id")
    rows = scored.withColumn("_n", F.row_number().over(order))
    return rows.groupBy("sample").agg(F.sum(F.when(F.col("_n") <= k, F.col("relevant")).otherwise(0)).alias("found"), F.sum("relevant").alias("relevant"))


def claims_agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """(chunk, same_count, same_kinds) over (chunk, kind) of two runs; a chunk that one run lacks agrees in neither."""
    count = lambda df, name: df.groupBy("chunk", "kind").agg(F.count("*").alias(name))
    both = count(one, "a").join(count(two, "b"), ["chunk", "kind"], "full_outer").fillna(0, ["a", "b"])
    return both.groupBy("chunk").agg((F.sum("a") == F.sum("b")).alias("same_count"), F.bool_and(F.col("a") == F.col("b")).alias("same_kinds"))


def injection_usage(rows: DataFrame, keys: list[str], used: Column, unused: Column) -> DataFrame:
    """(keys, used, not_used, unjudged, rate) with used / (used + not_used), null where nothing was judged."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.groupBy(*keys).agg(n(used).alias("used"), n(unused).alias("not_used"), n(~used & ~unused).alias("unjudged"))
    return out.withColumn("rate", F.col("used") / F.nullif(F.col("used") + F.col("not_used"), F.lit(0)))
