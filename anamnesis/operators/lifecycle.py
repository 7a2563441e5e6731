"""What sweeps, purges, forgetting, removal and the owner's edits do to the tables of all banks."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anamnesis.operators.passages import equal_passages

MASK, HORIZON_DAYS = "█", 90


def sweepable(sources: DataFrame, memories: DataFrame, now: str, days: int = HORIZON_DAYS) -> DataFrame:
    """The sources past the horizon that no memory rests on and nothing queued waits for."""
    old = F.col("ingested_at").cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {24 * days} HOURS")
    return sources.where(old & ~F.col("tombstoned") & ~F.col("queued")).join(memories.select("source_id").distinct(), "source_id", "left_anti")


def sweep_sources(sources: DataFrame, memories: DataFrame, recalls: DataFrame, now: str, days: int = HORIZON_DAYS) -> tuple[DataFrame, DataFrame]:
    """(sources after the sweep, counts per bank): swept sources lose their text and become tombstones.

    Old failed chunks lose text whatever rests on their source; old recalls lose
    query and results, and are counted here.
    """
    gone = sweepable(sources, memories, now, days).select("source_id", F.lit(True).alias("_swept"))
    old = lambda c: F.col(c).cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {24 * days} HOURS")
    rows = sources.join(gone, "source_id", "left").withColumn("_swept", F.coalesce("_swept", F.lit(False)))
    counts = rows.groupBy("bank_id").agg(F.sum(F.col("_swept").cast("long")).alias("sources"), F.sum((F.col("failed") & ~F.col("tombstoned") & old("ingested_at")).cast("long")).alias("failed"))
    seen = recalls.groupBy("bank_id").agg(F.sum(old("recalled_at").cast("long")).alias("recalls"))
    counts = counts.join(seen, "bank_id", "full_outer").fillna(0)
    after = rows.withColumn("text", F.when(~(F.col("_swept") | (F.col("failed") & old("ingested_at"))), F.col("text"))).withColumn("tombstoned", F.col("tombstoned") | F.col("_swept"))
    return after.select(*sources.columns), counts


def purge(eligible_heads: DataFrame, heads: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the eligible chains: rows keyed by memory_id go, pointers at them are cleared.

    ``purged(memory_id, head_id)`` comes back too, for the edit log.
    """
    gone = heads.join(eligible_heads.select(F.col("memory_id").alias("head_id")), "head_id", "left_semi")
    out = {"purged": gone.select("memory_id", "head_id")}
    for name, rows in tables.items():
        rows = rows.join(gone.select("memory_id"), "memory_id", "left_anti")
        for pointer in ("superseded_by", "ended_by"):
            if pointer in rows.columns:
                hit = gone.select(F.col("memory_id").alias(pointer), F.lit(True).alias("_gone"))
                columns = rows.columns
                rows = rows.join(hit, pointer, "left").withColumn(pointer, F.when(F.col("_gone").isNull(), F.col(pointer))).select(*columns)
        out[name] = rows
    return out


def forget_hide(asked: DataFrame, memories: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, unknown ids): the whole chain of every named memory hidden."""
    chains = asked.join(heads, "memory_id").select("head_id").distinct()
    hidden = heads.join(chains, "head_id", "left_semi").select("memory_id", F.lit(True).alias("_hide"))
    rows = memories.join(hidden, "memory_id", "left").withColumn("hidden", F.col("hidden") | F.coalesce("_hide", F.lit(False))).select(*memories.columns)
    return rows, asked.join(memories, "memory_id", "left_anti").select("memory_id").distinct()


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """Every character of the spans but newlines masked; the length stays."""
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = max(a, at), min(b, len(text))
        if a < b:
            out += [text[at:a], re.sub(r"[^\n]", MASK, text[a:b])]
            at = b
    return "".join([*out, text[at:]])


class Passages:
    """An automaton of passages over bit vectors: one bit per character of all passages, one pass over a text for all of them."""

    def __init__(self, passages: Iterable[str]):
        self.ends: dict[int, int] = {}
        self.first, self.masks, self.all, at = 0, 0, 0, 0
        self.equal: dict[str, int] = {}
        for passage in sorted({p for p in passages if p}):
            self.first |= 1 << at
            for c in passage:
                if c == MASK:
                    self.masks |= 1 << at
                else:
                    self.equal[c] = self.equal.get(c, 0) | 1 << at
                at += 1
            self.ends[1 << at - 1] = len(passage)
        self.all = (1 << at) - 1
        self.accept = sum(self.ends)
        self.signs = {c: 0 if c.isspace() else bits for c, bits in self.equal.items()}

    def found(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every passage in the text, overlapping ones too; a mask on either side stands for any character.

        Some character that is neither mask nor white space has to be equal: the states that have
        met one are a second vector.
        """
        out, states, sure = [], 0, 0
        for end, c in enumerate(text, 1):
            fits = self.all if c == MASK else self.equal.get(c, 0) | self.masks
            states = (states << 1 | self.first) & fits
            sure = states & ((sure << 1 & ~self.first) | self.signs.get(c, 0))
            hits = sure & self.accept
            while hits:
                last = hits & -hits
                out.append((end - self.ends[last], end))
                hits ^= last
        return sorted(set(out))


@functools.lru_cache(maxsize=16)
def _automaton(wanted: tuple[str, ...]) -> Passages:
    return Passages(wanted)


def occurrences(passage: str, text: str) -> list[tuple[int, int]]:
    return Passages([passage]).found(text)


@F.pandas_udf(T.StringType())
def mask_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    """``text`` with an array of (start, end) masked; null stays null."""
    return pd.Series([None if t is None else masked(t, [(int(s["start"]), int(s["end"])) for s in (x if x is not None else [])]) for t, x in zip(text, spans, strict=True)], dtype=object)


def redact_passages(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``texts(key, text)`` with the passages ``spans(key, start, end)`` masked."""
    by = spans.groupBy(key).agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("_spans"))
    rows = texts.join(by, key, "left")
    return rows.withColumn("text", F.when(F.col("_spans").isNotNull(), mask_spans("text", "_spans")).otherwise(F.col("text"))).drop("_spans")


def turn_spans(spans: DataFrame, turns: DataFrame, separator: int = 2) -> DataFrame:
    """(source_id, part, start, end): spans of a turn's one chunk, split between what the user said and the reply."""
    size = F.length("user_text")
    rows = spans.join(turns.select("source_id", size.alias("_n")), "source_id")
    said = rows.select("source_id", F.lit("user").alias("part"), "start", F.least("end", "_n").alias("end"))
    after = rows.select("source_id", F.lit("reply").alias("part"), F.greatest(F.lit(0), F.col("start") - F.col("_n") - separator).alias("start"), (F.col("end") - F.col("_n") - separator).alias("end"))
    return said.unionByName(after).where("start < `end`")


def redact_versions(versions: DataFrame, passages: DataFrame, together: int = 4_096) -> DataFrame:
    """(version_id, start, end): where a document's passages stand in its versions.

    ``versions(version_id, document_id, text)``, ``passages(document_id, passage)``. Passages and
    versions without a mask meet by hashes, all in one pass over the texts. Where either has masks, a document's
    passages are dealt into automata of about ``together`` characters, and each version is read once by each.
    """

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def find(wanted: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in _automaton(tuple(w)).found(t or "")] for w, t in zip(wanted, text, strict=True)])

    def searched(versions: DataFrame, rows: DataFrame) -> DataFrame:
        parts = rows.groupBy("document_id").agg(F.ceil(F.sum(F.length("passage")) / together).alias("_parts"))
        automata = rows.join(parts, "document_id").groupBy("document_id", F.pmod(F.xxhash64("passage"), "_parts").alias("_part")).agg(F.collect_list("passage").alias("_wanted"))
        found = versions.join(automata, "document_id").select("version_id", F.explode(find("_wanted", "text")).alias("s"))
        return found.select("version_id", "s.start", "s.end")

    rows = passages.where("passage <> ''").distinct()
    torn = F.contains("text", F.lit(MASK))
    plain, masked_ = (rows.where(c) for c in (~F.contains("passage", F.lit(MASK)), F.contains("passage", F.lit(MASK))))
    found = equal_passages(versions.where(~torn), plain).unionByName(searched(versions.where(torn), rows)).unionByName(searched(versions.where(~torn), masked_))
    return found.distinct()


def delete_orphan_entities(entities: DataFrame, links: DataFrame, speakers: DataFrame, filters: DataFrame) -> DataFrame:
    """The entities that stay: seeded, merged, linked, merged into, filtered on by a model, or a speaker's."""
    used = links.select("entity_id").union(speakers.select("entity_id")).union(filters.select("entity_id"))
    used = used.union(entities.where("merged_into IS NOT NULL").select(F.col("merged_into").alias("entity_id"))).distinct()
    orphans = entities.where("NOT seeded AND merged_into IS NULL").join(used, "entity_id", "left_anti").select("entity_id")
    return entities.join(orphans, "entity_id", "left_anti")


def remove_sources(asked: DataFrame, sources: DataFrame, memories: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, memories, counts): removed sources lose their text and their place in the queue, and the chains that rest on them are hidden.

    ``asked(bank_id, document_id, source_id)``: a document with all its versions, or one turn.
    """
    docs = asked.where("document_id IS NOT NULL").select("bank_id", "document_id").distinct()
    turns = asked.where("source_id IS NOT NULL").select("source_id").distinct()
    gone = sources.join(docs, ["bank_id", "document_id"], "left_semi").select("source_id").union(sources.where("kind = 'turn'").join(turns, "source_id", "left_semi").select("source_id")).distinct().withColumn("_gone", F.lit(True))
    after = sources.join(gone, "source_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)) & ~F.col("removed"))
    counts = after.groupBy("bank_id").agg(F.sum((F.col("_gone") & (F.col("kind") == "document")).cast("long")).alias("documents"), F.sum((F.col("_gone") & (F.col("kind") == "turn")).cast("long")).alias("turns"))
    chains = memories.join(gone, "source_id").join(heads, "memory_id").select("head_id").distinct()
    hide = heads.join(chains, "head_id", "left_semi").select("memory_id", F.lit(True).alias("_hide"))
    kept = memories.join(hide, "memory_id", "left").withColumn("hidden", F.col("hidden") | F.coalesce("_hide", F.lit(False))).select(*memories.columns)
    rows = after.withColumns({"text": F.when(~F.col("_gone"), F.col("text")), "queued": F.col("queued") & ~F.col("_gone"), "removed": F.col("removed") | F.col("_gone")})
    return rows.select(*sources.columns), kept, counts


def owner_edits(edits: DataFrame, memories: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, log, refused) after ``edits(edit_id, memory_id, action, value)``: keep, unkeep, significance, retract, end, reopen.

    Only heads that are not retracted or hidden can be edited; of several edits of
    one field the last counts. To end is a minute ago; to retract reopens what the
    memory had ended; to reopen clears an end.
    """
    actions = ("keep", "unkeep", "significance", "retract", "end", "reopen")
    heads = memories.where("superseded_by IS NULL AND NOT retracted AND NOT hidden").select("memory_id")
    may = edits.where(F.col("action").isin(*actions)).join(heads, "memory_id", "left_semi")
    refused = edits.join(may.select("edit_id"), "edit_id", "left_anti")
    last = lambda *of: F.max_by(F.struct("action", "value"), F.when(F.col("action").isin(*of), F.col("edit_id")))
    some = lambda *of: F.max(F.when(F.col("action").isin(*of), F.col("edit_id"))).isNotNull()
    by = may.groupBy("memory_id").agg(F.when(some("keep", "unkeep", "significance"), last("keep", "unkeep", "significance")).alias("_s"), some("retract").alias("_r"), F.when(some("end", "reopen"), last("end", "reopen")).alias("_e"))
    rows = memories.join(by, "memory_id", "left")
    freed = by.where("_r").select(F.col("memory_id").alias("ended_by"), F.lit(True).alias("_free"))
    rows = rows.join(freed, "ended_by", "left")
    ago = F.date_trunc("minute", F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 MINUTE"))
    open_ = F.coalesce(F.col("_e.action") == "reopen", F.lit(False)) | F.coalesce("_free", F.lit(False))
    ends = F.coalesce(F.col("_e.action") == "end", F.lit(False))
    level = F.when(F.col("_s.action") == "keep", "kept").when(F.col("_s.action") == "unkeep", None).when(F.col("_s.action") == "significance", F.col("_s.value")).otherwise(F.col("owner_significance"))
    new = {
        "owner_significance": level, "retracted": F.col("retracted") | F.coalesce("_r", F.lit(False)),
        "valid_until": F.when(ends, ago).when(~open_, F.col("valid_until").cast("timestamp")), "ended_by": F.when(~(ends | open_), F.col("ended_by")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in memories.columns]), may, refused


def carry_accesses(held: DataFrame, memories: DataFrame) -> DataFrame:
    """(access_id, memory_id): held accesses go to the new memory of their chunk whose span overlaps theirs most, ties to the lower id; others are dropped.

    ``held(access_id, chunk_id, start, end)``, ``memories(memory_id, chunk_id, start, end)``.
    """
    spans = memories.select("memory_id", "chunk_id", F.col("start").alias("_a"), F.col("end").alias("_b"))
    rows = held.join(spans, "chunk_id").withColumn("_shared", F.least("end", "_b") - F.greatest("start", "_a")).where("_shared > 0")
    return rows.groupBy("access_id").agg(F.min(F.struct((-F.col("_shared")).alias("s"), "memory_id")).alias("best")).select("access_id", "best.memory_id")


def rebuild_survey(sources: DataFrame) -> DataFrame:
    """(bank_id, outcome, sources): what a new extraction would run again, and why it would leave the rest out."""
    outcome = F.when(F.col("removed"), "removed").when(F.col("tombstoned"), "swept").when(F.col("text").contains(MASK), "masked").when(F.col("text").isNull() | (F.col("text") == ""), "empty").otherwise("rerun")
    return sources.groupBy("bank_id", outcome.alias("outcome")).agg(F.count("*").alias("sources"))


def newest(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The newest rows of each bank, numbered."""
    return rows.withColumn("number", F.row_number().over(W.partitionBy("bank_id").orderBy(F.desc(order), F.desc("id")))).where(F.col("number") <= most)
