"""Entities and mental models: naming, merging, links, pools, facets and triggers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anamnesis.operators import strength as S
from anamnesis.operators.recall import tokens
from anamnesis.operators.upkeep import phrases_found

PER_FACET, CANDIDATES = 20, 30
_VOLATILITY = ("hours", "days", "weeks", "months", "years")


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Text without case and diacritics, composed."""
    bare = lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t.casefold()) if not unicodedata.combining(c)))
    return text.map(lambda t: None if t is None else bare(t))


def named_in(passages: DataFrame, aliases: DataFrame, survivors: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(passage_id, entity_id): entities whose alias stands in the passage as whole words, case and diacritics apart, resolved through merges, less ``excluded``.

    Passages and aliases meet within their bank.
    """
    words = lambda c: tokens(folded(c))
    hits = phrases_found(passages.select("passage_id", "bank_id", words("text").alias("words")), aliases.select("entity_id", "bank_id", words("alias").alias("words")), ["bank_id"])
    hits = hits.join(survivors, "entity_id").select("passage_id", F.col("survivor_id").alias("entity_id")).distinct()
    return hits.join(excluded, "entity_id", "left_anti").select("passage_id", "entity_id") if excluded is not None else hits


def found_entities(named: DataFrame, links: DataFrame, survivors: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(passage_id, entity_id, links, rank): a passage's entities by their number of links, then the lower id."""
    counts = links.join(survivors, "entity_id").groupBy(F.col("survivor_id").alias("entity_id")).agg(F.count_distinct("memory_id").alias("links"))
    rows = named.join(counts, "entity_id", "left").fillna(0, ["links"])
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("passage_id").orderBy(F.desc("links"), "entity_id"))).where(F.col("rank") <= most).select("passage_id", "entity_id", "links", "rank")


def resolve_entity(asked: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(reference_id, entity_id, outcome): a reference by id, or by name or alias whatever its case; several unmerged hits are ambiguous.

    ``asked(reference_id, bank_id, reference)``, ``entities(entity_id, bank_id,
    name, merged_into)``, ``aliases(entity_id, bank_id, alias)``.
    """
    low = lambda c: F.lower(F.trim(c))
    names = entities.where("merged_into IS NULL").select("bank_id", "entity_id", low(F.col("name")).alias("key"))
    called = aliases.join(entities.where("merged_into IS NULL").select("entity_id"), "entity_id", "left_semi").select("bank_id", "entity_id", low(F.col("alias")).alias("key"))
    keys = names.union(called).union(entities.select("bank_id", "entity_id", F.col("entity_id").cast("string").alias("key"))).distinct()
    hits = asked.withColumn("key", low(F.col("reference"))).join(keys, ["bank_id", "key"], "left").groupBy("reference_id").agg(F.count("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    outcome = F.when(F.col("n") == 0, "unknown").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return hits.select("reference_id", F.when(F.col("n") == 1, F.col("entity_id")).alias("entity_id"), outcome.alias("outcome"))


def merge_entities(merges: DataFrame, entities: DataFrame, links: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, links, aliases, moved) after ``merges(entity_id, into_id)``, one per entity.

    Links and aliases that ``into`` lacks move to it, others are dropped from the
    merged one's; ``moved(entity_id, into_id, memory_id, alias)`` is what an
    unmerge has to move back.
    """
    into = merges.select("entity_id", "into_id")
    e = entities.join(into, "entity_id", "left").withColumn("merged_into", F.coalesce("into_id", "merged_into")).select(*entities.columns)

    def shifted(rows: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
        own = rows.join(into, "entity_id")
        new = own.join(rows.select(F.col("entity_id").alias("into_id"), what), ["into_id", what], "left_anti").dropDuplicates(["into_id", what])
        stay = rows.join(into, "entity_id", "left_anti")
        return stay.unionByName(new.withColumn("entity_id", F.col("into_id")).select(*rows.columns)), new.select("entity_id", "into_id", what)

    after, linked = shifted(links, "memory_id")
    names, called = shifted(aliases, "alias")
    return e, after, names, linked.withColumn("alias", F.lit(None).cast("string")).unionByName(called.withColumn("memory_id", F.lit(None).cast("long")))


def unmerge_entities(moved: DataFrame, entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, links): exactly what ``moved`` names goes back to the entities it came from."""
    back = moved.where("memory_id IS NOT NULL").select(F.col("into_id").alias("entity_id"), "memory_id", F.col("entity_id").alias("_own"))
    rows = links.join(back, ["entity_id", "memory_id"], "left").withColumn("entity_id", F.coalesce("_own", "entity_id")).select(*links.columns)
    freed = moved.select("entity_id", F.lit(True).alias("_free")).distinct()
    e = entities.join(freed, "entity_id", "left").withColumn("merged_into", F.when(F.col("_free").isNull(), F.col("merged_into"))).select(*entities.columns)
    return e, rows


def edit_links(edits: DataFrame, links: DataFrame, survivors: DataFrame) -> DataFrame:
    """``links`` after ``edits(memory_id, bank_id, entity_id, action)``, add or remove, both through merges; the two do not meet."""
    own = edits.join(survivors, "entity_id").select("memory_id", "bank_id", F.col("survivor_id").alias("entity_id"), "action")
    gone = own.where("action = 'remove'").select("memory_id", F.col("entity_id").alias("survivor_id"))
    left = links.join(survivors, "entity_id", "left").withColumn("survivor_id", F.coalesce("survivor_id", "entity_id")).join(gone, ["memory_id", "survivor_id"], "left_anti").select(*links.columns)
    add = own.where("action = 'add'").select(*links.columns)
    return left.unionByName(add).dropDuplicates(["memory_id", "entity_id"])


def relink_alias(links: DataFrame, alias: DataFrame) -> DataFrame:
    """``links(memory_id, entity_id, surface_form)`` after ``alias(entity_id, alias, to_id)`` was taken from one entity and given to another: those made by its form move."""
    key = alias.select("entity_id", F.lower("alias").alias("_form"), "to_id")
    rows = links.withColumn("_form", F.lower("surface_form")).join(key, ["entity_id", "_form"], "left")
    return rows.withColumn("entity_id", F.coalesce("to_id", "entity_id")).select(*links.columns).distinct()


def model_pool(memories: DataFrame, filters: DataFrame, links: DataFrame, now: str) -> DataFrame:
    """(model_id, memory_id): what a model may be written from.

    ``filters(model_id, bank_id, kinds, entity_id, least_volatility)``; nulls admit
    all. ``memories`` has value and phase. A state has to be at least that
    steady; what has faded, ended or is long past is out.
    """
    rank = lambda c: F.array_position(F.array(*[F.lit(v) for v in _VOLATILITY]), c)
    live = memories.where("NOT retracted AND NOT hidden AND superseded_by IS NULL").where((F.col("value") >= S.TUNING.tau) & (F.col("phase") != "long_past") & ~S.has_ended(memories, F.lit(now).cast("timestamp")))
    rows = filters.join(live, "bank_id").where(F.col("kinds").isNull() | F.array_contains("kinds", F.col("kind")))
    rows = rows.where((F.col("kind") != "state") | F.col("least_volatility").isNull() | F.col("volatility").isNull() | (rank(F.col("volatility")) >= rank(F.col("least_volatility"))))
    of = links.select("memory_id", F.col("entity_id").alias("_e")).distinct()
    free = rows.where("entity_id IS NULL").select("model_id", "memory_id")
    return free.unionByName(rows.where("entity_id IS NOT NULL").join(of, (rows["memory_id"] == of["memory_id"]) & (rows["entity_id"] == of["_e"])).select("model_id", rows["memory_id"]))


def facet_rank(scored: DataFrame, cites: DataFrame, most: int = PER_FACET) -> DataFrame:
    """(model_id, facet, memory_id, rank, cited): the best of each facet, then the cited memories that it has not."""
    held = cites.select("model_id", "memory_id", F.lit(True).alias("cited")).distinct()
    rows = scored.join(held, ["model_id", "memory_id"], "left").fillna(False, ["cited"])
    own = W.partitionBy("model_id", "facet")
    rows = rows.withColumn("_n", F.row_number().over(own.orderBy(F.desc("score"), "memory_id"))).where((F.col("_n") <= most) | F.col("cited"))
    return rows.withColumn("rank", F.row_number().over(own.orderBy("_n"))).select("model_id", "facet", "memory_id", "rank", "cited")


def model_triggers(models: DataFrame, cites: DataFrame, memories: DataFrame, links: DataFrame, edits: DataFrame, since: str) -> DataFrame:
    """(model_id, reason): the models that new memories or edits since the watermark concern.

    ``models(model_id, bank_id, kinds, entity_id)``; a new memory concerns those
    whose filters admit it, an edit of a cited memory those that cite it.
    """
    mark = F.lit(since).cast("timestamp")
    new = memories.where(F.col("observed_at").cast("timestamp") > mark).select("memory_id", "bank_id", "kind")
    hit = models.join(new, "bank_id").where(F.col("kinds").isNull() | F.array_contains("kinds", F.col("kind")))
    of = links.select("memory_id", F.col("entity_id").alias("_e")).distinct()
    free = hit.where("entity_id IS NULL").select("model_id")
    tied = hit.where("entity_id IS NOT NULL").join(of, (hit["memory_id"] == of["memory_id"]) & (hit["entity_id"] == of["_e"])).select("model_id")
    cited = cites.join(edits.where(F.col("edited_at").cast("timestamp") > mark).select("memory_id").distinct(), "memory_id", "left_semi").select("model_id")
    return free.union(tied).distinct().withColumn("reason", F.lit("new_memory")).union(cited.distinct().withColumn("reason", F.lit("cited_edit")))
