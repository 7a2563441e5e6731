"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the keys are range
sorted, distributed prefix sums of the sizes are formed, and the mix is cut at
the source's exact budget; a budget above the source's size repeats epochs.

The key space is cut into ranges of equal width, so a source holding a third of
all rows is spread over many ranges; the sums of the ranges make a small table
(sources x ranges), whose running sums give every range its start. No group
larger than a range's rows is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names, placed, staged, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_RANGE = 50_000


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _running(rows: DataFrame, keys: list[str], order: Column, values: dict[str, str], ranges: int) -> DataFrame:
    """Add each value's sum over the rows before this one by (keys, order).

    ``order`` is a double in [0, 1); ``ranges`` cuts it. The rows of a range are
    summed by a window, the ranges by a window over their totals.
    """
    rows = rows.withColumn("_range", F.floor(order * ranges).cast("long"))
    group = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    starts = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t_{v}").over(group), F.lit(0)).alias(f"_s_{v}") for v in values])
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inner = W.partitionBy(*keys, "_range").orderBy("_key", "doc_id", "_size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    out = rows.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_i_{v}") for v in values])
    out = out.join(starts, same)
    for v, name in values.items():
        out = out.withColumn(name, F.col(f"_i_{v}") + F.col(f"_s_{v}"))
    return out.drop("_range", "_r", *[f"_k_{k}" for k in keys], *[f"_{p}_{v}" for v in values for p in "is"])


def targets(sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources in code point order, null last. The share
    is dealt by weight; a source whose part is above ``epochs`` times its size
    stops there and the excess goes to the others by weight, until none is
    above. Sources are capped in the order of cap / weight, so running sums in
    that order give the final rate in one pass. The table has one row per
    source; that is the only thing its two windows hold.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    total, all_weight = F.sum("source_size").over(everything) * share, F.sum("weight").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.select("source", "source_size", "weight", "cap", (left / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("rate"))
    rows = rows.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("rate"))
    first = F.row_number().over(W.orderBy(F.col("capped").desc(), F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))
    rows = rows.withColumn("_n", first)
    final = F.first(F.when(~F.col("capped"), F.col("rate")), ignorenulls=True).over(W.orderBy("_n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("_final", final).select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("_final")).alias("target"))


def mixed(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, seed: int = 17, rows_per_range: int = ROWS_PER_RANGE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, epochs, rest).

    ``taken`` counts the words that the mix takes of the document: its size
    once per full epoch, and in the last epoch as much as the budget leaves
    (the document at the cut gives its first ``rest`` words), so a source's
    taken words are its target rounded down. Null texts have size 0 and are
    taken 0 times; null sources are one source; an empty table gives no rows;
    repeated rows count as rows of their own. The same rows give the same mix,
    whatever their order or partitions. ``carry`` names columns to keep.
    """
    rows = docs.select("doc_id", "source", text_of().alias("_text"), *carry)
    rows = rows.select(
        "doc_id", "source", size_of(F.col("_text")).alias("_size"), F.xxhash64("_text").alias("_tie"),
        (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / float(1 << 53)).alias("_key"), *carry,
    )
    rows = staged(rows, "mixing-sizes")
    by_source = rows.groupBy("source").agg(F.sum("_size").alias("source_size"))
    aims = targets(by_source, share, weights, epochs).withColumnRenamed("source", "_source")
    ranges = max(1, -(-rows.count() // rows_per_range))
    rows = _running(rows, ["source"], F.col("_key"), {"_size": "_before"}, ranges)
    rows = rows.join(aims, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor(F.col("target")).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("_size"), budget - full * F.col("source_size") - F.col("_before"))).cast("long")
    rows = rows.withColumn("epochs", full).withColumn("rest", rest)
    return rows.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("_size") + F.col("rest")).alias("taken"), "epochs", "rest", *carry)


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: one row per document and epoch, the text cut to the words taken.

    All columns of ``docs`` come first, whatever their names; then mix_epoch,
    mix_words and mix_target, with an underscore more where ``docs`` has such a
    column. Null, empty and blank texts have no words and are not in the mix.
    """
    where, *place = placed(docs)
    own, mine = docs.columns, free_names(where.columns, "mix_epoch", "mix_words", "mix_target", "_mix_size")
    plan = mixed(where.select("doc_id", "source", "text", *place), carry=tuple(place)).where("taken > 0")
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.lit(1), (F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0)).cast("int"))))
    words = F.when(F.col("epoch") <= F.col("epochs"), F.col("size")).otherwise(F.col("rest"))
    plan = plan.select(*place, *[c.alias(name) for c, name in zip((F.col("epoch"), words, F.col("target"), F.col("size")), mine, strict=True)])
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    rows = where.join(plan, place)
    text = F.when(F.col(mine[1]) == F.col(mine[3]), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col(mine[1]).cast("int")), ""))
    return rows.withColumn("text", text).select(*[f"`{c}`" for c in own], *mine[:3])
