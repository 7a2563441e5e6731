"""Preference formatting of paired conversations.

The longest common turn prefix of the chosen and the rejected conversation is
rendered once as the prompt; the turns after it are the two completions, each
with the character spans that a loss may use (assistant turns only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _header(turn: Column) -> Column:
    return F.length(turn["role"]) + 5


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """[start, end) in code points of what follows each assistant turn's header, its end mark included."""

    def step(acc: Column, turn: Column) -> Column:
        end = acc["at"] + F.length(_rendered(turn))
        span = F.struct((acc["at"] + _header(turn)).alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def preference_rows(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Rows (pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask).

    ``turns`` has conv_id, turn, role, text; ``pairs`` has pair_id, chosen_id and
    rejected_id. Without ``pairs``, conversations 2n and 2n + 1 make pair n, the
    even one chosen. A turn is common when role and text are equal; roles and
    texts that are null count as empty. Turns are ordered by turn, then role,
    then text, so ties and repeated rows have one order. Rows with a null
    conv_id belong to no conversation. A pair of which one conversation is
    missing has no common turns, and null for that side. Masks are arrays of
    [start, end) in code points of the completion.

    A conversation is the unit that is rendered, so its turns are gathered by
    conversation, never by content: many conversations with one first turn do
    not meet in one task.
    """
    clean = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    if pairs is None:
        side = clean.withColumn("pair_id", F.shiftright("conv_id", 1)).withColumn("even", F.pmod("conv_id", F.lit(2)) == 0)
        both = side.groupBy("pair_id").agg(
            F.min(F.when(F.col("even"), F.col("conv_id"))).alias("chosen_id"),
            F.min(F.when(~F.col("even"), F.col("conv_id"))).alias("rejected_id"),
            F.collect_list(F.when(F.col("even"), F.col("t"))).alias("a"),
            F.collect_list(F.when(~F.col("even"), F.col("t"))).alias("b"),
        )
    else:
        whole = clean.groupBy("conv_id").agg(F.collect_list("t").alias("all"))
        one = whole.select(F.col("conv_id").alias("chosen_id"), F.col("all").alias("a"))
        two = whole.select(F.col("conv_id").alias("rejected_id"), F.col("all").alias("b"))
        both = pairs.select("pair_id", "chosen_id", "rejected_id").join(one, "chosen_id", "left").join(two, "rejected_id", "left")
        none = F.array().cast(whole.schema["all"].dataType)
        both = both.withColumn("a", F.coalesce("a", none)).withColumn("b", F.coalesce("b", none))
    both = both.withColumn("a", F.array_sort("a")).withColumn("b", F.array_sort("b"))
    least = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", F.lit(1), least), F.slice("b", F.lit(1), least), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, False)
    both = both.withColumn("n_common", F.when(first > 0, first - 1).otherwise(least).cast("long"))
    both = both.withColumn("_from", (F.col("n_common") + 1).cast("int"))
    after = {s: F.slice(s, F.col("_from"), F.greatest(F.size(s), F.lit(1))) for s in "ab"}
    both = both.withColumn("p", F.slice("a", F.lit(1), F.col("n_common").cast("int"))).withColumn("c", after["a"]).withColumn("r", after["b"])
    return both.select(
        F.col("pair_id").cast("long").alias("pair_id"), "chosen_id", "rejected_id", "n_common", _render(F.col("p")).alias("prompt"),
        F.when(F.size("a") > 0, _render(F.col("c"))).alias("chosen"), F.when(F.size("b") > 0, _render(F.col("r"))).alias("rejected"),
        F.when(F.size("a") > 0, _spans(F.col("c"))).alias("chosen_mask"), F.when(F.size("b") > 0, _spans(F.col("r"))).alias("rejected_mask"),
    )


def mask_text(mask: Column) -> Column:
    """The spans as ``start-end`` joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
