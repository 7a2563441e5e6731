"""Aliases in passages: equal to a search text by text; words that begin no alias go no further than their text."""

import random

from pyspark.sql import functions as F

from anamnesis.operators import upkeep as U

PASSAGES, ALIASES = "passage_id long, bank_id long, words array<string>", "entity_id long, bank_id long, words array<string>"


def test_equal_to_a_search_text_by_text(spark):
    rng = random.Random(6)
    some = lambda n: [rng.choice(["a", "b", "c", "ß", "日本", "x1"]) for _ in range(n)]
    passages = [(i, i % 3, some(rng.randrange(15))) for i in range(60)] + [(60, 0, None), (61, 1, []), (62, 2, ["a"])]
    aliases = [(rng.randrange(25), rng.randrange(3), some(rng.randrange(5))) for _ in range(60)] + [(99, 0, None)]
    p, a = spark.createDataFrame(passages, PASSAGES), spark.createDataFrame(aliases, ALIASES)
    said = lambda words: f" {' '.join(words)} "
    for scope in ([], ["bank_id"]):
        want = {(i, e) for i, b, w in passages for e, c, v in aliases if w and v and said(v) in said(w) and (b == c or not scope)}
        got = [tuple(r) for r in U.phrases_found(p, a, scope).collect()]
        assert len(want) > 100 and sorted(got) == sorted(want)


def test_only_keys_leave_their_text(spark):
    """Every word and pair of all texts went through a shuffle."""
    p = spark.range(300).select(F.col("id").alias("passage_id"), F.split(F.concat(F.lit("the end of "), F.col("id").cast("string"), F.lit(" is the end")), " ").alias("words"))
    keys = spark.createDataFrame([("the end",), ("17",), ("none",)], "key string")
    assert sorted(tuple(r) for r in U._keys_said(p, keys, []).collect()) == sorted([(i, "the end") for i in range(300)] + [(17, "17")])
