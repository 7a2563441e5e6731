"""The pipeline's stages judge rows, not doc_ids: null and repeated ids share no verdict."""

import random

from anamnesis.llm.common import staged
from anamnesis.llm.decontaminate import decontaminate_stage
from anamnesis.llm.jaccard_join import jaccard_stage
from anamnesis.llm.quality import quality_stage


def words(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def kept(spark, stage, rows, sf_dir=None):
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string, source string"), "stage-test")
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    return sorted(out.select("doc_id", "text").collect(), key=str)


def test_quality_stage(spark):
    prose = "The people of the town were glad to see that the old bridge had been built again, and they said so to each other on the way to the market. "
    good = [(None if k % 2 else 1, prose * 3 + f"It was the {k}th day of the year, and the sun was out.", "a") for k in range(40)]
    rows = [*good, (None, "", "a"), (1, None, "a")]
    assert kept(spark, quality_stage, rows) == sorted([(d, t) for d, t, _ in good], key=str)


def test_decontaminate_stage(spark, tmp_path):
    item = words(1, 12)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, words(2) + " " + item, "a"), (None, words(3), "a"), (4, words(4), "a"), (4, item, "a")]
    assert kept(spark, decontaminate_stage, rows, str(tmp_path)) == sorted([(None, words(3)), (4, words(4))], key=str)


def test_jaccard_stage(spark):
    one, two, three = words(5), words(6), words(7)
    rows = [(None, one, "a"), (None, one + " end", "a"), (8, two + " end", "a"), (9, two, "a"), (9, three, "a"), (None, "", "a"), (3, None, "a"), (10, three + " end", "a"), (None, three, "a")]
    got = kept(spark, jaccard_stage, rows)
    mine = [t for d, t in got if d is None and t]
    assert len(mine) == 1 and mine[0].startswith(one)
    assert [(d, t) for d, t in got if d is not None] == [(3, None), (8, two + " end"), (9, three)] and (None, "") in got
