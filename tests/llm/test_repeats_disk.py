"""Removal of repeats leaves only the small tables that its rows are read from."""

import random
from pathlib import Path

from anamnesis.llm import common, repeats
from anamnesis.llm.repeats import remove_repeats


def test_spent_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path / "shared"))
    text = "some words that stand in both of the texts, and go on for a while"
    spark.createDataFrame([(1, text + " one"), (2, "two " + text), (3, "other"), (4, None)], "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "docs"))
    out = remove_repeats(spark.read.parquet(str(tmp_path / "docs")), 40, 12)
    left = sorted(p.name.rsplit("-", 1)[0] for p in Path(tmp_path, "shared", "anamnesis").iterdir())
    assert left == ["files", "repeats-digests", "repeats-removed"]
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: len(text), 2: len(text), 3: 0, 4: 0}


def test_bytes_on_disk_while_anchors_are_filtered(spark, tmp_path, monkeypatch, request):
    """Anchors that occur once, nearly all, are shuffled once and in few bytes."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path / "shared"))
    rng = random.Random(3)
    for key, value in (("adaptive.enabled", "false"), ("autoBroadcastJoinThreshold", "-1")):  # small tables are dealt out as large ones are
        request.addfinalizer(lambda key=f"spark.sql.{key}", was=spark.conf.get(f"spark.sql.{key}"): spark.conf.set(key, was))
        spark.conf.set(f"spark.sql.{key}", value)
    rows = [(i, "%04000x" % rng.getrandbits(16_000)) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {p: p.stat().st_size for d in local for p in Path(d).glob("*/shuffle_*.data")}
    before, found, stage = set(shuffled()), {}, repeats.staged

    def measured(df, name):
        out = stage(df, name)
        if name == "repeats-texts":
            found["anchors"] = out.selectExpr("sum(size(at))").first()[0]
        if name == "repeats-again":
            found["bytes"] = sum(n for p, n in shuffled().items() if p not in before)
            found["bytes"] += sum(p.stat().st_size for p in Path(tmp_path, "shared").rglob("*.parquet"))
        return out

    monkeypatch.setattr(repeats, "staged", measured)
    assert remove_repeats(spark.read.parquet(str(tmp_path / "docs"))).selectExpr("sum(n_removed)").first()[0] == 0
    assert found["anchors"] > 50_000
    assert found["bytes"] < 110 * found["anchors"]
