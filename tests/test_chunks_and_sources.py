import random

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import chunking as C
from anamnesis.operators import upkeep as U
from anamnesis.plans import registry, upkeep
from anamnesis.sources import history as S
from anamnesis.streaming.counts import stream_counts

TEXT = "intro\n\n# One #\nbody\n```\n# not a heading\n```\n## Two\n#tag\n\n# Three\n\n\n"


def test_sections_follow_headings_outside_fences():
    got = [(p, TEXT[a:b].strip().splitlines()[0]) for p, a, b in C.sections(TEXT)]
    assert got == [([], "intro"), (["One"], "# One #"), (["One", "Two"], "## Two"), (["Three"], "# Three")]
    assert C.sections(" \n\n") == [] and C.sections("") == []


@pytest.mark.parametrize("limit", [1, 7, 40, 3000])
def test_chunks_keep_all_but_blanks_and_the_limit(limit):
    rng = random.Random(limit)
    text = "".join(rng.choice(["word ", "End. ", "\n", "\n\n", "é", "x" * 9, "\n# H\n", "\t"]) for _ in range(900))
    spans = [s for _, a, b in C.sections(text) for s in C.cut(text, a, b, limit)]
    assert all(0 < b - a <= limit for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join("".join(text[a:b] for a, b in spans).split()) == "".join(text.split())


def test_paragraphs_are_packed_and_long_ones_cut_at_sentences():
    text = "aa bb\n\ncc dd\n\n" + "One two. " * 5
    assert [text[a:b] for a, b in C.cut(text, 0, len(text), 14)] == ["aa bb\n\ncc dd", "One two.", "One two.", "One two.", "One two.", "One two."]


def test_a_chunk_of_an_earlier_version_is_skipped(spark):
    rows = spark.createDataFrame([("d", 1, "x"), ("d", 1, "x"), ("d", 2, "x"), ("d", 2, "y"), ("e", 2, "x")], "document string, version long, chunk_hash string")
    got = sorted((r.document, r.version, r.chunk_hash, r.outcome) for r in C.new_chunks(rows).collect())
    assert [g[3] for g in got] == ["queued", "queued", "skipped", "queued", "queued"]


def test_the_purge_guards(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, -1.0D, -2.0D, null, null, false), (2, -0.8D, -2.0D, null, null, false), (3, -1.0D, -1.7D, null, null, false),
      (4, -1.0D, -2.0D, TIMESTAMP '2024-03-02 00:00:00', null, false), (5, -1.0D, -2.0D, null, TIMESTAMP '2024-03-02 00:00:00', false), (6, -1.0D, -2.0D, null, null, true),
      (7, -double('inf'), -double('inf'), TIMESTAMP '2024-02-01 00:00:00', null, false) AS t(id, value, lasting, ahead, held, hidden)""")
    may = U.purge_eligible(F.col("value"), F.col("lasting"), [F.col("ahead")], F.col("held"), F.col("hidden"), F.lit("2024-03-01").cast("timestamp"))
    assert [r.id for r in df.where(may).orderBy("id").collect()] == [1, 7]


def test_readers_check_columns_and_bank_tables_come_back(spark, tmp_path):
    with pytest.raises(ValueError, match="role string"):
        S.checked(spark.createDataFrame([(1,)], "id long"), {"id": "bigint", "role": "string"}, "messages")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "bank_id long, x string")
    S.write_bank_table(rows, f"{tmp_path}/t")
    assert sorted(map(tuple, S.read_bank_table(spark, f"{tmp_path}/t").collect())) == [(1, "a"), (2, "b")]
    events = spark.createDataFrame([("sync", "2024-01-02", 2, "s", "b"), ("prefetch", "2024-01-01", 1, "s", None)], S.EVENTS)
    S.write_corpus(events, f"{tmp_path}/c")
    assert {tuple(r) for r in S.read_corpus(spark, f"{tmp_path}/c").collect()} == {tuple(r) for r in events.collect()}
    sessions = spark.createDataFrame([("a", "cron", None, 1.0), ("b", None, None, 1.0), ("c", "tool", None, 1.0), ("d", "x", "a", 1.0)], "id string, source string, parent_session_id string, started_at double")
    assert sorted((r.id, r["class"]) for r in S.select_sessions(sessions).collect()) == [("a", "cron"), ("b", "primary")]


def test_a_stream_counts_as_its_batch_twin(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS bank_id, 'used' AS kind, TIMESTAMP '2024-01-01 00:00:00' + id * INTERVAL '5' HOUR AS accessed_at FROM range(60)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = stream_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    assert {tuple(r) for r in spark.table("counted").collect()} == {tuple(r) for r in stream_counts(rows).collect()}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_give_rows(spark, name):
    assert upkeep and registry.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() <= 1
