"""Streams with keyed state: handed over from a table, stopped and started, they give what one run over all rows gives."""

import random

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import history as H
from anamnesis.streaming import sessions as T

MINUTE = 60_000_000
TURNS = "n long, bank_id long, session_id string, message_at timestamp, user_text string, reply_text string, recall_id string, forget_requested boolean"


@pytest.fixture
def keyed(spark):
    names = ("providerClass", "rocksdb.changelogCheckpointing.enabled")
    before = {n: spark.conf.get(f"spark.sql.streaming.stateStore.{n}", None) for n in names}
    T.keyed_state(spark)
    yield spark
    for n, v in before.items():
        spark.conf.unset(f"spark.sql.streaming.stateStore.{n}") if v is None else spark.conf.set(f"spark.sql.streaming.stateStore.{n}", v)


def ran(df, name, checkpoint, mode):
    run = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    return df.sparkSession.table(name).collect()


def test_sessions_handed_over(keyed, tmp_path):
    rng, at, rows = random.Random(5), 0, []
    for k in range(160):
        at += rng.randrange(1, 4000) * MINUTE // 10
        rows.append((k % 2, f"s{rng.randrange(2)}", at, rng.choice(["prefetch", "sync", "recall", "forget", "prefetch", "sync"]), f"r{k // 4}", [rng.randrange(9), k]))
    events = keyed.createDataFrame(rows, T.EVENTS)
    cut = rows[90][2]
    held = T.session_states(events.where(F.col("at_us") <= cut))
    events.where(F.col("at_us") > cut).withColumn("event_time", F.timestamp_micros("at_us")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = T.stream_session_context(keyed.readStream.schema(T.EVENTS + ", event_time timestamp").parquet(f"{tmp_path}/in"), held=held)
    got = {(r[0], r[1]): (r[2], r[3]) for r in ran(stream, "handed_sessions", f"{tmp_path}/cp", "update")}
    want = {(r[0], r[1]): (r[2], r[3]) for r in T.session_context(events).collect()}
    assert got == want and len(want) == 4


def test_bursts_handed_over(keyed, tmp_path):
    rng = random.Random(7)
    times = sorted(rng.randrange(0, 900) * MINUTE // 3 for _ in range(300))
    rows = keyed.createDataFrame([(k % 3, t) for k, t in enumerate(times)], "bank_id long, at_us long")
    cut = times[140]
    last = keyed.createDataFrame([(9, times[-1] + 100 * MINUTE)], "bank_id long, at_us long")
    done, open_ = T.trigger_debounce(rows.where(F.col("at_us") <= cut), cut), T.open_triggers(rows, cut)
    assert open_.count() > 0
    rest = rows.where(F.col("at_us") > cut).union(last).withColumn("event_time", F.timestamp_micros("at_us"))
    rest.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = T.stream_trigger_debounce(keyed.readStream.schema("bank_id long, at_us long, event_time timestamp").parquet(f"{tmp_path}/in"), held=open_)
    got = [tuple(r) for r in done.collect()] + [tuple(r) for r in ran(stream, "handed_bursts", f"{tmp_path}/cp", "append")]
    assert sorted(got) == sorted(tuple(r) for r in T.trigger_debounce(rows).collect())


def turns(n, session, minute, text, reply="ok", recall=None, forgets=False):
    return n, 1, session, f"2024-01-01 00:{minute:02}:00", text, reply, recall, forgets


def frame(spark, rows):
    return spark.createDataFrame(rows, TURNS.replace("message_at timestamp", "message_at string")).withColumn("message_at", F.col("message_at").cast("timestamp"))


SECRET = "AKIA" + "Z" * 16
FIRST = [turns(0, "a", 1, f"my key {SECRET}"), turns(1, "a", 2, "hello", None), turns(2, "a", 3, "forget this", recall="r2", forgets=True)]
LATER = [turns(3, "a", 2, "hello", ""), turns(4, "a", 3, "forget this", recall="r2"), turns(5, "b", 2, "hello"), turns(6, "b", 2, None, None), turns(7, "b", 2, None, None)]


def test_turns_of_a_table(spark):
    got = {r["n"]: r for r in H.ingest_turns(frame(spark, FIRST + LATER), H.keyed_turns(frame(spark, FIRST[:0])), "n").collect()}
    assert [got[k]["outcome"] for k in range(8)] == ["stored", "stored", "tombstone", "duplicate", "duplicate", "stored", "stored", "duplicate"]
    assert got[0]["user_text"] == "my key [redacted aws]" and got[0]["secret_kinds"] == ["aws"]
    assert [got[2][c] for c in ("user_text", "reply_text", "secret_kinds", "recall_id", "tombstone_reason")] == [None] * 4 + ["forget_requested"]
    stored = H.keyed_turns(frame(spark, FIRST))
    assert {r["n"] for r in H.ingest_turns(frame(spark, LATER), stored, "n").where("outcome = 'stored'").collect()} == {5, 6}
    recalls = spark.createDataFrame([(1, "r2"), (1, "r3"), (2, "r2")], "bank_id long, recall_id string")
    all_ = frame(spark, FIRST + LATER)
    assert {tuple(r) for r in H.without_forgotten(recalls, all_, H.ingest_turns(all_, stored.where("false"), "n"), "n").collect()} == {(1, "r3"), (2, "r2")}


def test_turns_of_a_stream(keyed, tmp_path):
    def go():
        stream = keyed.readStream.schema(TURNS).parquet(f"{tmp_path}/in")
        assert T.stream_turns(stream, f"{tmp_path}/out", f"{tmp_path}/cp", before).awaitTermination(240)
        return [r["n"] for r in keyed.read.parquet(f"{tmp_path}/out").orderBy("n").collect()]

    old = [turns(90, "old", 5, "stored long ago")]
    before = H.keyed_turns(frame(keyed, old))
    frame(keyed, FIRST).write.parquet(f"{tmp_path}/in")
    assert go() == [0, 1, 2]
    # started again: what comes again, from the table handed over too, is not stored again
    frame(keyed, [LATER[0], LATER[1], LATER[2], turns(91, "old", 5, "stored long ago")]).write.mode("append").parquet(f"{tmp_path}/in")
    assert go() == [0, 1, 2, 5]
    frame(keyed, LATER[3:4]).write.mode("append").parquet(f"{tmp_path}/in")
    assert go() == [0, 1, 2, 5, 6]
    rows = keyed.read.parquet(f"{tmp_path}/out")
    assert rows.where(F.coalesce("user_text", F.lit("")).contains(SECRET)).count() == 0
    assert [r["n"] for r in rows.where("tombstone_reason IS NOT NULL AND user_text IS NULL").collect()] == [2]
