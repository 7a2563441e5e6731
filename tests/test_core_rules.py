"""Rules without SQL: strength, plans, masks, sessions, repetition, projections, vectors, names."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from anamnesis.operators import agenda as A
from anamnesis.operators import entities as E
from anamnesis.operators import lifecycle as L
from anamnesis.operators import recall as R
from anamnesis.operators import reconcile as C
from anamnesis.operators import retrieval as V
from anamnesis.operators import strength as S
from anamnesis.plans.registry import NOW
from anamnesis.sources.fixtures import derived
from anamnesis.streaming import sessions as T

SF = "/root/testdata/sf0.001"


def slow_strength(m, accesses, stretches, closes, known, now, quiet=0.1):
    """The plain definition: one memory, its accesses (us, weight), the bank's turns merged to stretches."""

    def days(a, b):
        full = sum(max(0, min(b, e) - max(a, s)) for s, e in stretches)
        return (full + quiet * (b - a - full)) / S.DAY

    n, last = 0, None
    for at, _ in sorted(accesses):
        if last is None or at - last >= 3 * S.DAY:
            n, last = n + 1, at
    floor = -0.7 - 0.8 * math.log(18) + 0.8 * math.log(n) if n else -math.inf
    counted = list(accesses)
    if closes is not None and max(closes, known) <= now:
        counted = [(a, w) for a, w in accesses if a > closes] + [(max(closes, known), 1.0)]
    counted.sort(key=lambda x: (x[0], -x[1]))
    d = []
    for j, (at, _) in enumerate(counted):
        before = sum(w * max(days(a, at), 0.01) ** -d[i] for i, (a, w) in enumerate(counted[:j]))
        d.append(min(2.0, 0.35 + 0.2 * before))
    total = sum(w * max(days(a, now), 0.01) ** -k for (a, w), k in zip(counted, d, strict=True))
    recent = math.log(total) if total else -math.inf
    sig = S.SIGNIFICANCE[m["owner_significance"] or m["significance"]]
    return n, 2.5 * sig + floor, 2.5 * sig + max(recent, floor)


def test_strength_equals_the_definition(spark):
    us = lambda t: int(pd.Timestamp(t).value // 1000)
    memories = {r["memory_id"]: r.asDict() for r in derived(spark, SF, "d_memories").collect()}
    accesses, turns = derived(spark, SF, "d_accesses").collect(), {}
    for r in derived(spark, SF, "d_messages").collect():
        turns.setdefault(r["bank_id"], set()).add(us(r["message_at"]))
    stretches = {}
    for bank, times in turns.items():
        out = []
        for t in sorted(times):
            if out and t <= out[-1][1]:
                out[-1][1] = t + S.DAY
            else:
                out.append([t, t + S.DAY])
        stretches[bank] = out
    now, by = us(NOW), {}
    for a in accesses:
        m = a["memory_id"]
        while m is not None and us(a["accessed_at"]) <= now:
            by.setdefault(m, []).append((us(a["accessed_at"]), S.WEIGHTS[a["kind"]]))
            m = memories[m]["superseded_by"]
    got = {r["memory_id"]: r for r in __spark_entry__.queries()["strength"](spark, SF).collect()}
    assert set(got) == set(memories)
    closed = 0
    for k, m in memories.items():
        close = m["valid_until"] or (m["valid_from"] if m["kind"] == "event" else None)
        closes = us(close) + S.DAY if close else None
        known = us(memories[m["ended_by"]]["observed_at"] if m["ended_by"] is not None else m["observed_at"])
        closed += closes is not None and max(closes, known) <= now
        n, lasting, value = slow_strength(m, by.get(k, []), stretches.get(m["bank_id"], []), closes, known, now)
        assert got[k]["occasions"] == n and got[k]["lasting"] == pytest.approx(lasting) and got[k]["value"] == pytest.approx(value), k
    assert closed > 10


def test_a_closed_window_restarts_once_its_end_is_known(spark):
    rows = [(1, 0, "state", "trivial", "2026-01-05", None, "2026-02-04", 2), (2, 0, "state", "trivial", "2026-02-14", "2026-02-04", None, None), (3, 0, "event", "trivial", "2026-01-05", "2026-04-05", None, None), (4, 0, "fact", "trivial", "2026-04-06", None, None, None)]
    memories = spark.createDataFrame(rows, "memory_id long, bank_id long, kind string, significance string, observed_at string, valid_from string, valid_until string, ended_by long").withColumns(
        {c: F.col(c).cast("timestamp") for c in ("observed_at", "valid_from", "valid_until")} | {"owner_significance": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("long")}
    )
    accesses = memories.select("memory_id", F.lit("created").alias("kind"), F.col("observed_at").alias("accessed_at"))
    turns = spark.sql("SELECT CAST(0 AS BIGINT) AS bank_id, TIMESTAMP '2026-01-01 00:00:00' + id * INTERVAL '12' HOUR AS message_at FROM range(300)")
    spark.sparkContext.setCheckpointDir("/tmp/anamnesis-tests")
    value = lambda at: {r["memory_id"]: r["value"] for r in S.strength(memories, accesses, turns, at).collect()}
    assert value("2026-02-09 00:00:00")[1] < S.TUNING.tau <= value("2026-02-15 00:00:00")[1]
    assert value("2026-04-05 23:59:00")[3] < S.TUNING.tau
    late = value("2026-04-06 01:00:00")
    assert late[3] == pytest.approx(late[4], abs=1e-9)


def test_bank_days_add_up(spark):
    turns = spark.sql("SELECT id % 2 AS bank_id, TIMESTAMP '2024-01-01 05:00:00' + id * INTERVAL '17' HOUR * (1 + id % 5) AS message_at FROM range(40)")
    day = 86_400_000_000
    spans = spark.range(60).select((F.col("id") % 2).alias("bank_id"), F.floor(F.lit(1704000000000000) + F.col("id") * day / 3).cast("long").alias("from_us")).withColumn("mid_us", F.col("from_us") + 7 * 3_600_000_000).withColumn("to_us", F.col("from_us") + 5 * day)
    w = S.bank_windows(turns)
    total = lambda a, b: {(r["bank_id"], r["k"]): r["days"] for r in S.bank_days(spans.select("bank_id", F.col("from_us").alias("k"), F.col(a).alias("from_us"), F.col(b).alias("to_us")), w).collect()}
    whole, one, two = total("from_us", "to_us"), total("from_us", "mid_us"), total("mid_us", "to_us")
    assert len(whole) == 60 and all(whole[k] == pytest.approx(one[k] + two[k]) and 0.5 <= whole[k] + 1e-9 and whole[k] <= 5 + 1e-9 for k in whole)


def test_survivors_end_long_chains_and_cycles(spark):
    spark.sparkContext.setCheckpointDir("/tmp/anamnesis-tests")
    rows = [(k, k + 1) for k in range(50)] + [(50, None), (100, 101), (101, 100), (200, 999)]
    got = {r[0]: r[1] for r in S.survivors(spark.createDataFrame(rows, "k long, n long"), "k", "n", "last").collect()}
    assert got == {**{k: 50 for k in range(51)}, 100: 100, 101: 101, 200: 200}


def row(ordinal, memory, label, **more):
    base = dict(ordinal=ordinal, memory_id=memory, label=label, kind="fact", significance="minor", kept=False, n_kind="fact", n_significance="minor", n_owner=None, n_ended=False, newer=True, new_date=False, same_document=False)
    return base | more


def said(rows, **how):
    return [(r["ordinal"], r["action"], r["memory_id"], r["detail"]) for r in C.plan_chunk(rows, **how)]


def test_the_label_planner():
    assert said([row(0, None, None)]) == [(0, "fate:new", None, None)]
    assert said([row(0, 7, "mentioned_again")]) == [(0, "passage", 7, None), (0, "fate:absorbed", None, None), (0, "restatement", 7, "mentioned_again:mentioned_again"), (-1, "access:mentioned_again", 7, None)]
    assert said([row(0, 7, "confirmed", new_date=True)]) == [(0, "refines", 7, None), (0, "fate:new", None, None)]
    heavy = said([row(0, 7, "mentioned_again", significance="major")])
    assert heavy == [(0, "refines", 7, "promoted"), (0, "fate:new", None, None)]
    raised = said([row(0, 7, "mentioned_again", significance="notable")])
    assert (-1, "raise", 7, "notable") in raised and (0, "fate:absorbed", None, None) in raised
    assert ("fate:absorbed") in [x[1] for x in said([row(0, 7, "mentioned_again", significance="critical", n_owner="kept")])]
    # what one claim retracts is no neighbour of the next
    assert said([row(0, 7, "retracts"), row(1, 7, "ends")]) == [(0, "retracts", 7, None), (0, "fate:new", None, None), (1, "fate:new", None, None)]
    # related facts do not replace an open task, an end does
    assert said([row(0, 7, "refines", n_kind="task")]) == [(0, "fate:new", None, None)]
    assert said([row(0, 7, "ends", n_kind="task")])[0] == (0, "ends", 7, None)
    assert said([row(0, 7, "refines", kind="state")])[0] == (0, "mismatch", 7, "explicit:rejected")
    assert said([row(0, 7, "refines", kind="state")], kind_guard=False)[1] == (0, "refines", 7, None)
    # older claims
    assert said([row(0, 7, "ends", newer=False)]) == [(0, "fate:new_ended", 7, None)]
    assert said([row(0, 7, "denies", newer=False)]) == [(0, "passage", 7, None), (0, "fate:absorbed", None, None)]
    assert said([row(0, 7, "mentioned_again", same_document=True, kept=True)]) == [(0, "passage", 7, None), (0, "fate:absorbed", None, None), (0, "keep", 7, None)]
    assert said([row(0, 7, "confirmed", n_ended=True)]) == [(0, "fate:new", None, None)]


def test_masks():
    assert L.masked("ab\ncd", [(1, 4)]) == "a█\n█d" and L.masked("abc", [(5, 9), (1, 2), (0, 2)]) == "██c"
    assert L.occurrences("aa", "aaaa") == [(0, 2), (1, 3), (2, 4)]
    assert L.occurrences("a█c", "abc axc") == [(0, 3), (4, 7)] and L.occurrences("abc", "a█c") == [(0, 3)]
    assert L.occurrences("██", "ab") == [] and L.occurrences("", "ab") == [] and L.occurrences("a ", "█ ") == []
    rng = random.Random(3)
    for _ in range(300):
        text, passage = ("".join(rng.choice("ab █") for _ in range(n)) for n in (12, 3))
        plain = [(k, k + 3) for k in range(10) if all("█" in (x, y) or x == y for x, y in zip(passage, text[k : k + 3])) and any("█" not in (x, y) and not x.isspace() for x, y in zip(passage, text[k : k + 3]))]
        assert L.occurrences(passage, text) == plain
    for _ in range(50):
        text, wanted = "".join(rng.choice("abé█\n ") for _ in range(80)), ["".join(rng.choice("abé█ ") for _ in range(rng.randrange(6))) for _ in range(30)]
        assert set(L.Passages(wanted).found(text)) == {s for w in wanted for s in L.occurrences(w, text)}


def events():
    us = 60_000_000
    e = lambda at, kind, recall=None, memories=None: (1, "s", at * us, kind, recall, memories)
    return [e(0, "prefetch", "a", [1, 2]), e(1, "sync", "x"), e(2, "sync", "a"), e(3, "recall", None, [2, 3]), e(4, "forget", None, [1]), *[e(5 + k, "prefetch", f"p{k}", [10 + k]) for k in range(5)], e(20, "sync", "p0"), e(21, "sync", "p4")]


def test_session_state(spark, tmp_path):
    rows = spark.createDataFrame(events(), T.EVENTS)
    assert T.session_context(rows).first()["in_context"] == [2, 3, 14]
    later = [*events(), (1, "s", 21 * 60_000_000 + T.IDLE_US, "recall", None, [5])]
    assert T.session_context(spark.createDataFrame(later, T.EVENTS)).first()["in_context"] == [5]
    assert T.session_context(spark.createDataFrame([*events(), (1, "s", 22 * 60_000_000, "clear", None, None)], T.EVENTS)).first()["in_context"] == []
    rows.withColumn("event_time", F.timestamp_micros("at_us")).write.parquet(f"{tmp_path}/in")
    stream = T.stream_session_context(spark.readStream.schema(T.EVENTS + ", event_time timestamp").parquet(f"{tmp_path}/in"))
    run = stream.writeStream.outputMode("update").format("memory").queryName("contexts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert [r["in_context"] for r in spark.table("contexts").collect()][-1] == [2, 3, 14]


def test_bursts(spark, tmp_path):
    minute = 60_000_000
    assert T.debounced([0, 4 * minute, 8 * minute]) == [(0, 13 * minute, 3)]
    assert [x[:2] for x in T.debounced([k * 4 * minute for k in range(10)])] == [(0, 30 * minute), (32 * minute, 41 * minute)]
    assert len(T.debounced([0, 5 * minute])) == 2
    rng = random.Random(1)
    rows = spark.createDataFrame([(k % 3, rng.randrange(0, 900) * minute // 7) for k in range(200)], "bank_id long, at_us long")
    want = {(b, *x) for b in range(3) for x in T.debounced([r["at_us"] for r in rows.where(F.col("bank_id") == b).collect()])}
    assert {tuple(r) for r in T.trigger_debounce(rows).collect()} == want


def test_stream_ingest_stores_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "2024-01-01", "h1"), (1, "s", "2024-01-01", "h1"), (1, "s", "2024-01-02", "h2")], "bank_id long, session_id string, message_at string, turn_hash string")
    for k in range(2):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        run = T.stream_ingest(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp{k}")
        assert run.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_repetition_rules(spark):
    rows = spark.createDataFrame([("FREQ=MONTHLY;BYMONTHDAY=31", "2024-01-31 12:00:00", "UTC"), ("FREQ=DAILY", "2024-09-27 14:00:00", "Pacific/Auckland"), ("DTSTART:x\nFREQ=DAILY", "2024-01-01 00:00:00", "UTC"), ("nonsense", "2024-01-01 00:00:00", "UTC"), (None, "2024-01-01 00:00:00", "UTC")], "r string, s string, z string")
    got = [str(x[0]) for x in rows.select(A.next_occurrence("r", F.col("s").cast("timestamp"), F.lit("2024-09-29 00:00:00").cast("timestamp"), "z")).collect()]
    # 03:00 in Auckland is 14:00 the day before once the clocks have gone forward
    assert got == ["2024-10-31 12:00:00", "2024-09-29 13:00:00", "None", "None", "None"]



def test_vectors_and_names(spark):
    rng = np.random.default_rng(2)
    vectors = [(k, k % 2, rng.normal(size=4).tolist()) for k in range(40)] + [(90, 0, None), (91, 1, [float("nan")] * 4), (92, 0, [0.0] * 4)]
    v = spark.createDataFrame(vectors, "memory_id long, bank_id long, embedding array<double>")
    q = v.where("memory_id < 3").withColumnRenamed("memory_id", "query_id")
    got = {}
    for r in R.vector_top_k(v, q, 5, rows_per_block=6, queries_per_block=1).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["memory_id"]))
    for k in range(3):
        unit = lambda x: np.array(x) / np.linalg.norm(x)
        best = sorted((m for m, b, e in vectors[:40] if b == k % 2), key=lambda m: (-round(float(unit(vectors[m][2]) @ unit(vectors[k][2])), 9), m))[:5]
        assert [m for _, m in sorted(got[k])] == best
    said_ = spark.createDataFrame([(1, 0, "We met JOSÉ Álvarez."), (2, 0, "josea"), (3, 1, "jose alvarez")], "passage_id long, bank_id long, text string")
    alias = spark.createDataFrame([(5, 0, "jose alvarez"), (6, 0, "we")], "entity_id long, bank_id long, alias string")
    ends = spark.createDataFrame([(5, 8), (6, 6)], "entity_id long, survivor_id long")
    assert {tuple(r) for r in E.named_in(said_, alias, ends, spark.createDataFrame([(6,)], "entity_id long")).collect()} == {(1, 8)}
    assert V.bag_of_words("")[0] == 1 and np.linalg.norm(V.bag_of_words("a b c")) == pytest.approx(1) and (V.bag_of_words("A, b") == V.bag_of_words("b a")).all()


@pytest.mark.parametrize("name", ["purge_plan", "recall", "prefetch", "explain", "agenda", "model_pool", "claim_neighbours", "plan_reconcile"])
def test_composed_queries_hold_their_invariants(spark, name):
    rows = __spark_entry__.queries()[name](spark, SF)
    got = rows.collect()
    assert got
    if name == "recall":
        assert all(1 <= r["place"] <= 10 for r in got) and len({(r["query_id"], r["memory_id"]) for r in got}) == len(got)
    if name == "prefetch":
        assert all((r["logit"] is None) == (r["decision"] == "outside_rerank_pool") for r in got) and {"taken", "over_cap", "over_budget", "under_floor"} & {r["decision"] for r in got}
    if name == "explain":
        assert all(r["included"] == (r["reason"] is None) for r in got)
    if name == "agenda":
        assert {r["part"] for r in got} <= {"dated", "routine", "undated"} and max(r["position"] for r in got) <= 15
    if name == "claim_neighbours":
        assert max(r["rank"] for r in got) <= 10
