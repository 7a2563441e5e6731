import random

import numpy as np
import pytest

from anamnesis.operators import history as H
from anamnesis.operators import strength as S
from pyspark.sql import functions as F


def slow_use(accesses, now):
    t = S.TUNING
    d = []
    for j, (at, _) in enumerate(accesses):
        before = sum(w * max(at - a, t.min_age_days) ** -d[i] for i, (a, w) in enumerate(accesses[:j]))
        d.append(min(t.d_max, t.a + t.c * before))
    return np.log(sum(w * max(now - a, t.min_age_days) ** -k for (a, w), k in zip(accesses, d, strict=True)))


def test_recent_use_equals_the_plain_loop():
    rng = random.Random(4)
    for n in (1, 2, 30, 600):
        rows = sorted((rng.random() * 40, rng.choice([1.0, 1.5, 2.0])) for _ in range(n))
        at = np.array([int(a * S.DAY) for a, _ in rows])
        got = S.recent_use(at, at.astype(float), np.array([w for _, w in rows]), int(41 * S.DAY), 41.0 * S.DAY)
        assert got == pytest.approx(slow_use([(a / S.DAY, w) for a, (_, w) in zip(at, rows, strict=True)], 41.0))
    assert S.recent_use(np.empty(0, int), np.empty(0), np.empty(0), 1, 1.0) == float("-inf")


def test_one_mention_fades_on_the_closed_form_day():
    for level, days in (("trivial", 7.39), ("minor", 30.83), ("notable", 90.02), ("major", 1096.6), ("critical", 4576)):
        age = np.exp((S.TUNING.s * S.SIGNIFICANCE[level] - S.TUNING.tau) / S.TUNING.a)
        assert age == pytest.approx(days, rel=0.05)


def test_occasions_count_from_the_last_counted(spark):
    rows = [(1, f"2024-01-01 00:00:00"), (1, "2024-01-02 00:00:00"), (1, "2024-01-04 00:00:00"), (1, "2024-01-06 21:36:00"), (1, "2024-01-07 00:00:00"), (1, "2024-01-21 00:00:00")]
    df = spark.createDataFrame(rows, "memory_id long, accessed_at string").withColumn("accessed_at", F.col("accessed_at").cast("timestamp"))
    assert S.occasions(df, "2024-02-01 00:00:00").first()["occasions"] == 4


def test_unit_end_follows_the_clock_change(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-09-28 12:00:00' AS t")
    end = df.select(S.unit_end(F.col("t"), F.lit("day"), F.lit("Pacific/Auckland")).alias("e")).first()["e"]
    # local midnight of the day the clocks go forward, and the midnight 23 hours on
    assert str(end) == "2024-09-29 11:00:00"


def test_text_rules(spark):
    df = spark.createDataFrame([("a<memory-context>x</memory-context>b <memory-context>rest", "[Triggering message id: `7`] [Ann] hi", "key AKIA" + "A" * 16 + " in http://u:pw@h/")], "a string, b string, c string")
    text, kinds = H.redact_secrets(F.col("c"))
    row = df.select(H.strip_memory_block(F.col("a")).alias("a"), H.clean_query(F.col("b")).alias("b"), text.alias("c"), kinds.alias("k")).first()
    assert (row["a"], row["b"]) == ("ab", "hi")
    assert row["c"] == "key [redacted aws] in http://u:[redacted url_password]@h/" and row["k"] == ["aws", "url_password"]


def test_turn_hash_is_of_length_prefixed_parts(spark):
    import hashlib

    want = hashlib.sha256(b"".join(len(p).to_bytes(8, "little") + p for p in ("é".encode(), b"ok"))).hexdigest()
    assert spark.createDataFrame([("é", "ok")], "u string, r string").select(H.turn_hash(F.col("u"), F.col("r")).alias("h")).first()["h"] == want
