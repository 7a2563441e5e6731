"""Open memories of the entities that claims name: every memory asks, and blocks of any size give the plain definition's rows."""

import datetime as dt
import random
from pathlib import Path

import pytest

from anamnesis.operators import reconcile as C
from anamnesis.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_every_memory_asks(spark):
    asked = {r.claim_id for r in registry.queries()["linked_open"](spark, SF).select("claim_id").distinct().collect()}
    assert any(c % 50 for c in asked)


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 9) if norm else None


@pytest.mark.parametrize("blocks", [(2_000, 20_000), (3, 4)])
def test_blocks_equal_plain_definition(spark, blocks):
    rng, day = random.Random(4), lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    vector = lambda: rng.choice([None, [0.0] * 3, [1.0, None, 2.0], [1.0, 2.0], [1.0, 2.0, 2.0], *[[rng.uniform(-1, 1) for _ in range(3)] for _ in range(6)]])
    memories = [(i, i % 2, rng.choice(["task", "state", "fact"]), rng.random() < 0.1, rng.random() < 0.1, 1 if rng.random() < 0.1 else None, day(rng.randint(0, 9)), rng.choice([None, day(rng.randint(0, 20))])) for i in range(90)]
    vectors = [(i, vector()) for i in range(80)]
    links = [(i, i % 2, rng.randint(0, 2)) for i in range(90) for _ in range(2)]
    claims = [(100 + i, i % 2, day(rng.randint(0, 20)), vector(), i % 5 > 0) for i in range(30)]
    names = [(100 + i, rng.randint(0, 2)) for i in range(30) for _ in range(2)]
    got = C.linked_open(
        spark.createDataFrame(claims, "claim_id long, bank_id long, observed_at timestamp, embedding array<double>, flagged boolean"),
        spark.createDataFrame(names, "claim_id long, entity_id long"),
        spark.createDataFrame(links, "memory_id long, bank_id long, entity_id long"),
        spark.createDataFrame(memories, "memory_id long, bank_id long, kind string, retracted boolean, hidden boolean, superseded_by long, observed_at timestamp, valid_until timestamp"),
        spark.createDataFrame(vectors, "memory_id long, embedding array<double>"),
        4, *blocks,
    )
    at, want = dict(vectors), set()
    for c, bank, said, asked, flagged in claims:
        named = {(bank, e) for k, e in names if k == c}
        hits = {m for m, b, e in links if (b, e) in named} if flagged else set()
        rows = []
        for m, _, kind, retracted, hidden, over, seen, until in memories:
            if m in hits and kind != "fact" and not retracted and not hidden and over is None and (until is None or until + dt.timedelta(days=1) > said):
                near = cosine(at.get(m), asked)
                rows.append((near is None, -(near or 0), -seen.timestamp(), m))
        want |= {(c, r[3], k + 1) for k, r in enumerate(sorted(rows)[:4])}
    assert {tuple(r) for r in got.collect()} == want and want
