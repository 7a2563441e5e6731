"""Pages of a kept order equal slices of the sorted list; filters equal a plain walk."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import browse as B

SCHEMA = """memory_id long, created_at timestamp, fades_in_days double, value double, kind string, status string, significance string, owner_significance string,
content string, observed_at timestamp, phase string, document_id string"""
DAY = datetime(2024, 1, 1)


def drawn(n=230):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        at = DAY + timedelta(hours=rng.randrange(40))
        days = rng.choice([None, 0.0, 3.0, 7.0, 30.0, rng.uniform(0, 90)])
        rows.append((k, rng.choice([None, at]), days, rng.choice([-math.inf, -0.7, rng.uniform(-2, 2)]), rng.choice(["fact", "event"]), rng.choice(["live", "ended"]), rng.choice(["minor", "major"]),
                     rng.choice([None, "kept", "minor"]), rng.choice([None, "", "The Cat sat", "cats and dogs"]), at, rng.choice([None, "current", "upcoming"]), rng.choice([None, "d1"])))
    return rows


WANTED = {
    "created": lambda r: (r[1] is None, -(r[1] or DAY).timestamp(), -r[0]),
    "fade": lambda r: (r[2] is None, r[2] or 0.0, r[0]),
    "fade_latest": lambda r: (r[2] is None, -(r[2] or 0.0), r[0]),
    "strength": lambda r: (-r[3], r[0]),
}


@pytest.mark.parametrize("sort", list(WANTED))
def test_pages(spark, tmp_path, sort):
    rows = drawn()
    folder = B.write_listing(spark.createDataFrame(rows, SCHEMA), sort, f"{tmp_path}/kept", parts=9)
    want = [r[0] for r in sorted(rows, key=WANTED[sort])]
    for page, size in [(0, 20), (3, 20), (11, 20), (12, 20), (0, 500), (1, 100)]:
        got = [(r["memory_id"], r["number"]) for r in B.page_at(spark, folder, page, size).collect()]
        assert sorted(got, key=lambda x: x[1]) == [(m, page * size + i + 1) for i, m in enumerate(want[page * size : (page + 1) * size])]
    seen, last = [], None
    while found := B.page_after(spark, folder, 60, last).collect():
        seen += [r["memory_id"] for r in found]
        last = found[-1]["place"]
    assert seen == want


def test_pages_of_nothing(spark, tmp_path):
    folder = B.write_listing(spark.createDataFrame([], SCHEMA), "created", f"{tmp_path}/none", parts=3)
    assert B.page_at(spark, folder, 0, 5).count() == 0 and B.page_after(spark, folder, 5).count() == 0


def test_a_deep_page_reads_its_ranges(spark, tmp_path):
    folder = B.write_listing(spark.createDataFrame(drawn(), SCHEMA), "created", f"{tmp_path}/kept", parts=9)
    files = lambda df: len({r[0] for r in df.select(F.input_file_name()).collect()})
    everything = spark.read.parquet(f"{folder}/rows")
    parts = everything.select("part").distinct().count()
    assert parts >= 5
    page = B.page_at(spark, folder, 9, 20)
    assert len({r["part"] for r in everything.join(page.select("memory_id"), "memory_id").select("part").distinct().collect()}) <= 2
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and files(B._within(spark, folder, [0])) == 1


def test_filters(spark):
    rows = drawn()
    memories = spark.createDataFrame(rows, SCHEMA)
    ids = lambda asked, *more: {r[0] for r in B.listed(memories, asked, *more).select("memory_id").collect()}
    assert ids(B.Listing()) == {r[0] for r in rows}
    assert ids(B.Listing(kind="event", significance="minor", document_id="d1")) == {r[0] for r in rows if r[4] == "event" and (r[7] or r[6]) == "minor" and r[11] == "d1"}
    assert ids(B.Listing(kept=False)) == {r[0] for r in rows if r[7] != "kept"} and ids(B.Listing(kept=True)) == {r[0] for r in rows if r[7] == "kept"}
    assert ids(B.Listing(words="CAT")) == {r[0] for r in rows if r[8] and "cat" in r[8].lower()} and ids(B.Listing(words=" ")) == {r[0] for r in rows}
    low, high = DAY + timedelta(hours=5), DAY + timedelta(hours=20)
    assert ids(B.Listing(observed_from=low, observed_to=high, phases=("current",))) == {r[0] for r in rows if low <= r[9] < high and r[10] == "current"}
    tau = -0.7
    plain = {
        "faded": lambda d, v: v < tau, "week": lambda d, v: v >= tau and d is not None and d <= 7, "month": lambda d, v: v >= tau and d is not None and d <= 30,
        "over_month": lambda d, v: v >= tau and d is not None and d > 30, "never": lambda d, v: d is None,
    }
    for name, rule in plain.items():
        assert ids(B.Listing(fading=name)) == {r[0] for r in rows if rule(r[2], r[3])}
    links = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (1, 6)], "memory_id long, entity_id long")
    entities = spark.createDataFrame([(5, None), (6, 5), (7, None)], "entity_id long, merged_into long")
    assert ids(B.Listing(entity=5), links, entities) == {1, 2}
    totals = {r["status"]: (r["memories"], r["total"]) for r in B.listed_totals(B.listed(memories, B.Listing(kind="fact")), "live").collect()}
    n = {s: sum(r[4] == "fact" and r[5] == s for r in rows) for s in ("live", "ended")}
    assert totals == {s: (c, n["live"]) for s, c in n.items()}
