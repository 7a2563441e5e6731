"""Readers of histories, run reports and labelling material on small files; turns of a history by hand."""

import json

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import history as H
from anamnesis.operators import upkeep as U
from anamnesis.sources import history as S
from anamnesis.sources import records as R


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_history_of_json_lines_is_checked(spark, tmp_path):
    session = {"id": "s", "source": "chat", "parent_session_id": "p", "started_at": 1}
    message = {"id": 1, "session_id": "s", "role": "user", "content": "x", "timestamp": 2.5, "active": 1, "compacted": 0}
    a, b = write(tmp_path / "s.json", json.dumps(session)), write(tmp_path / "m.json", json.dumps(message))
    sessions, messages = S.read_history(spark, a, b, "json")
    assert sessions.first()["started_at"] == 1.0 and messages.first()["tool_calls"] is None
    del message["active"]
    with pytest.raises(ValueError, match="active bigint"):
        S.read_history(spark, a, write(tmp_path / "n.json", json.dumps(message)), "json")


def test_turns_by_hand(spark):
    said = [
        ("s", 1, "assistant", "before any", 0, None, None), ("s", 2, "user", "one", 0, None, None), ("s", 3, "assistant", "first", 0, None, None), ("s", 4, "assistant", "calls", 0, '[{"f": 1}]', None),
        ("s", 5, "assistant", "last", 0, "[]", None), ("s", 6, "tool", "out", 0, None, None), ("s", 7, "user", "cut away", 1, None, None), ("s", 8, "assistant", "after the cut", 0, None, None),
        ("s", 9, "user", None, 0, None, "steer"), ("s", 10, "assistant", None, 0, " ", None), ("s", 11, "user", "made", 0, None, "note"), ("s", 12, "assistant", "x", 0, None, None), ("s", 13, "user", "open", 0, None, None),
        ("c", 1, "user", "job", 0, None, None), ("c", 2, "assistant", "done", 0, None, None),
    ]
    rows = spark.createDataFrame([(s, i, r, t, float(i), c, calls, k) for s, i, r, t, c, calls, k in said], "session_id string, id long, role string, content string, timestamp double, _compressed_summary long, tool_calls string, display_kind string")
    sessions = spark.createDataFrame([("s", "primary"), ("c", "cron")], "id string, class string")
    turns = H.import_turns(sessions, rows)
    got = sorted(tuple(r) for r in turns.where("session_id = 's'").select("segment", "clear", "query", "previous_query", "synthetic", "synced", "reply", "reply_at").collect())
    assert got == [
        (1, False, "one", None, False, True, "last", 5.0), (2, True, None, None, False, False, None, None), (3, False, "", "one", False, True, "", 10.0),
        (4, False, "made", "", True, False, None, None), (5, False, "open", "made", False, False, None, None),
    ]
    assert {r.counter: r.n for r in H.import_turn_counts(turns, rows).collect()} == {"turns": 2, "prefetch_only": 3, "synthetic": 1, "compactions": 1, "tool_rows": 2}
    none = H.import_turn_counts(H.import_turns(sessions, rows.limit(0)), rows.limit(0))
    assert {r.n for r in none.collect()} == {0}


def test_calls(spark):
    said = {None: False, "": False, "  ": False, "null": False, "[]": False, "[1]": True, "{}": True, "no json": True}
    rows = spark.createDataFrame([(k,) for k in said], "calls string").select("calls", H.has_tool_calls(F.col("calls")).alias("has"))
    assert {r.calls: r.has for r in rows.collect()} == said


def test_reports_are_read_and_compared(spark, tmp_path):
    base = {
        "kind": "live", "git_sha": "1234567", "extraction_lag": {"p50": 1.5, "by": {"a": [1, 2.0]}, "text": "12"}, "kind_histogram": {"fact": 3}, "tuning": {"x": 1},
        "purges_per_day": [{"day": "2024-01-01", "count": 2}, {"count": 9}], "probes": [{"id": "p", "passed": True}, {"id": "q", "passed": True}],
        "memories": [{"id": "m", "faded_at": "x", "purged_at": None}, {"id": "n", "faded_at": None, "purged_at": None}],
    }
    other = json.loads(json.dumps(base))
    other["extraction_lag"]["by"]["a"] = [1, 3.0]
    other["kind_histogram"]["fact"] = 3.0000000001
    other["purges_per_day"][0]["day"] = "2024-01-02"
    other["probes"] = [{"id": "p", "passed": False}, {"id": "q", "passed": True}]
    other["memories"] = [{"id": "m", "faded_at": None, "purged_at": "y"}]
    a, b = (R.read_report(spark, write(tmp_path / n, v)) for n, v in (("a.json", base), ("b.json", other)))
    assert {(r.path, r.value) for r in R.report_numbers(a).collect()} == {("extraction_lag.p50", 1.5), ("extraction_lag.by.a[0]", 1.0), ("extraction_lag.by.a[1]", 2.0), ("kind_histogram.fact", 3.0), ("purges_per_day[2024-01-01].count", 2.0)}
    got = {tuple(r) for r in U.report_diff(R.report_numbers(a), R.report_numbers(b)).collect()}
    assert got == {("extraction_lag.by.a[1]", 2.0, 3.0), ("purges_per_day[2024-01-01].count", 2.0, None), ("purges_per_day[2024-01-02].count", None, 2.0)}
    assert [tuple(r) for r in U.probe_diff(R.report_probes(a), R.report_probes(b)).collect()] == [("p", True, False)]
    fates = {tuple(r) for r in U.fate_diff(R.report_fates(a), R.report_fates(b)).collect()}
    assert fates == {("m", "faded_only_in_a"), ("m", "purged_only_in_b"), ("n", "only_in_a")}


def test_material_and_labels(spark, tmp_path):
    one = {"id": "c", "memory": "m", "score": 0.5, "sentence": "s"}
    material = {"version": 3, "recall": [{"sample": "r", "at": "t", "session": "s", "query": "q", "candidates": [one, {**one, "id": "d"}]}], "call2": [{"sample": "k", "at": "t", "chunk": "h", "ordinal": 1, "claim": "x", "candidates": []}]}
    got = R.read_material(spark, write(tmp_path / "m.json", json.dumps(material, indent=1)))
    assert [(r["sample"], r["id"], r["score"]) for r in got["recall"].collect()] == [("r", "c", 0.5), ("r", "d", 0.5)]
    assert got["call2"].count() == got["refresh"].count() == 0
    labels = R.read_labels(spark, write(tmp_path / "l.json", {"recall": [{"query": "q", "memory": "m", "relevant": True}], "call2": [{"chunk": "h", "ordinal": 1, "memory": "m", "relevant": False}]}))
    assert labels["recall"].first()["relevant"] and labels["call2"].first()["ordinal"] == 1 and labels["facet"].count() == 0
