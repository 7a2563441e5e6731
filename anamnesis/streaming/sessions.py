"""Keyed state on streams: what is in a session's context, debounced triggers, and ingest without duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from anamnesis.operators.history import keyed_turns

# Fixed values of sessions and of refreshes.
PENDING, IDLE_US, QUIET_US, CAP_US = 4, 7 * 86_400_000_000, 5 * 60_000_000, 30 * 60_000_000
#: At one instant a look-up comes before the turn that follows it.
RANK = {"prefetch": 0, "sync": 1, "recall": 2, "forget": 3, "clear": 4}
EVENTS = "bank_id long, session_id string, at_us long, type string, recall_id string, memories array<bigint>"
CONTEXT = "bank_id long, session_id string, at_us long, in_context array<bigint>"


def keyed_state(spark: SparkSession) -> None:
    """Keep the state of streams that this session starts from now on in RocksDB, its changes checkpointed; a stream begun before keeps its own kind."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def step(state: dict[str, Any] | None, event: dict[str, Any]) -> dict[str, Any]:
    """The session's state after one event; a week without events empties it first."""
    if state is None or event["at_us"] - state["touched"] >= IDLE_US:
        state = {"context": [], "pending": [], "touched": event["at_us"]}
    context, pending = list(state["context"]), list(state["pending"])
    memories = [int(m) for m in (event["memories"] if event["memories"] is not None else [])]

    def add(found: list[int]) -> None:
        context.extend(m for m in dict.fromkeys(found) if m not in context)

    kind = event["type"]
    if kind == "prefetch":
        pending = [*pending, (event["recall_id"], memories)][-PENDING:]
    elif kind == "sync":
        for k, (recall, found) in enumerate(pending):
            if event["recall_id"] is not None and recall == event["recall_id"]:
                add(found)
                del pending[k]
                break
    elif kind == "recall":
        add(memories)
    elif kind == "forget":
        context = [m for m in context if m not in memories]
        pending = [(r, [m for m in found if m not in memories]) for r, found in pending]
    elif kind == "clear":
        context, pending = [], []
    return {"context": context, "pending": pending, "touched": event["at_us"]}


def _place(event: dict[str, Any]) -> tuple:
    recall = event["recall_id"]
    return event["at_us"], RANK.get(event["type"], 9), recall is not None, recall or ""


def _ordered(events: pd.DataFrame) -> list[dict[str, Any]]:
    return sorted(events.to_dict("records"), key=_place)


STATE = "context array<bigint>, recalls array<string>, found array<array<bigint>>, touched bigint"
HELD = "bank_id long, session_id string, " + STATE


def _packed(state: dict[str, Any]) -> tuple:
    return state["context"], [r for r, _ in state["pending"]], [f for _, f in state["pending"]], state["touched"]


def session_states(events: DataFrame) -> DataFrame:
    """What each session of a table holds after its events, pending look-ups too: where a stream may go on from."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = None
        for event in _ordered(rows):
            state = step(state, event)
        return pd.DataFrame([(*key, *_packed(state))], columns=["bank_id", "session_id", "context", "recalls", "found", "touched"])

    return events.groupBy("bank_id", "session_id").applyInPandas(run, HELD)


def session_context(events: DataFrame) -> DataFrame:
    """(bank_id, session_id, at_us, in_context) after all events of each session in a table."""
    return session_states(events).select("bank_id", "session_id", F.col("touched").alias("at_us"), F.col("context").alias("in_context"))


def _one_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """Leave the key with this timer only."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_ms)


class _Sessions(StatefulProcessor):
    """A session's context and pending look-ups; a timer a week after its last event drops them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("session", STATE)

    def _keep(self, held: tuple, timers: TimerValues) -> None:
        self.held.update(held)
        _one_timer(self.handle, max((held[3] + IDLE_US) // 1000, timers.getCurrentWatermarkInMs() + 1))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        self._keep(tuple(initialState[c] for c in ("context", "recalls", "found", "touched")), timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        state = None
        if self.held.exists():
            context, recalls, found, touched = self.held.get()
            state = {"context": list(context), "pending": list(zip(recalls, [list(f) for f in found], strict=True)), "touched": touched}
        for event in sorted((r.asDict() for r in rows), key=_place):
            state = step(state, event)
        self._keep(_packed(state), timerValues)
        yield Row(bank_id=key[0], session_id=key[1], at_us=state["touched"], in_context=state["context"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter([])


def stream_session_context(events: DataFrame, late: str = "10 minutes", held: DataFrame | None = None) -> DataFrame:
    """The same of a stream with ``event_time``: a row for each session that a batch touched; a week's silence drops the state.

    ``held`` are the ``session_states`` of the events before the stream, which the
    first batch takes over. State is kept as ``keyed_state`` says.
    """
    keyed_state(events.sparkSession)
    rows = events.withWatermark("event_time", late).groupBy("bank_id", "session_id")
    return rows.transformWithState(_Sessions(), CONTEXT, "update", "EventTime", held.groupBy("bank_id", "session_id") if held is not None else None)


def debounced(times: list[int]) -> list[tuple[int, int, int]]:
    """(first, due, triggers) of each burst: due after five quiet minutes, thirty after its first trigger at most."""
    out: list[list[int]] = []
    for t in sorted(times):
        if out and t < out[-1][1]:
            out[-1][1] = min(t + QUIET_US, out[-1][0] + CAP_US)
            out[-1][2] += 1
        else:
            out.append([t, min(t + QUIET_US, t + CAP_US), 1])
    return [tuple(x) for x in out]


DUE = "bank_id long, first_us long, due_us long, triggers long"
OPEN = "bank_id long, times array<bigint>"


def _bursts(triggers: DataFrame, until_us: int | None, over: bool) -> DataFrame:
    """Bursts whose due time has come by ``until_us`` (all without one), or, not ``over``, the triggers of those still open then.

    Five quiet minutes end a burst in any case, so a bank's triggers fall into
    session windows, and each window is cut at the cap by itself.
    """
    window = F.session_window(F.timestamp_micros("at_us"), "5 minutes")
    rows = triggers.groupBy("bank_id", window.alias("w")).agg(F.collect_list("at_us").alias("times"), F.max("at_us").alias("last"))
    if not over:  # not by the window's end: that filter would be pushed below the windows' merge
        rows = rows.where(F.col("last") + QUIET_US > until_us)
    columns = ["bank_id", "first_us", "due_us", "triggers"] if over else ["bank_id", "times"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for bank, times in zip(b["bank_id"], b["times"], strict=True):
                bursts, times = debounced(list(times)), sorted(times)
                done = [x for x in bursts if until_us is None or x[1] <= until_us]
                left = times[sum(x[2] for x in done) :]
                found += [(bank, *x) for x in done] if over else [(bank, left)] if left else []
            yield pd.DataFrame(found, columns=columns)

    return rows.select("bank_id", "times").mapInPandas(run, DUE if over else OPEN)


def trigger_debounce(triggers: DataFrame, until_us: int | None = None) -> DataFrame:
    """(bank_id, first_us, due_us, triggers) of a table, or of its bursts that are due by ``until_us``."""
    return _bursts(triggers, until_us, True)


def open_triggers(triggers: DataFrame, until_us: int) -> DataFrame:
    """(bank_id, times): the triggers up to ``until_us`` whose burst is not due then, where a stream may go on from."""
    return _bursts(triggers.where(F.col("at_us") <= until_us), until_us, False)


class _Bursts(StatefulProcessor):
    """The triggers of bursts that are not due; a timer at the first due time gives bursts out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("triggers", "times array<bigint>")

    def _held(self) -> list[int]:
        return list(self.times.get()[0]) if self.times.exists() else []

    def _keep(self, times: list[int], timers: TimerValues) -> None:
        self.times.update((times,))
        _one_timer(self.handle, max(-(-debounced(times)[0][1] // 1000), timers.getCurrentWatermarkInMs() + 1))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        self._keep(self._held() + list(initialState["times"]), timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        self._keep(self._held() + [r["at_us"] for r in rows], timerValues)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        times, mark = sorted(self._held()), timerValues.getCurrentWatermarkInMs() * 1000
        over = [b for b in debounced(times) if b[1] <= mark]
        left = times[sum(b[2] for b in over) :]
        if left:
            self._keep(left, timerValues)
        else:
            self.times.clear()
        for first, due, n in over:
            yield Row(bank_id=key[0], first_us=first, due_us=due, triggers=n)


def stream_trigger_debounce(triggers: DataFrame, late: str = "1 minute", held: DataFrame | None = None) -> DataFrame:
    """Bursts of a stream with ``event_time``, each given out once the watermark has passed its due time.

    ``held`` are the ``open_triggers`` of the table before the stream. State is kept as ``keyed_state`` says.
    """
    keyed_state(triggers.sparkSession)
    rows = triggers.withWatermark("event_time", late).groupBy("bank_id")
    return rows.transformWithState(_Bursts(), DUE, "append", "EventTime", held.groupBy("bank_id") if held is not None else None)


KEY = ("bank_id", "session_id", "message_at", "content_hash")


def stream_turns(turns: DataFrame, stored: str, checkpoint: str, before: DataFrame | None = None) -> StreamingQuery:
    """Append each turn of a stream once to the table at ``stored``, however often and late it comes again; returns the running query.

    Turns are redacted, hashed and, where they ask to forget, reduced to their
    keys, as ``history.ingest_turns`` does. The keys seen stay in state on disk
    and never expire, so no batch reads what is stored. ``before`` is a
    table that was stored before the stream began; its keys are matched as they
    stood then. Each batch is a folder of its own, which a second run of a failed
    batch writes over. State is kept as ``keyed_state`` says.
    """
    keyed_state(turns.sparkSession)
    new = keyed_turns(turns).dropDuplicates(list(KEY))
    if before is not None:
        new = new.join(before.select(*KEY).distinct(), list(KEY), "left_anti")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{stored}/batch={n}")

    return new.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(turns: DataFrame, stored: str, checkpoint: str, key: tuple[str, ...] = ("bank_id", "session_id", "message_at", "turn_hash")):
    """Append each turn once to the table at ``stored``, however often and late it comes again; returns the running query.

    For tables of any key without state of their own: each batch reads the stored keys (``stream_turns`` does not). A batch that is run again after a failure finds its own rows stored already.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(key))
        if spark._jvm.org.apache.hadoop.fs.Path(stored).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(stored)):
            known = spark.read.schema(batch.schema).parquet(stored).select(*key)
            new = new.join(known, list(key), "left_anti")
        new.write.mode("append").parquet(stored)

    return turns.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
