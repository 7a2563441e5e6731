"""Registered queries of history import, run reports, attention and audit lists, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.operators import history as H
from anamnesis.operators import reports as P
from anamnesis.operators import upkeep as U
from anamnesis.plans.registry import query
from anamnesis.sources import history as S
from anamnesis.sources.fixtures import derived, views

_MESSAGES = """
SELECT CAST(conv_id AS BIGINT) * 1000 + turn AS id, CAST(conv_id AS STRING) AS session_id, CASE WHEN turn % 11 = 10 THEN 'tool' ELSE role END AS role, text AS content,
  CAST(conv_id * 100000 + (turn - turn % 13) * 60 AS DOUBLE) AS timestamp, CAST(CASE WHEN (conv_id + turn) % 9 = 4 THEN 0 ELSE 1 END AS BIGINT) AS active, CAST(CASE WHEN (conv_id + turn) % 18 = 4 THEN 1 ELSE 0 END AS BIGINT) AS compacted,
  CAST(CASE WHEN conv_id % 4 = 1 AND turn = 3 THEN 1 ELSE 0 END AS BIGINT) AS _compressed_summary,
  CASE (conv_id + turn) % 6 WHEN 1 THEN '[{"name": "f"}]' WHEN 2 THEN '[]' WHEN 3 THEN 'null' END AS tool_calls, CASE (conv_id + turn) % 10 WHEN 2 THEN 'steer' WHEN 4 THEN 'note' END AS display_kind
FROM conversations
"""
_SESSIONS = """
SELECT DISTINCT CAST(conv_id AS STRING) AS id, CASE conv_id % 7 WHEN 1 THEN 'cron' WHEN 2 THEN 'subagent' ELSE 'chat' END AS source, CASE WHEN conv_id % 9 = 5 THEN '0' END AS parent_session_id FROM conversations
"""
_CHOSEN = f"""
s AS ({_SESSIONS}), m AS ({_MESSAGES}), c AS (SELECT id AS session_id, CASE WHEN source = 'cron' THEN 'cron' ELSE 'primary' END AS class FROM s WHERE parent_session_id IS NULL AND source <> 'subagent'),
a AS (SELECT m.*, class, _compressed_summary = 1 AS cut, coalesce(tool_calls LIKE '[{{%', FALSE) AS calls FROM m JOIN c USING (session_id) WHERE active = 1 OR compacted = 1)"""
_TURNS = f"""
WITH {_CHOSEN},
n AS (SELECT *, sum(CASE WHEN cut OR role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS segment FROM a),
o AS (SELECT session_id, segment, class, cut, timestamp AS opened_at, coalesce(content, '') AS query, coalesce(display_kind = 'note', FALSE) AND NOT cut AS synthetic FROM n WHERE cut OR role = 'user'),
r AS (SELECT session_id, segment, coalesce(content, '') AS reply, timestamp AS reply_at FROM n WHERE NOT cut AND role = 'assistant' AND NOT calls QUALIFY row_number() OVER (PARTITION BY session_id, segment ORDER BY timestamp DESC, id DESC) = 1),
t AS (SELECT o.*, r.reply, r.reply_at, class = 'primary' AND NOT cut AND r.session_id IS NOT NULL AND NOT synthetic AS synced, lag(query) OVER (PARTITION BY o.session_id, cut ORDER BY o.segment) AS before FROM o LEFT JOIN r ON o.session_id = r.session_id AND o.segment = r.segment)
"""


def _history(spark, d):
    views(spark, d)
    sessions = S.select_sessions(spark.sql(_SESSIONS))
    return sessions, S.active_messages(spark.sql(_MESSAGES))


def _turns(spark, d):
    return H.import_turns(*_history(spark, d))


@query(f"WITH {_CHOSEN} SELECT session_id, class, count(*) AS messages, min(timestamp) AS first_at FROM a GROUP BY 1, 2")
def active_history(spark, d):
    """The chosen sessions with their active messages counted."""
    sessions, messages = _history(spark, d)
    rows = messages.join(sessions.select(F.col("id").alias("session_id"), "class"), "session_id")
    return rows.groupBy("session_id", "class").agg(F.count("*").alias("messages"), F.min("timestamp").alias("first_at"))


@query(
    _TURNS
    + """SELECT session_id, CAST(segment AS BIGINT) AS segment, cut AS clear, opened_at AS "at", CASE WHEN NOT cut THEN query END AS query, CASE WHEN NOT cut THEN before END AS previous_query, synthetic, synced,
CASE WHEN synced THEN reply END AS reply, CASE WHEN synced THEN greatest(reply_at, opened_at) END AS reply_at FROM t"""
)
def import_turns(spark, d):
    return _turns(spark, d)


@query(
    _TURNS
    + """, k AS (SELECT count(*) FILTER (synced) AS a, count(*) FILTER (NOT cut AND NOT synced) AS b, count(*) FILTER (synthetic) AS c, count(*) FILTER (cut) AS e FROM t)
SELECT 'turns' AS counter, a AS n FROM k UNION ALL SELECT 'prefetch_only', b FROM k UNION ALL SELECT 'synthetic', c FROM k UNION ALL SELECT 'compactions', e FROM k
UNION ALL SELECT 'tool_rows', count(*) FROM a WHERE NOT cut AND (role NOT IN ('user', 'assistant') OR (role = 'assistant' AND calls))"""
)
def import_turn_counts(spark, d):
    sessions, messages = _history(spark, d)
    own = messages.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return H.import_turn_counts(H.import_turns(sessions, messages), own)


_FATES = """
f AS (SELECT access_id % 2 AS run, memory_id AS id, max(CASE WHEN kind = 'used' THEN 1 ELSE 0 END) = 0 AS faded, max(CASE WHEN kind = 'confirmed' THEN 1 ELSE 0 END) = 1 AS purged FROM d_accesses GROUP BY 1, 2)"""


@query(f"""
WITH {_FATES}, x AS (SELECT * FROM f WHERE run = 0), y AS (SELECT * FROM f WHERE run = 1),
j AS (SELECT coalesce(x.id, y.id) AS id, x.id AS a, y.id AS b, coalesce(x.faded, FALSE) AS fa, coalesce(y.faded, FALSE) AS fb, coalesce(x.purged, FALSE) AS pa, coalesce(y.purged, FALSE) AS pb FROM x FULL JOIN y ON x.id = y.id)
SELECT id, 'only_in_a' AS difference FROM j WHERE b IS NULL UNION ALL SELECT id, 'only_in_b' FROM j WHERE a IS NULL UNION ALL SELECT id, 'faded_only_in_a' FROM j WHERE fa AND NOT fb
UNION ALL SELECT id, 'faded_only_in_b' FROM j WHERE fb AND NOT fa UNION ALL SELECT id, 'purged_only_in_a' FROM j WHERE pa AND NOT pb UNION ALL SELECT id, 'purged_only_in_b' FROM j WHERE pb AND NOT pa
""")
def fate_diff(spark, d):
    """The memories with accesses of even and of odd numbers, as those of two runs."""
    saw = lambda k: F.max(F.when(F.col("kind") == k, 1).otherwise(0))
    rows = derived(spark, d, "d_accesses").groupBy((F.col("access_id") % 2).alias("run"), F.col("memory_id").alias("id")).agg((saw("used") == 0).alias("faded"), (saw("confirmed") == 1).alias("purged"))
    return U.fate_diff(rows.where("run = 0"), rows.where("run = 1"))


@query("""
WITH p AS (SELECT access_id % 2 AS run, memory_id AS id, count(*) % 2 = 0 AS passed FROM d_accesses GROUP BY 1, 2)
SELECT coalesce(x.id, y.id) AS id, x.passed AS before, y.passed AS after FROM (SELECT * FROM p WHERE run = 0) x FULL JOIN (SELECT * FROM p WHERE run = 1) y ON x.id = y.id WHERE x.passed IS DISTINCT FROM y.passed
""")
def probe_diff(spark, d):
    """Memories as probes that pass with an even number of accesses."""
    rows = derived(spark, d, "d_accesses").groupBy((F.col("access_id") % 2).alias("run"), F.col("memory_id").alias("id")).agg((F.count("*") % 2 == 0).alias("passed"))
    return U.probe_diff(rows.where("run = 0"), rows.where("run = 1"))


@query("""
WITH c AS (SELECT CASE WHEN hidden THEN 'forgetting' WHEN retracted THEN 'retracted' WHEN superseded_by IS NOT NULL THEN 'superseded' ELSE 'live' END AS status, count(*) AS memories FROM d_memories WHERE kind = 'event' OR significance = 'major' GROUP BY 1)
SELECT status, memories, CAST((SELECT sum(memories) FROM c WHERE status IN ('live', 'superseded')) AS BIGINT) AS total FROM c
""")
def status_totals(spark, d):
    rows = derived(spark, d, "d_memories").where("kind = 'event' OR significance = 'major'")
    status = F.when(F.col("hidden"), "forgetting").when(F.col("retracted"), "retracted").when(F.col("superseded_by").isNotNull(), "superseded").otherwise("live")
    return U.status_totals(rows, status, ["live", "superseded"])


@query("""
WITH a AS (SELECT bank_id, count(*) FILTER (failed) AS failed FROM d_sources GROUP BY 1), b AS (SELECT bank_id, count(*) FILTER (memory_id % 37 = 0) AS r FROM d_memories GROUP BY 1), e AS (SELECT DISTINCT bank_id FROM d_memories)
SELECT bank_id, failed || ' failed chunks' AS attention FROM a WHERE failed > 0 UNION ALL SELECT bank_id, r || ' failed refreshes' FROM b WHERE r > 0
UNION ALL SELECT bank_id, CASE WHEN bank_id % 3 = 0 THEN 'its rebuild is complete and its sweep waits' ELSE 'its memories are being rebuilt, so recall is off' END FROM e WHERE bank_id % 2 = 0
UNION ALL SELECT NULL, 'purge is paused: the deletion fingerprint changed from x to y'
""")
def bank_attention(spark, d):
    """Every even bank has a rebuild that nobody has acknowledged."""
    m = derived(spark, d, "d_memories")
    health = P.bank_health(derived(spark, d, "d_sources"), m.select("bank_id", (F.col("memory_id") % 37 == 0).alias("failed")))
    rebuilds = m.select("bank_id").distinct().select("bank_id", (F.col("bank_id") % 3 == 0).alias("completed"), (F.col("bank_id") % 2 == 1).alias("acked"))
    return P.bank_attention(health, rebuilds, "x", "y")


@query("""
WITH r AS (SELECT event_id AS recall_id, user_id % 8 AS bank_id, ts FROM events WHERE event_type = 'click'),
n AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY ts DESC, recall_id DESC) AS number FROM r QUALIFY number <= 20),
g AS (SELECT recall_id, k.rank AS rank, (recall_id * 7 + k.rank * 13) % (2 * (SELECT count(*) FROM documents)) AS memory_id FROM n, (VALUES (1), (2), (3)) AS k(rank))
SELECT n.bank_id, n.recall_id, number, coalesce(string_agg(CAST(m.memory_id AS VARCHAR), ',' ORDER BY g.rank) FILTER (m.memory_id IS NOT NULL), '') AS results FROM n LEFT JOIN g ON g.recall_id = n.recall_id LEFT JOIN d_memories m ON m.memory_id = g.memory_id GROUP BY 1, 2, 3
""")
def recall_lists(spark, d):
    """Each click recalls three memories, about half of which are gone."""
    m = derived(spark, d, "d_memories")
    recalls = spark.table("events").where("event_type = 'click'").select(F.col("event_id").alias("recall_id"), (F.col("user_id") % 8).alias("bank_id"), F.col("ts").alias("at"))
    got = spark.sql("SELECT event_id AS recall_id, rank, (event_id * 7 + rank * 13) % (2 * (SELECT count(*) FROM documents)) AS memory_id FROM events LATERAL VIEW explode(array(1, 2, 3)) AS rank WHERE event_type = 'click'")
    rows = P.recall_lists(recalls, got, m, 20)
    return rows.select("bank_id", "recall_id", "number", F.array_join(F.col("results").cast("array<string>"), ",").alias("results"))


@query("""
WITH s AS (SELECT bank_id, CAST(ingested_at AS DATE) AS day, count(*) AS swept FROM d_sources WHERE removed OR tombstoned GROUP BY 1, 2)
SELECT bank_id, CAST(epoch_us(day) // 86400000000 AS BIGINT) AS sweep_id, swept, row_number() OVER (PARTITION BY bank_id ORDER BY day DESC) AS number FROM s QUALIFY number <= 10
""")
def sweep_lists(spark, d):
    """A day's removed sources of a bank, as one sweep; the ten newest of each bank."""
    rows = derived(spark, d, "d_sources").where("removed OR tombstoned").groupBy("bank_id", F.to_date("ingested_at").alias("day")).agg(F.count("*").alias("swept"))
    rows = rows.withColumn("sweep_id", F.unix_date("day").cast("long"))
    return P.newest(rows, "day", "sweep_id", 10).select("bank_id", "sweep_id", "swept", "number")
