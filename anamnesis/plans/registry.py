"""Every registered query of the memory-bank operators and its DuckDB SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.operators import history as H
from anamnesis.operators import recall as R
from anamnesis.operators import strength as S
from anamnesis.sources.fixtures import DERIVED, derived, views, with_derived

NOW = "2024-02-15 00:00:00"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_derived(sql) if any(n in sql for n in DERIVED) else sql
        return f

    return put


def _checkpoints(spark: SparkSession) -> None:
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="anamnesis-"))


def _micros(x: str) -> str:
    return f"epoch_us({x})"


@query(f"""
WITH t AS (SELECT DISTINCT bank_id, {_micros('message_at')} AS s FROM d_messages),
g AS (SELECT *, CASE WHEN s <= max(s) OVER (PARTITION BY bank_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 86400000000 THEN 0 ELSE 1 END AS new FROM t),
i AS (SELECT *, sum(new) OVER (PARTITION BY bank_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g),
m AS (SELECT bank_id, min(s) AS start_us, max(s) + 86400000000 AS end_us FROM i GROUP BY bank_id, island)
SELECT bank_id, start_us, end_us, CAST(coalesce(sum(end_us - start_us) OVER (PARTITION BY bank_id ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_before_us FROM m
""")
def bank_windows(spark, d):
    return S.bank_windows(derived(spark, d, "d_messages"))


@query("""
WITH r AS (SELECT memory_id, memory_id AS head_id, superseded_by AS nxt FROM d_memories
UNION ALL SELECT r.memory_id, m.memory_id, m.superseded_by FROM r JOIN d_memories m ON r.nxt = m.memory_id)
SELECT memory_id, head_id FROM r WHERE nxt IS NULL
""")
def chain_heads(spark, d):
    _checkpoints(spark)
    return S.chain_heads(derived(spark, d, "d_memories"))


_SQL["chain_heads"] = _SQL["chain_heads"].replace("WITH d_", "WITH RECURSIVE d_", 1)


@query("""
WITH a AS (SELECT DISTINCT memory_id, epoch_us(accessed_at) AS t FROM d_accesses WHERE accessed_at <= TIMESTAMP '2024-02-15 00:00:00'),
o AS (SELECT memory_id, min(t) AS t FROM a GROUP BY 1 UNION ALL SELECT memory_id, t FROM (SELECT o.memory_id, min(a.t) AS t FROM o JOIN a ON a.memory_id = o.memory_id AND a.t >= o.t + 259200000000 GROUP BY o.memory_id, o.t) n)
SELECT memory_id, count(*) AS occasions FROM o GROUP BY 1
""")
def occasions(spark, d):
    return S.occasions(derived(spark, d, "d_accesses"), NOW)


_SQL["occasions"] = _SQL["occasions"].replace("WITH d_", "WITH RECURSIVE d_", 1)


def _strength(spark, d, at=NOW):
    _checkpoints(spark)
    return S.strength(derived(spark, d, "d_memories"), derived(spark, d, "d_accesses"), derived(spark, d, "d_messages"), at)


@query()
def strength(spark, d):
    return _strength(spark, d)


@query()
def band_counts(spark, d):
    return _strength(spark, d).groupBy("bank_id", S.band(F.col("value")).alias("band")).agg(F.count("*").alias("memories"))


@query("""
SELECT memory_id, CASE WHEN volatility IS NULL THEN 1.0 ELSE 1 / (1 + pow(greatest(0.0, (epoch_us(TIMESTAMP '2024-02-15 00:00:00') - greatest(epoch_us(m.observed_at), coalesce(a.us, epoch_us(m.observed_at)))) / 86400000000.0)
  / CASE volatility WHEN 'hours' THEN 0.125 WHEN 'days' THEN 3.0 WHEN 'weeks' THEN 21.0 WHEN 'months' THEN 91.31 ELSE 1826.2 END, 2)) END AS confidence
FROM d_memories m LEFT JOIN (SELECT memory_id AS mid, max(epoch_us(accessed_at)) AS us FROM d_accesses WHERE kind IN ('mentioned_again', 'confirmed') AND accessed_at <= TIMESTAMP '2024-02-15 00:00:00' GROUP BY 1) a ON m.memory_id = a.mid
""")
def state_confidence(spark, d):
    now = F.lit(NOW).cast("timestamp")
    said = derived(spark, d, "d_accesses").where(F.col("kind").isin("mentioned_again", "confirmed") & (F.col("accessed_at") <= now)).groupBy("memory_id").agg(F.max("accessed_at").alias("said"))
    return derived(spark, d, "d_memories").join(said, "memory_id", "left").select("memory_id", S.state_confidence(F.col("observed_at"), F.col("said"), F.col("volatility"), now).alias("confidence"))


@query("""
SELECT memory_id, CASE WHEN valid_from IS NOT NULL AND observed_at < valid_from AND TIMESTAMP '2024-02-15 00:00:00' < valid_from + INTERVAL 1 DAY THEN 'upcoming'
  WHEN closes <= TIMESTAMP '2024-02-15 00:00:00' THEN CASE WHEN TIMESTAMP '2024-02-15 00:00:00' < closes + INTERVAL 30 DAY THEN 'recently_past' ELSE 'long_past' END
  WHEN kind = 'task' AND observed_at < due_at AND TIMESTAMP '2024-02-15 00:00:00' >= due_at + INTERVAL 1 DAY THEN 'overdue' ELSE 'current' END AS phase
FROM (SELECT *, coalesce(valid_until, CASE WHEN kind = 'event' THEN valid_from END) + INTERVAL 1 DAY AS closes FROM d_memories) x
""")
def phase(spark, d):
    m, now, day, utc = derived(spark, d, "d_memories"), F.lit(NOW).cast("timestamp"), F.lit("day"), F.lit("UTC")
    end = lambda c: S.unit_end(c.cast("timestamp"), day, utc)
    closes = end(F.coalesce("valid_until", F.when(F.col("kind") == "event", F.col("valid_from"))))
    return m.select("memory_id", S.phase(now, F.col("observed_at").cast("timestamp"), F.col("valid_from").cast("timestamp"), end(F.col("valid_from")), closes, F.col("due_at").cast("timestamp"), end(F.col("due_at")), F.col("kind") == "task").alias("phase"))


@query("""
SELECT bank_id, CASE WHEN hidden THEN 'forgetting' WHEN retracted THEN 'retracted' WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN valid_until <= TIMESTAMP '2024-02-15 00:00:00' THEN 'ended' ELSE 'live' END AS status, count(*) AS memories
FROM d_memories GROUP BY 1, 2
""")
def status_counts(spark, d):
    ended = F.coalesce(F.col("valid_until") <= F.lit(NOW).cast("timestamp"), F.lit(False))
    status = H.memory_status(F.col("retracted"), F.col("superseded_by").isNotNull(), ended, F.col("hidden"))
    return derived(spark, d, "d_memories").groupBy("bank_id", status.alias("status")).agg(F.count("*").alias("memories"))


@query("""
SELECT bank_id, kind, significance, count(*) AS memories, CAST(sum(CASE WHEN owner_significance = 'kept' THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM d_memories GROUP BY 1, 2, 3
""")
def bank_histograms(spark, d):
    return derived(spark, d, "d_memories").groupBy("bank_id", "kind", "significance").agg(F.count("*").alias("memories"), F.sum(F.when(F.col("owner_significance") == "kept", 1).otherwise(0)).alias("kept"))


@query("""
WITH r AS (SELECT session_id, bank_id, turn, role, text, message_at, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_no FROM d_messages),
q AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_no, role ORDER BY turn DESC) AS rn FROM r)
SELECT session_id, bank_id, CAST(turn_no AS BIGINT) AS turn_no, min(message_at) AS message_at, max(CASE WHEN role = 'user' THEN text END) AS user_text, max(CASE WHEN role = 'assistant' AND rn = 1 THEN text END) AS reply_text
FROM q WHERE turn_no > 0 GROUP BY session_id, bank_id, turn_no
""")
def pair_turns(spark, d):
    return H.pair_turns(derived(spark, d, "d_messages"))


@query("""
WITH u AS (SELECT session_id, turn, text, lag(text) OVER (PARTITION BY session_id ORDER BY turn) AS previous FROM d_messages WHERE role = 'user')
SELECT session_id, turn, CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) < 8 AND length(coalesce(previous, '')) > 0 THEN previous || chr(10) || text ELSE text END AS query FROM u
""")
def effective_query(spark, d):
    return H.previous_query(derived(spark, d, "d_messages")).select("session_id", "turn", R.effective_query(F.col("text"), F.col("previous")).alias("query"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def document_hash(spark, d):
    views(spark, d)
    return spark.table("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'stored' END AS outcome FROM documents
""")
def ingest_documents(spark, d):
    views(spark, d)
    batch = spark.table("documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return H.ingest(batch, batch.where("false"), ["source", "hash"], "doc_id").select("doc_id", "outcome")


@query("""
SELECT session_id AS bank, turn AS source_id, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS BIGINT) AS turn_number FROM d_messages
""")
def turn_numbers(spark, d):
    rows = derived(spark, d, "d_messages").select(F.col("session_id").alias("bank_id"), F.col("turn").alias("source_id"), F.when(F.col("role") == "user", "turn").otherwise("document").alias("kind"))
    return H.turn_numbers(rows).select(F.col("bank_id").alias("bank"), "source_id", "turn_number")


@query("""
SELECT memory_id, turn, access_id, kind FROM (SELECT memory_id, access_id % 50 AS turn, access_id, kind, row_number() OVER (PARTITION BY memory_id, access_id % 50 ORDER BY CASE kind WHEN 'confirmed' THEN 2.0 WHEN 'mentioned_again' THEN 1.5 ELSE 1.0 END DESC, access_id) AS n FROM d_accesses) x WHERE n = 1
""")
def dedupe_accesses(spark, d):
    rows = derived(spark, d, "d_accesses").withColumn("turn", F.col("access_id") % 50)
    return H.dedupe_accesses(rows, S.WEIGHTS).select("memory_id", "turn", "access_id", "kind")


@query("""
WITH r AS (SELECT user_id % 3 AS level, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id % 3) AS n FROM events)
SELECT level, max(CASE WHEN i - 1 = floor((n - 1) * 0.5 + 0.5) THEN value END) AS p50, max(CASE WHEN i - 1 = floor((n - 1) * 0.95 + 0.5) THEN value END) AS p95, max(CASE WHEN i - 1 = floor((n - 1) * 0.99 + 0.5) THEN value END) AS p99 FROM r GROUP BY level
""")
def latency_levels(spark, d):
    views(spark, d)
    rows = spark.table("events").select((F.col("user_id") % 3).alias("level"), "value")
    return H.nearest_rank(rows, ["level"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""
WITH s AS (SELECT d.n_chars % 1000 AS score, count(*) AS n, sum(l.quality) AS r FROM labels l JOIN documents d USING (doc_id) GROUP BY 1)
SELECT score, CAST(sum(n) OVER w AS BIGINT) AS kept, CAST(sum(r) OVER w AS BIGINT) AS relevant, sum(r) OVER w / sum(n) OVER w AS precision FROM s WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def precision_curve(spark, d):
    views(spark, d)
    rows = spark.table("labels").join(spark.table("documents"), "doc_id").select((F.col("n_chars") % 1000).alias("score"), F.col("quality").cast("long").alias("relevant"))
    return H.precision_curve(rows)


@query("""
SELECT memory_id % 8 AS bank_id, CAST(accessed_at AS DATE) AS day, kind, count(*) AS accesses FROM d_accesses GROUP BY 1, 2, 3
""")
def day_counts(spark, d):
    rows = derived(spark, d, "d_accesses")
    return rows.groupBy((F.col("memory_id") % 8).alias("bank_id"), F.to_date("accessed_at").alias("day"), "kind").agg(F.count("*").alias("accesses"))


def _queries(spark):
    return spark.table("benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 8).alias("bank_id"), F.col("text").alias("query"))


_BM25 = r"""
WITH w AS (SELECT memory_id, bank_id, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM d_memories),
st AS (SELECT count(*) AS docs, avg(len(t)) AS mean_size FROM w),
c AS (SELECT memory_id, bank_id, size, term, count(*) AS tf FROM (SELECT memory_id, bank_id, len(t) AS size, unnest(t) AS term FROM w) x GROUP BY 1, 2, 3, 4),
df AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
q AS (SELECT DISTINCT query_id, bank_id, term FROM (SELECT item_id AS query_id, item_id % 8 AS bank_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark) y),
s AS (SELECT q.query_id, c.memory_id, sum(ln(1 + (docs - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean_size))) AS score
  FROM q JOIN df ON q.term = df.term JOIN c ON c.term = q.term AND c.bank_id = q.bank_id CROSS JOIN st GROUP BY 1, 2),
b AS (SELECT query_id, memory_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, memory_id) AS rank FROM s) z WHERE rank <= 100)
"""


@query(_BM25 + "SELECT query_id, memory_id, rank FROM b")
def bm25_top_k(spark, d):
    m = derived(spark, d, "d_memories")
    return R.bm25_top_k(m, _queries(spark)).select("query_id", "memory_id", "rank")


@query(_BM25 + """, f AS (SELECT query_id, memory_id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT query_id, memory_id, rank FROM b UNION ALL
  SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY memory_id DESC) AS rank FROM b) u GROUP BY 1, 2)
SELECT query_id, memory_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, memory_id) AS rank FROM f
""")
def rrf_fuse(spark, d):
    m = derived(spark, d, "d_memories")
    arm = R.bm25_top_k(m, _queries(spark)).select("query_id", "memory_id", "rank")
    newest = arm.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("memory_id"))))
    return R.rrf_fuse(arm.withColumn("arm", F.lit("text")).unionByName(newest.withColumn("arm", F.lit("newest"))))


@query()
def gate_injection(spark, d):
    m = derived(spark, d, "d_memories")
    rows = R.bm25_top_k(m, _queries(spark)).where("rank <= 40").join(m.select("memory_id", F.length("content").alias("chars")), "memory_id")
    return R.gate(rows, floor=5.0)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_counts(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
