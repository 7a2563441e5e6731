"""Registered queries of chunking, purge, entities, models, browsing, reports and text rules, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.operators import browse as B
from anamnesis.operators import chunking as C
from anamnesis.operators import fading as Z
from anamnesis.operators import history as H
from anamnesis.operators import recall as R
from anamnesis.operators import strength as S
from anamnesis.operators import upkeep as U
from anamnesis.plans.registry import _BM25, _SQL, NOW, _checkpoints, _queries, _strength, query
from anamnesis.sources.fixtures import derived, views
from anamnesis.streaming.counts import stream_bank_activity, stream_counts


def _documents(spark, d):
    views(spark, d)
    return spark.table("documents")


@query()
def chunk_documents(spark, d):
    return C.chunk_documents(_documents(spark, d)).drop("text")


@query()
def new_chunks(spark, d):
    """Documents of one source and language are versions of one document."""
    docs = _documents(spark, d)
    names = docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("document"))
    chunks = C.chunk_documents(docs).join(names, "doc_id").withColumnRenamed("doc_id", "version")
    return C.new_chunks(chunks.select("document", "version", "position", "chunk_hash"))


_MARKED = """CASE turn % 4 WHEN 0 THEN 'x <memory-context>' || text || '</memory-context> y' WHEN 1 THEN text || '[New message]  ' || role
  WHEN 2 THEN '[Ann] ' || text ELSE text || '<memory-context> open' END"""


@query(rf"""
SELECT session_id, turn, trim(regexp_replace(regexp_replace(t, '<memory-context>.*?</memory-context>', '', 'gs'), '<memory-context>.*$', '', 's')) AS unmarked,
  CASE WHEN contains(t, '[New message]') THEN ltrim(list_last(string_split(t, '[New message]'))) ELSE t END AS message,
  trim(regexp_replace(t, '^\[[^\]\n]+\] ', '')) AS query
FROM (SELECT session_id, turn, {_MARKED} AS t FROM d_messages) x
""")
def clean_text(spark, d):
    rows = derived(spark, d, "d_messages").withColumn("t", F.expr(_MARKED))
    return rows.select("session_id", "turn", H.strip_memory_block(F.col("t")).alias("unmarked"), H.strip_backfill(F.col("t")).alias("message"), H.clean_query(F.col("t")).alias("query"))


@query()
def redact_secrets(spark, d):
    text, kinds = H.redact_secrets(F.coalesce("text", F.lit("")))
    return _documents(spark, d).select("doc_id", F.array_join(kinds, ",").alias("kinds"), F.sha2(text, 256).alias("redacted_sha256"))


def _length_blob(x: str) -> str:
    big = f"lpad(to_hex(octet_length(encode({x}))), 16, '0')"
    return "unhex(" + " || ".join(f"substring({big}, {k}, 2)" for k in range(15, 0, -2)) + ")"


@query(f"""
SELECT session_id, turn, sha256({_length_blob('text')} || encode(text) || {_length_blob('role')} || encode(role)) AS turn_hash
FROM (SELECT session_id, turn, coalesce(text, '') AS text, coalesce(role, '') AS role FROM d_messages) x
""")
def turn_hash(spark, d):
    return derived(spark, d, "d_messages").select("session_id", "turn", H.turn_hash(F.col("text"), F.col("role")).alias("turn_hash"))


@query("""
WITH r AS (SELECT memory_id, memory_id AS head_id, superseded_by AS nxt FROM d_memories
UNION ALL SELECT r.memory_id, m.memory_id, m.superseded_by FROM r JOIN d_memories m ON r.nxt = m.memory_id),
a AS (SELECT access_id, head_id, kind, turn FROM d_accesses JOIN r USING (memory_id) WHERE nxt IS NULL)
SELECT access_id, head_id, CASE WHEN kind = 'used' AND turn = min(CASE WHEN kind = 'used' THEN turn END) OVER (PARTITION BY head_id) THEN 'pending' ELSE 'counted' END AS state FROM a
""")
def corroborate_used(spark, d):
    _checkpoints(spark)
    heads = S.chain_heads(derived(spark, d, "d_memories"))
    return U.corroborate_used(derived(spark, d, "d_accesses"), heads).select("access_id", "head_id", "state")


_SQL["corroborate_used"] = _SQL["corroborate_used"].replace("WITH d_", "WITH RECURSIVE d_", 1)


def _eligible(spark, d, at=NOW):
    heads = derived(spark, d, "d_memories").where("superseded_by IS NULL")
    now, day, utc = F.lit(at).cast("timestamp"), F.lit("day"), F.lit("UTC")
    end = lambda c: S.unit_end(F.col(c).cast("timestamp"), day, utc)
    closes = S.closes_at(heads)
    due = F.when((F.col("kind") == "task") & (F.col("observed_at") < F.col("due_at")), U.overdue_until(end("due_at"), closes))
    rows = heads.join(_strength(spark, d, at).drop("bank_id"), "memory_id")
    may = U.purge_eligible(F.col("value"), F.col("lasting"), [end("valid_from"), end("valid_until")], due, F.col("hidden"), now)
    return rows.select("memory_id", "bank_id", may.alias("eligible"))


@query()
def purge_eligible(spark, d):
    return _eligible(spark, d)


@query()
def purge_plan(spark, d):
    """Per bank the memories, all versions of a chain, that a sweep would take when decades have passed."""
    gone = _eligible(spark, d, "2060-01-01 00:00:00").where("eligible").select(F.col("memory_id").alias("head_id"), "bank_id")
    return S.chain_heads(derived(spark, d, "d_memories")).join(gone, "head_id").groupBy("bank_id").agg(F.count("*").alias("memories"), F.count_distinct("head_id").alias("chains"))


@query()
def strongest_memories(spark, d):
    """The three strongest live memories of each source."""
    links = _documents(spark, d).select(F.col("doc_id").alias("memory_id"), F.col("source").alias("entity_id"))
    live = derived(spark, d, "d_memories").where("NOT hidden AND NOT retracted AND superseded_by IS NULL").select("memory_id")
    rows = links.join(live, "memory_id").join(_strength(spark, d).select("memory_id", "value"), "memory_id")
    order = W.partitionBy("entity_id").orderBy(F.desc("value"), "memory_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3")


_WORDS = r"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query(rf"""
WITH p AS (SELECT memory_id AS passage_id, ' ' || array_to_string({_WORDS.format(x='content')}, ' ') || ' ' AS said FROM d_memories),
a AS (SELECT doc_id AS entity_id, ' ' || array_to_string({_WORDS.format(x="array_to_string(list_slice(string_split_regex(text, '[ ]+'), 1, 2), ' ')")}, ' ') || ' ' AS called FROM documents WHERE doc_id % 50 = 0)
SELECT DISTINCT passage_id, entity_id FROM p JOIN a ON contains(said, called) WHERE length(trim(called)) > 0
""")
def entities_named(spark, d):
    """Aliases, the first two words of every fiftieth document, in all memories."""
    alias = F.array_join(F.slice(F.split("text", "[ ]+"), 1, 2), " ")
    aliases = _documents(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("entity_id"), alias.alias("alias"))
    return U.entities_named(derived(spark, d, "d_memories").select(F.col("memory_id").alias("passage_id"), F.col("content").alias("text")), aliases)


@query("""
SELECT d.source AS entity_id, count(DISTINCT memory_id) AS memories, count(DISTINCT CASE WHEN NOT hidden AND NOT retracted AND superseded_by IS NULL THEN memory_id END) AS live_memories, max(memory_id) AS newest
FROM d_memories m JOIN documents d ON d.doc_id = m.memory_id GROUP BY 1
""")
def entity_summary(spark, d):
    links = _documents(spark, d).select(F.col("doc_id").alias("memory_id"), F.col("source").alias("entity_id")).join(derived(spark, d, "d_memories"), "memory_id")
    return U.entity_summary(links, ~F.col("hidden") & ~F.col("retracted") & F.col("superseded_by").isNull())


_POOL = _BM25 + """, best AS (SELECT query_id % 5 AS model_id, memory_id, min(rank * 1000000 + query_id) AS k FROM b GROUP BY 1, 2),
pool AS (SELECT model_id, memory_id, k % 1000000 AS facet, position FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY k, memory_id) AS position FROM best) z WHERE position <= 90)
"""


def _pool(spark, d):
    ranked = R.bm25_top_k(derived(spark, d, "d_memories"), _queries(spark))
    return U.interleave_facets(ranked.select((F.col("query_id") % 5).alias("model_id"), "memory_id", "rank", F.col("query_id").alias("facet")))


@query(_POOL + "SELECT model_id, memory_id, facet, position FROM pool")
def interleave_facets(spark, d):
    return _pool(spark, d)


@query(_POOL + """SELECT model_id, sha256(string_agg(lpad(CAST(memory_id AS VARCHAR), 20, '0') || ':' || sha256(content) || ':' || significance, chr(10) ORDER BY memory_id)) AS fingerprint
FROM pool JOIN d_memories USING (memory_id) GROUP BY 1""")
def model_fingerprint(spark, d):
    return U.model_fingerprint(_pool(spark, d).join(derived(spark, d, "d_memories"), "memory_id"))


@query(_POOL + """SELECT model_id, model_id <> 0 AND NOT bool_or(hidden OR retracted OR coalesce(valid_until <= TIMESTAMP '2024-02-15 00:00:00', false)) AS current
FROM pool JOIN d_memories USING (memory_id) GROUP BY 1 UNION ALL SELECT 99, false""")
def current_answers(spark, d):
    """Model 0 also cites a memory that is gone from the table, model 99 none."""
    gone = F.col("hidden") | F.col("retracted") | F.coalesce(F.col("valid_until") <= F.lit(NOW).cast("timestamp"), F.lit(False))
    pool = _pool(spark, d)
    cites = pool.select("model_id", "memory_id").unionByName(spark.range(1).select(F.lit(0).cast("long").alias("model_id"), F.lit(-1).cast("long").alias("memory_id")))
    models = pool.select("model_id").distinct().union(spark.range(1).select(F.lit(99).cast("long")))
    return U.current_answers(models, cites, derived(spark, d, "d_memories"), gone)


@query("""
SELECT user_id, day, epoch_us(CASE WHEN urgent THEN w ELSE greatest(w, f0 + INTERVAL 30 MINUTE) END) AS due_us FROM (
  SELECT *, least(l + INTERVAL 5 MINUTE, f + INTERVAL 30 MINUTE) AS w FROM (
    SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS f, max(ts) AS l, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS f0, bool_or(event_type = 'error') AS urgent FROM events GROUP BY 1, 2) a) b
""")
def refresh_due(spark, d):
    views(spark, d)
    rows = spark.table("events").select("user_id", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("e"))
    rows = rows.groupBy("user_id", "day").agg(F.min("ts").alias("f"), F.max("ts").alias("l"), F.bool_or("e").alias("urgent"))
    due = U.refresh_due(F.col("f"), F.col("l"), F.col("day").cast("timestamp"), F.col("urgent"))
    return rows.select("user_id", "day", F.unix_micros(due).alias("due_us"))


@query(rf"""
SELECT memory_id FROM d_memories WHERE len(list_filter({_WORDS.format(x='content')}, lambda w: starts_with(w, 'th'))) > 0 AND len(list_filter({_WORDS.format(x='content')}, lambda w: starts_with(w, 'a'))) > 0
""")
def prefix_search(spark, d):
    return U.prefix_search(derived(spark, d, "d_memories"), "content", "th A").select("memory_id")


@query("""
SELECT memory_id, row_number() OVER (ORDER BY observed_at DESC, memory_id) AS number FROM d_memories WHERE kind = 'event' AND NOT hidden QUALIFY number > 20 AND number <= 40
""")
def list_memories(spark, d):
    """The second page of twenty live events, newest first."""
    rows = derived(spark, d, "d_memories").where("kind = 'event' AND NOT hidden")
    return U.list_memories(rows, [F.desc("observed_at"), F.col("memory_id")], 20, page=1).select("memory_id", "number")


def _scratch(spark, name):
    _checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/{name}-{uuid.uuid4().hex}"


@query("""
SELECT memory_id, row_number() OVER (ORDER BY observed_at DESC, memory_id DESC) AS number FROM d_memories WHERE observed_at >= TIMESTAMP '2024-01-03 00:00:00' AND owner_significance IS DISTINCT FROM 'kept' QUALIFY number > 140 AND number <= 160
""")
def list_pages(spark, d):
    """The eighth page of twenty in a kept order: half of it by its number, half by the row before."""
    rows = B.listed(derived(spark, d, "d_memories").withColumn("created_at", F.col("observed_at")), B.Listing(kept=False, observed_from=datetime(2024, 1, 3)))
    folder = B.write_listing(rows.select("memory_id", "created_at"), "created", _scratch(spark, "listing"))
    first = B.page_at(spark, folder, 14, 10).select("memory_id", "number", "place").collect()
    last = max(first, key=lambda r: r["number"], default=None)
    page = B.page_at(spark, folder, 14, 10).select("memory_id", F.col("number").cast("long").alias("number"))
    if last is None:
        return page
    more = B.page_after(spark, folder, 10, last["place"])
    return page.unionByName(more.select("memory_id", (F.row_number().over(W.orderBy("place")) + last["number"]).cast("long").alias("number")))


@query()
def list_fading(spark, d):
    """Live memories that fade in more than thirty bank days: the first fifty by the latest to fade, with the counts of every status."""
    _checkpoints(spark)
    m = derived(spark, d, "d_memories")
    faded = Z.fading(m, derived(spark, d, "d_accesses"), derived(spark, d, "d_messages"), S.chain_heads(m), NOW).select("memory_id", "fades_in_days")
    status = H.memory_status(F.col("retracted"), F.col("superseded_by").isNotNull(), S.has_ended(m, F.lit(NOW).cast("timestamp")), F.col("hidden"))
    rows = m.select("memory_id", status.alias("status")).join(faded, "memory_id").join(_strength(spark, d).select("memory_id", "value"), "memory_id")
    rows = B.listed(rows, B.Listing(fading="over_month")).checkpoint()
    page = B.page_at(spark, B.write_listing(rows.where("status = 'live'"), "fade_latest", _scratch(spark, "listing")), 0, 50)
    return page.select("memory_id", F.col("number").cast("long").alias("number"), "fades_in_days", "status").join(F.broadcast(B.listed_totals(rows, "live")), "status")


@query("""
WITH s AS (SELECT user_id % 8 AS bank_id, user_id AS memory_id, CAST(date_trunc('week', ts) AS DATE) AS week, value / 100 - 1 AS value, row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts DESC, value DESC) AS n FROM events)
SELECT bank_id, week, CASE WHEN value > 0.3 THEN 'strong' WHEN value >= -0.7 THEN 'fading' ELSE 'faded' END AS band, count(*) AS memories FROM s WHERE n = 1 GROUP BY 1, 2, 3
""")
def week_bands(spark, d):
    views(spark, d)
    rows = spark.table("events").select((F.col("user_id") % 8).alias("bank_id"), F.col("user_id").alias("memory_id"), F.col("ts").alias("taken_at"), (F.col("value") / 100 - 1).alias("value"))
    return U.week_bands(rows)


@query("""
WITH n AS (SELECT access_id % 2 AS run, CAST(accessed_at AS DATE) || '.' || kind AS path, count(*) AS value FROM d_accesses GROUP BY 1, 2)
SELECT coalesce(a.path, b.path) AS path, a.value AS before, b.value AS after FROM (SELECT * FROM n WHERE run = 0) a FULL JOIN (SELECT * FROM n WHERE run = 1) b ON a.path = b.path
WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 1e-6 * greatest(1.0, abs(a.value), abs(b.value))
""")
def report_diff(spark, d):
    path = F.concat_ws(".", F.to_date("accessed_at").cast("string"), "kind").alias("path")
    runs = derived(spark, d, "d_accesses").groupBy((F.col("access_id") % 2).alias("run"), path).agg(F.count("*").alias("value"))
    return U.report_diff(runs.where("run = 0"), runs.where("run = 1"))


@query(_BM25 + """SELECT query_id AS sample, CAST(sum(CASE WHEN n <= 8 THEN quality ELSE 0 END) AS BIGINT) AS found, CAST(sum(quality) AS BIGINT) AS relevant
FROM (SELECT b.query_id, l.quality, row_number() OVER (PARTITION BY b.query_id ORDER BY b.rank) AS n FROM b JOIN labels l ON l.doc_id = b.memory_id) x GROUP BY 1""")
def top_recall(spark, d):
    arm = R.bm25_top_k(derived(spark, d, "d_memories"), _queries(spark))
    labels = spark.table("labels").select(F.col("doc_id").alias("memory_id"), F.col("quality").cast("long").alias("relevant"))
    return U.top_recall(arm.join(labels, "memory_id").select(F.col("query_id").alias("sample"), "memory_id", (-F.col("rank")).alias("score"), "relevant"))


@query("""
WITH c AS (SELECT memory_id // 10 AS block, kind FROM d_memories),
k AS (SELECT block // 2 AS chunk, kind, sum(CASE WHEN block % 2 = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN block % 2 = 1 THEN 1 ELSE 0 END) AS b FROM c GROUP BY 1, 2)
SELECT chunk, sum(a) = sum(b) AS same_count, bool_and(a = b) AS same_kinds FROM k GROUP BY 1
""")
def claims_agreement(spark, d):
    rows = derived(spark, d, "d_memories").select(F.floor(F.col("memory_id") / 10).alias("block"), "kind").withColumn("chunk", F.floor(F.col("block") / 2))
    return U.claims_agreement(rows.where("block % 2 = 0"), rows.where("block % 2 = 1"))


@query("""
SELECT bank_id, u AS used, n AS not_used, t - u - n AS unjudged, u / nullif(u + n, 0) AS rate FROM (SELECT memory_id % 8 AS bank_id, CAST(sum(CASE WHEN kind = 'used' THEN 1 ELSE 0 END) AS BIGINT) AS u,
  CAST(sum(CASE WHEN kind = 'created' THEN 1 ELSE 0 END) AS BIGINT) AS n, count(*) AS t FROM d_accesses GROUP BY 1) x
""")
def injection_usage(spark, d):
    rows = derived(spark, d, "d_accesses").withColumn("bank_id", F.col("memory_id") % 8)
    return U.injection_usage(rows, ["bank_id"], F.col("kind") == "used", F.col("kind") == "created")


@query("""
SELECT memory_id % 8 AS bank_id, CAST(accessed_at AS DATE) - CAST(g AS INTEGER) AS day, kind, count(*) AS accesses FROM d_accesses, range(0, 7) AS r(g) GROUP BY 1, 2, 3
""")
def stream_week_counts(spark, d):
    """The batch twin of the sliding week: each access counts in the seven windows that hold it."""
    rows = derived(spark, d, "d_accesses").select((F.col("memory_id") % 8).alias("bank_id"), "kind", F.col("accessed_at").cast("timestamp").alias("accessed_at"))
    return stream_counts(rows, "7 days", "1 day").select("bank_id", F.to_date("start").alias("day"), "kind", "accesses")


@query("""
WITH t AS (SELECT bank_id, epoch_us(message_at) AS s FROM d_messages), g AS (SELECT *, CASE WHEN s < lag(s) OVER (PARTITION BY bank_id ORDER BY s) + 86400000000 THEN 0 ELSE 1 END AS new FROM t),
i AS (SELECT *, sum(new) OVER (PARTITION BY bank_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
SELECT bank_id, min(s) AS start_us, max(s) + 86400000000 AS end_us, count(*) AS turns FROM i GROUP BY bank_id, island
""")
def stream_activity(spark, d):
    rows = derived(spark, d, "d_messages").select("bank_id", F.col("message_at").cast("timestamp").alias("message_at"))
    return stream_bank_activity(rows).select("bank_id", S.micros("start").alias("start_us"), S.micros("end").alias("end_us"), "turns")
