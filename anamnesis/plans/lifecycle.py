"""Registered queries of ingest, agenda, reconciliation, lifecycle, entities, reports and session streams, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.operators import agenda as A
from anamnesis.operators import entities as E
from anamnesis.operators import fading as Z
from anamnesis.operators import history as H
from anamnesis.operators import ingest as I
from anamnesis.operators import lifecycle as L
from anamnesis.operators import reconcile as C
from anamnesis.operators import reports as P
from anamnesis.operators import retrieval as V
from anamnesis.operators import strength as S
from anamnesis.plans.registry import NOW, _checkpoints, _strength, query
from anamnesis.plans.retrieval import HEADS, _vectors, recursive
from anamnesis.plans.upkeep import _length_blob
from anamnesis.sources.fixtures import derived, views
from anamnesis.streaming import sessions as T

TS = f"TIMESTAMP '{NOW}'"
_SURVIVORS = """v AS (SELECT entity_id, entity_id AS survivor_id, merged_into AS nxt FROM d_entities
UNION ALL SELECT v.entity_id, e.entity_id, e.merged_into FROM v JOIN d_entities e ON v.nxt = e.entity_id), s AS (SELECT entity_id, survivor_id FROM v WHERE nxt IS NULL)"""


def _m(spark, d):
    return derived(spark, d, "d_memories")


def _survivors(spark, d):
    _checkpoints(spark)
    return S.survivors(derived(spark, d, "d_entities"), "entity_id", "merged_into", "survivor_id")


def _heads(spark, d):
    _checkpoints(spark)
    return S.chain_heads(_m(spark, d))


def _on_sources(spark, d):
    """Memories with the source that they rest on: that of the next lower multiple of three."""
    return _m(spark, d).withColumn("source_id", F.col("memory_id") - F.col("memory_id") % 3)


# -- ingest ----------------------------------------------------------------------

_PARTS = """CASE turn % 3 WHEN 0 THEN chr(0) || 'json:[{"type":"text","text":"a' || session_id || '"},{"type":"image"},{"type":"text","text":"b' || turn || '"}]' WHEN 1 THEN '[Ann] ' || text ELSE text END"""


@query(f"""
SELECT session_id, turn, CASE turn % 3 WHEN 0 THEN 'a' || session_id || chr(10) || 'b' || turn WHEN 1 THEN '[Ann] ' || text ELSE text END AS said, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS images,
  CASE WHEN turn % 3 = 1 THEN 'Ann' WHEN turn % 3 = 2 THEN nullif(regexp_extract(text, '^\\[([^\\]\\n]+)\\] ', 1), '') END AS speaker FROM d_messages
""")
def plain_text(spark, d):
    rows = derived(spark, d, "d_messages").withColumn("content", F.expr(_PARTS))
    said, images = I.plain_text(F.col("content"))
    return rows.select("session_id", "turn", said.alias("said"), images.alias("images"), I.speaker_prefix(F.col("content")).alias("speaker"))


_CUT = r"CASE WHEN length({x}) <= 300 THEN {x} WHEN regexp_matches({x}[1:300], '\s') THEN regexp_replace({x}[1:300], '\s+\S*$', '') ELSE {x}[1:300] END"


@query(rf"""
WITH u AS (SELECT session_id, turn, text, lag(text) OVER (PARTITION BY session_id ORDER BY turn) AS p FROM d_messages)
SELECT session_id, turn, array_to_string(list_filter([text, {_CUT.format(x='p')}], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS query FROM u
""")
def conversation_query(spark, d):
    from pyspark.sql import Window as W

    rows = derived(spark, d, "d_messages").withColumn("p", F.lag("text").over(W.partitionBy("session_id").orderBy("turn")))
    return rows.select("session_id", "turn", I.conversation_query(F.col("text"), F.col("p"), F.lit(None).cast("string")).alias("query"))


@query("""SELECT session_id, turn, sha256(concat_ws(chr(10) || chr(10), text, nullif(role, ''))) AS chunk FROM d_messages""")
def turn_chunks(spark, d):
    return derived(spark, d, "d_messages").select("session_id", "turn", F.sha2(I.turn_chunk(F.col("text"), F.col("role")), 256).alias("chunk"))


@query("""
SELECT session_id, CAST(turn // 4 AS BIGINT) AS turn_no, bool_or(role = 'user' AND turn % 5 <> 0) AS human, bool_or(role = 'assistant' AND turn % 6 = 1) AS forget_requested, NOT bool_or(role = 'user' AND turn % 5 <> 0) AS prefetch_only FROM d_messages GROUP BY 1, 2
""")
def turn_flags(spark, d):
    rows = derived(spark, d, "d_messages").select(
        "session_id", F.floor(F.col("turn") / 4).cast("long").alias("turn_no"), "role", F.when(F.col("turn") % 5 == 0, "note").when(F.col("turn") % 5 == 1, "steer").alias("display_kind"),
        F.when(F.col("turn") % 6 == 1, '[{"function":{"name":"memory_forget"}}]').when(F.col("turn") % 6 == 2, '[{"function":{"name":"other"}}]').alias("tool_calls"),
    )
    return I.turn_flags(rows)


@query("""
SELECT * FROM (SELECT 'sessions' AS counter, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'nested_sessions', count(DISTINCT conv_id) FROM conversations WHERE conv_id % 5 = 0
UNION ALL SELECT 'other_sessions', count(DISTINCT conv_id) FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 7 = 0 UNION ALL SELECT 'inactive_rows', count(*) FROM conversations WHERE turn % 9 = 0
UNION ALL SELECT 'user_rows', count(*) FROM conversations WHERE turn % 9 <> 0 AND role = 'user' UNION ALL SELECT 'assistant_rows', count(*) FROM conversations WHERE turn % 9 <> 0 AND role = 'assistant'
UNION ALL SELECT 'tool_rows', count(*) FROM conversations WHERE turn % 9 <> 0 AND role = 'tool' UNION ALL SELECT 'system_rows', count(*) FROM conversations WHERE turn % 9 <> 0 AND role = 'system'
UNION ALL SELECT 'other_rows', count(*) FROM conversations WHERE turn % 9 <> 0 AND role NOT IN ('user', 'assistant', 'tool', 'system')) x
""")
def import_counts(spark, d):
    views(spark, d)
    rows = spark.table("conversations")
    sessions = rows.select("conv_id").distinct().select(F.when(F.col("conv_id") % 5 == 0, "p").alias("parent_session_id"), F.when(F.col("conv_id") % 7 == 0, "tool").otherwise("chat").alias("source"))
    return I.import_counts(sessions, rows.select("role", F.when(F.col("turn") % 9 == 0, 0).otherwise(1).alias("active"), F.lit(0).alias("compacted")))


@recursive
@query(f"""
WITH {_SURVIVORS}, t AS (SELECT source_id, bank_id, author FROM d_sources WHERE kind = 'turn'), k AS (SELECT DISTINCT author FROM d_sources WHERE author < 'n')
SELECT source_id, CASE WHEN author IS NULL THEN bank_id WHEN k.author IS NOT NULL THEN s.survivor_id END AS speaker_entity FROM t LEFT JOIN k USING (author) LEFT JOIN s ON s.entity_id = 41
""")
def resolve_speakers(spark, d):
    """Authors below n are known as entity 41, which was merged."""
    rows = derived(spark, d, "d_sources")
    turns = rows.where("kind = 'turn'").select("source_id", "bank_id", "author", F.col("author").alias("author_name"))
    ids = rows.where("author < 'n'").select("bank_id", F.col("author").alias("platform_id")).distinct().withColumn("entity_id", F.lit(41).cast("long"))
    users = rows.select("bank_id").distinct().select("bank_id", F.col("bank_id").alias("entity_id"))
    return I.resolve_speakers(turns, ids, _survivors(spark, d), users)[0].select("source_id", "speaker_entity")


@query("""
WITH t AS (SELECT session_id, source_id, text, removed AS masked FROM d_sources WHERE kind = 'turn'),
e AS (SELECT a.source_id, b.source_id AS earlier_id, b.text, row_number() OVER (PARTITION BY a.source_id ORDER BY b.source_id DESC) AS back
  FROM t a JOIN t b ON a.session_id = b.session_id AND b.source_id < a.source_id AND NOT b.masked AND b.text <> ''),
c AS (SELECT *, 6000 - coalesce(sum(length(text)) OVER (PARTITION BY source_id ORDER BY back ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM e WHERE back <= 3)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY back DESC) AS position, earlier_id, CAST(least(length(text), room) AS BIGINT) AS chars, sha256(right(text, CAST(least(length(text), room) AS BIGINT))) AS said FROM c WHERE room > 0
""")
def earlier_turns(spark, d):
    rows = derived(spark, d, "d_sources").where("kind = 'turn'").select("session_id", "source_id", "text", F.col("removed").alias("masked"))
    return I.earlier_turns(rows).select("source_id", "position", "earlier_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("said"))


@query("""
WITH t AS (SELECT bank_id, session_id, source_id, lag(source_id) OVER (PARTITION BY bank_id, session_id ORDER BY source_id) AS prior FROM d_sources WHERE kind = 'turn')
SELECT b.source_id * 10 AS request_id, a.source_id FROM t a JOIN d_sources b ON b.kind = 'turn' AND b.source_id % 2 = 0 AND a.prior = b.source_id AND a.session_id = b.session_id AND a.bank_id = b.bank_id
""")
def link_forgets(spark, d):
    """A request after every even turn."""
    turns = derived(spark, d, "d_sources").where("kind = 'turn'").select("bank_id", "session_id", "source_id")
    asked = turns.where("source_id % 2 = 0").select((F.col("source_id") * 10).alias("request_id"), "bank_id", "session_id", F.col("source_id").alias("after"))
    return I.link_forgets(asked, turns)


@query("""
SELECT source_id AS version_id, CAST(k AS INTEGER) AS position, sha256(CASE WHEN k = 0 OR (source_id % 5 = 0 AND k > 1) THEN '' ELSE text[greatest(0, k * 1000 - 400) + 1 : k * 1000] END) AS said
FROM d_sources, range(0, 100) AS r(k) WHERE kind = 'document' AND k * 1000 < length(text)
""")
def text_before(spark, d):
    """Chunks of 1,000 characters; the second of every fifth document is masked."""
    versions = derived(spark, d, "d_sources").where("kind = 'document' AND text <> ''").select(F.col("source_id").alias("version_id"), "text")
    chunks = versions.select("version_id", F.explode(F.sequence(F.lit(0), F.least(F.lit(99), F.floor((F.length("text") - 1) / 1000).cast("int")))).alias("position"), F.length("text").alias("n"))
    chunks = chunks.select("version_id", "position", (F.col("position") * 1000).alias("start"), F.least(F.col("n"), (F.col("position") + 1) * 1000).alias("end"), ((F.col("version_id") % 5 == 0) & (F.col("position") == 1)).alias("masked"))
    return I.text_before(chunks, versions).select("version_id", "position", F.sha2("before", 256).alias("said"))


def _claims(spark, d):
    rows = _m(spark, d).withColumn("text", F.col("content"))
    quote = F.when(F.col("memory_id") % 9 == 0, "no such words here, ever").otherwise(F.substring("text", 1, 20))
    return rows.select(
        "memory_id", F.when(F.col("memory_id") % 13 == 0, " ").otherwise(F.col("content")).alias("content"), quote.alias("quote"), "text", "kind", (F.col("memory_id") % 2 == 0).alias("by_assistant"), (F.col("memory_id") % 4 == 0).alias("remember_this"),
        (F.col("memory_id") % 8 == 0).alias("own_message"), F.when(F.col("memory_id") % 3 == 0, F.col("valid_from").cast("timestamp")).alias("valid_from"), F.col("valid_until").cast("timestamp").alias("valid_until"), F.col("due_at").cast("timestamp").alias("due_at"),
        F.col("observed_at").cast("timestamp").alias("observed_at"), F.lit("UTC").alias("timezone"), "low_confidence",
    )


@query("""
WITH c AS (SELECT *, CASE WHEN memory_id % 9 = 0 THEN 'no such words here, ever' ELSE content[1:20] END AS quote, CASE WHEN memory_id % 13 = 0 THEN ' ' ELSE content END AS said, CASE WHEN memory_id % 3 = 0 THEN valid_from END AS f FROM d_memories)
SELECT memory_id, CASE WHEN trim(said) = '' THEN 'empty' WHEN quote = '' OR NOT contains(content, quote) THEN 'quote_not_found' WHEN kind = 'task' AND memory_id % 2 = 0 AND due_at IS NULL THEN 'undated_assistant_task' END AS reason,
  CAST(strpos(content, quote) - 1 AS BIGINT) AS quote_start, epoch_us(CASE WHEN kind = 'event' AND f IS NULL THEN date_trunc('day', observed_at) WHEN kind <> 'task' THEN f END) AS from_us, epoch_us(CASE WHEN kind = 'task' THEN due_at END) AS due_us,
  low_confidence OR (kind = 'event' AND f IS NULL) AS low, memory_id % 8 = 0 AS kept FROM c
""")
def check_claims(spark, d):
    rows = I.check_claims(_claims(spark, d))
    return rows.select("memory_id", "reason", F.col("quote_start").cast("long").alias("quote_start"), S.micros("valid_from").alias("from_us"), S.micros("due_at").alias("due_us"), F.col("low_confidence").alias("low"), "kept")


# -- agenda ----------------------------------------------------------------------

_RULE = """CASE doc_id % 6 WHEN 0 THEN 'FREQ=DAILY;INTERVAL=' || (doc_id % 12 + 1) WHEN 1 THEN 'RRULE:FREQ=WEEKLY' WHEN 2 THEN 'FREQ=WEEKLY;INTERVAL=2' WHEN 3 THEN 'FREQ=MONTHLY' WHEN 4 THEN 'every day' ELSE 'FREQ=YEARLY;INTERVAL=x' END"""


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN doc_id % 12 + 1 <= 7 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS short FROM documents
""")
def rrule_class(spark, d):
    views(spark, d)
    return spark.table("documents").withColumn("rule", F.expr(_RULE)).select("doc_id", A.short_period(F.col("rule")).alias("short"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'FREQ=YEARLY;BYMONTH=11;BYMONTHDAY=' || (doc_id % 31 + 1) WHEN doc_id % 3 = 1 THEN 'FREQ=YEARLY;BYMONTH=5;BYMONTHDAY=' || (doc_id % 31 + 1) END AS rule FROM documents
""")
def annual_rule(spark, d):
    views(spark, d)
    said = F.expr("CASE doc_id % 3 WHEN 0 THEN 'Every year on November ' || (doc_id % 31 + 1) WHEN 1 THEN 'the ' || (doc_id % 31 + 1) || 'th of May, each year' ELSE 'on May 3' END")
    return spark.table("documents").select("doc_id", A.annual_rule(said).alias("rule"))


@query("""
SELECT memory_id, epoch_us(CASE WHEN observed_at >= TIMESTAMP '2024-02-15 00:00:00' THEN observed_at ELSE observed_at + CAST(ceil((epoch_us(TIMESTAMP '2024-02-15 00:00:00') - epoch_us(observed_at)) / 86400000000.0 / 3) * 3 AS INTEGER) * INTERVAL 1 DAY END) AS next_us FROM d_memories
""")
def next_occurrence(spark, d):
    """Every third day from when it was said."""
    start = F.col("observed_at").cast("timestamp")
    return _m(spark, d).select("memory_id", S.micros(A.next_occurrence(F.lit("FREQ=DAILY;INTERVAL=3"), start, F.lit(NOW).cast("timestamp"), F.lit("UTC"))).alias("next_us"))


def _valued(spark, d):
    _checkpoints(spark)
    return V.dated(_m(spark, d), NOW).join(_strength(spark, d).select("memory_id", "value"), "memory_id")


@query()
def agenda(spark, d):
    rows = _valued(spark, d).withColumns({"recurrence_rrule": F.when(F.col("memory_id") % 20 == 4, "FREQ=MONTHLY").when(F.col("memory_id") % 20 == 9, "FREQ=DAILY"), "recurrence_start": F.col("observed_at"), "timezone": F.lit("UTC")})
    said = derived(spark, d, "d_accesses").where(F.col("kind").isin("mentioned_again", "confirmed") & (F.col("accessed_at") <= F.lit(NOW).cast("timestamp"))).groupBy("memory_id").agg(F.max(F.col("accessed_at").cast("timestamp")).alias("said"))
    return A.agenda(rows, said, NOW)


@query(f"""
SELECT bank_id, memory_id, rank FROM (SELECT bank_id, memory_id, row_number() OVER (PARTITION BY bank_id ORDER BY valid_from, memory_id) AS rank FROM d_memories WHERE kind = 'event' AND NOT retracted AND NOT hidden AND superseded_by IS NULL
  AND observed_at < valid_from AND TIMESTAMP '2024-01-25 00:00:00' < valid_from + INTERVAL 1 DAY AND (valid_until IS NULL OR valid_until + INTERVAL 1 DAY > TIMESTAMP '2024-01-25 00:00:00')) x WHERE rank <= 5
""")
def upcoming_events(spark, d):
    return A.upcoming_events(_m(spark, d), "2024-01-25 00:00:00")


# -- reconciliation --------------------------------------------------------------


def _chunked(spark, d):
    """Every fiftieth memory as a claim that says the next one's content again, two claims to a chunk."""
    m = _m(spark, d).join(_vectors(spark, d).select("memory_id", "embedding"), "memory_id").where("memory_id % 50 = 0")
    return m.select(F.col("memory_id").alias("claim_id"), "bank_id", "content", "embedding", (F.col("memory_id") % 20 == 0).alias("flagged"), "observed_at", F.floor(F.col("memory_id") / 100).cast("long").alias("chunk_id"), F.col("memory_id").alias("ordinal"))


def _neighbours(spark, d):
    return C.claim_neighbours(_chunked(spark, d), _m(spark, d), _vectors(spark, d), _heads(spark, d).checkpoint(), 0.2)


@query()
def claim_neighbours(spark, d):
    return _neighbours(spark, d)


@query("""
WITH v AS (SELECT vec_id AS memory_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT m.memory_id AS claim_id, m.bank_id, m.observed_at, v.e FROM d_memories m JOIN v USING (memory_id)),
h AS (SELECT DISTINCT c.claim_id, c.observed_at AS said, c.e AS asked, l.memory_id FROM c JOIN d_links x ON x.memory_id = c.claim_id JOIN d_links l ON l.entity_id = x.entity_id AND l.bank_id = c.bank_id),
r AS (SELECT h.claim_id, m.memory_id, row_number() OVER (PARTITION BY h.claim_id ORDER BY round(list_cosine_similarity(h.asked, v.e), 9) DESC NULLS LAST, m.observed_at DESC, m.memory_id) AS rank
  FROM h JOIN d_memories m ON m.memory_id = h.memory_id AND m.kind IN ('task', 'state') AND NOT m.retracted AND NOT m.hidden AND m.superseded_by IS NULL AND (m.valid_until IS NULL OR m.valid_until + INTERVAL 1 DAY > h.said) LEFT JOIN v ON v.memory_id = m.memory_id)
SELECT claim_id, memory_id, rank FROM r WHERE rank <= 10
""")
def linked_open(spark, d):
    links = derived(spark, d, "d_links")
    v = _vectors(spark, d)
    claims = _m(spark, d).join(v.select("memory_id", "embedding"), "memory_id").select(F.col("memory_id").alias("claim_id"), "bank_id", "observed_at", "embedding", F.lit(True).alias("flagged"))
    named = links.select(F.col("memory_id").alias("claim_id"), "entity_id").distinct()
    return C.linked_open(claims, named, links, _m(spark, d), v)


def _fused(spark, d):
    """Neighbours by arithmetic: claim c has the memories c + 1 .. c + 12 by words and every second of them by links."""
    claims = _m(spark, d).select(F.col("memory_id").alias("claim_id"), F.floor(F.col("memory_id") / 100).cast("long").alias("chunk_id"), F.col("memory_id").alias("ordinal"), (F.col("memory_id") % 40 == 0).alias("flagged"))
    steps = claims.select("claim_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("rank"))
    fused = steps.select("claim_id", (F.col("claim_id") + F.col("rank")).alias("memory_id"), "rank", (1 - F.col("rank") / 20 - (F.col("claim_id") % 7) / 10).alias("similarity"))
    return claims, fused, fused.where("memory_id % 2 = 0").select("claim_id", "memory_id", (F.col("rank") / 2).cast("int").alias("rank"))


_FUSED = """WITH c AS (SELECT memory_id AS claim_id, memory_id // 100 AS chunk_id, memory_id % 40 = 0 AS flagged FROM d_memories),
f AS (SELECT claim_id, claim_id + r AS memory_id, r AS rank, 1 - r / 20 - (claim_id % 7) / 10 AS similarity FROM c, range(1, 13) AS x(r)), o AS (SELECT claim_id, memory_id, rank // 2 AS rank FROM f WHERE memory_id % 2 = 0)"""


@query(_FUSED + """, b AS (SELECT chunk_id, memory_id, min(rank * 1000000000 + list * 100000000 + claim_id) AS k FROM (SELECT *, 0 AS list FROM (SELECT claim_id, memory_id, rank FROM f) UNION ALL SELECT *, 1 FROM o) u JOIN c USING (claim_id) GROUP BY 1, 2)
SELECT chunk_id, memory_id, position FROM (SELECT chunk_id, memory_id, row_number() OVER (PARTITION BY chunk_id ORDER BY k, memory_id) AS position FROM b) x WHERE position <= 40
""")
def neighbour_lists(spark, d):
    claims, fused, open_ = _fused(spark, d)
    return C.neighbour_lists(fused, open_, claims)


@query(_FUSED + """ SELECT c.chunk_id, bool_or(c.flagged OR n.s >= 0.7) AS review FROM c LEFT JOIN (SELECT claim_id, max(similarity) AS s FROM f WHERE claim_id % 100 <> 80 GROUP BY 1) n USING (claim_id) GROUP BY 1""")
def needs_review(spark, d):
    claims, fused, _ = _fused(spark, d)
    return C.needs_review(claims, fused.where("claim_id % 100 <> 80"), 0.7)


@query("""SELECT memory_id, epoch_us(coalesce(valid_from, date_trunc('day', observed_at))) AS end_us, valid_from IS NULL AS low FROM d_memories""")
def end_at(spark, d):
    end, low = C.end_at(F.col("valid_from").cast("timestamp"), F.col("observed_at").cast("timestamp"), F.lit("UTC"))
    return _m(spark, d).select("memory_id", S.micros(end).alias("end_us"), low.alias("low"))


def _plan(spark, d):
    """Every tenth memory is a claim; the five before it in its block are its neighbours, labelled in turn."""
    dates = {c: F.col(c).cast("timestamp").alias(c) for c in ("valid_from", "valid_until", "due_at")}
    m = _m(spark, d)
    stored = m.select("memory_id", "kind", "significance", "owner_significance", (F.col("ended_by").isNotNull()).alias("ended"), "observed_at", F.col("observed_at").alias("ingested_at"), F.col("memory_id").alias("source_id"), (F.col("memory_id") % 15).cast("string").alias("document_id"), *dates.values())
    claims = m.where("memory_id % 10 = 9").select(
        F.floor(F.col("memory_id") / 20).cast("long").alias("chunk_id"), (F.col("memory_id") % 20).cast("int").alias("ordinal"), "memory_id", "kind", "significance", (F.col("memory_id") % 3 == 0).alias("kept"), "observed_at",
        F.col("observed_at").alias("ingested_at"), F.col("memory_id").alias("source_id"), (F.col("memory_id") % 15).cast("string").alias("document_id"), *dates.values(), F.lit(0).alias("start"), F.length("content").alias("end"),
    )
    names = F.array(*[F.lit(x) for x in (*C.REPEATS, *C.CHANGES)])
    steps = claims.select("chunk_id", "ordinal", "memory_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    labels = steps.select("chunk_id", "ordinal", (F.col("memory_id") - F.col("k")).alias("memory_id"), F.element_at(names, (F.pmod(F.xxhash64("memory_id", "k"), F.lit(6)) + 1).cast("int")).alias("label"))
    return claims, C.plan_reconcile(claims.drop("memory_id", "start", "end"), labels, stored)


@query()
def plan_reconcile(spark, d):
    return _plan(spark, d)[1]


@query()
def new_memories(spark, d):
    claims, plan = _plan(spark, d)
    return C.new_memories(plan, claims.drop("memory_id"))[0].select("memory_id", "chunk_id", "ordinal", "ended_by", "kind")


@query()
def restatements(spark, d):
    claims, plan = _plan(spark, d)
    return C.restatements(plan, claims)


@query()
def review_rate(spark, d):
    claims, plan = _plan(spark, d)
    chunks = claims.groupBy("chunk_id").agg(F.bool_or("kept").alias("review"))
    return P.review_rate(chunks, plan)


def _edits(m):
    """Of every ten memories the second ends the first, the eighth replaces the seventh, by one of three labels."""
    pair = m.where("memory_id % 10 IN (0, 6)").select("memory_id", F.col("bank_id"))
    by = m.select(F.col("memory_id").alias("by_id"), F.col("observed_at").alias("by_observed_at"), F.col("valid_from").alias("by_valid_from"))
    action = F.when(F.col("memory_id") % 10 == 0, "ends").otherwise(F.element_at(F.array(F.lit("refines"), F.lit("denies"), F.lit("retracts")), (F.floor(F.col("memory_id") / 10) % 3 + 1).cast("int")))
    return pair.withColumn("by_id", F.col("memory_id") + 1).join(by, "by_id").select("memory_id", action.alias("action"), "by_id", "by_observed_at", "by_valid_from", F.lit("UTC").alias("timezone"))


@query("""
WITH e AS (SELECT m.memory_id, m.memory_id + 1 AS by_id, CASE WHEN m.memory_id % 10 = 0 THEN 'ends' ELSE ['refines', 'denies', 'retracts'][m.memory_id // 10 % 3 + 1] END AS action, b.observed_at AS said, b.valid_from AS starts
  FROM d_memories m JOIN d_memories b ON b.memory_id = m.memory_id + 1 WHERE m.memory_id % 10 IN (0, 6)),
x AS (SELECT m.*, e.action AS act, e.by_id, e.said, e.starts, CASE WHEN e.action = 'ends' THEN e.by_id ELSE m.ended_by END AS eb FROM d_memories m LEFT JOIN e USING (memory_id))
SELECT x.memory_id, CASE WHEN n.action = 'denies' THEN NULL ELSE coalesce(n.by_id, eb) END AS ended_by, epoch_us(CASE WHEN n.action = 'denies' THEN NULL WHEN act = 'ends' THEN CASE WHEN kind = 'task' THEN date_trunc('minute', x.said) ELSE coalesce(x.starts, date_trunc('day', x.said)) END ELSE valid_until END) AS until_us,
  CASE WHEN act IN ('refines', 'denies', 'retracts') THEN x.by_id ELSE superseded_by END AS superseded_by, retracted OR coalesce(act IN ('denies', 'retracts'), false) AS retracted, low_confidence OR coalesce(act = 'ends' AND kind <> 'task' AND x.starts IS NULL, false) AS low,
  hidden OR EXISTS (SELECT 1 FROM e p JOIN d_memories q ON q.memory_id = p.memory_id AND q.hidden WHERE p.by_id = x.memory_id AND p.action <> 'ends') AS hidden
FROM x LEFT JOIN e n ON n.memory_id = eb AND n.action <> 'ends'
""")
def apply_edits(spark, d):
    m = _m(spark, d)
    return C.apply_edits(m, _edits(m)).select("memory_id", "ended_by", S.micros("valid_until").alias("until_us"), "superseded_by", "retracted", F.col("low_confidence").alias("low"), "hidden")


@query("""
WITH v AS (SELECT vec_id AS memory_id, CAST(floor(vec_id / 10) AS BIGINT) % 8 AS bank_id, CAST(embedding AS DOUBLE[]) AS e, vec_id * 7919 % 1000 AS t FROM embeddings),
c AS (SELECT c.bank_id, c.memory_id, CASE WHEN EXISTS (SELECT 1 FROM v p WHERE p.bank_id = c.bank_id AND p.t < c.t AND round(list_cosine_similarity(p.e, c.e), 9) >= 0.3) THEN 1 ELSE 0 END AS hit FROM v c WHERE c.memory_id % 50 = 0),
n AS (SELECT bank_id, count(*) AS purged FROM v GROUP BY 1)
SELECT n.bank_id, n.purged, CAST(coalesce(sum(hit), 0) AS BIGINT) AS re_mentioned, coalesce(sum(hit), 0) / n.purged AS rate FROM n LEFT JOIN c ON c.bank_id = n.bank_id GROUP BY n.bank_id, n.purged
""")
def re_mentioned_rate(spark, d):
    """Every fiftieth vector as a memory made anew, against all as purged ones."""
    v = _vectors(spark, d).withColumn("t", F.col("memory_id") * 7919 % 1000)
    return C.re_mentioned_rate(v.where("memory_id % 50 = 0").withColumnRenamed("t", "created_at"), v.withColumnRenamed("t", "purged_at"), 0.3)


# -- lifecycle -------------------------------------------------------------------


@query(f"""
SELECT bank_id, CAST(sum(CASE WHEN swept THEN 1 ELSE 0 END) AS BIGINT) AS sources, CAST(sum(CASE WHEN failed AND NOT tombstoned AND old THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN old THEN 1 ELSE 0 END) AS BIGINT) AS recalls
FROM (SELECT *, old AND NOT tombstoned AND NOT queued AND source_id % 3 <> 0 AS swept FROM (SELECT *, ingested_at < {TS} - INTERVAL 90 DAY AS old FROM d_sources) a) b GROUP BY 1
""")
def sweep_sources(spark, d):
    rows = derived(spark, d, "d_sources")
    recalls = rows.select("bank_id", F.col("ingested_at").alias("recalled_at"))
    return L.sweep_sources(rows, _on_sources(spark, d).select("source_id"), recalls, NOW)[1]


@recursive
@query(f"""
WITH {HEADS}, h AS (SELECT memory_id, head_id FROM r WHERE nxt IS NULL), g AS (SELECT memory_id FROM h WHERE head_id % 4 = 1)
SELECT m.memory_id, CASE WHEN e.memory_id IS NULL THEN m.ended_by END AS ended_by, CASE WHEN s.memory_id IS NULL THEN m.superseded_by END AS superseded_by, (SELECT count(*) FROM g) AS gone
FROM d_memories m LEFT JOIN g e ON e.memory_id = m.ended_by LEFT JOIN g s ON s.memory_id = m.superseded_by WHERE m.memory_id NOT IN (SELECT memory_id FROM g)
""")
def purge(spark, d):
    """The chains whose head's id leaves one of four."""
    heads = _heads(spark, d)
    eligible = heads.where("head_id % 4 = 1").select(F.col("head_id").alias("memory_id")).distinct()
    out = L.purge(eligible, heads, {"memories": _m(spark, d)})
    gone = out["purged"].agg(F.count("*").alias("gone"))
    return out["memories"].select("memory_id", "ended_by", "superseded_by").crossJoin(gone)  # one row of totals


@recursive
@query(f"""
WITH {HEADS}, h AS (SELECT memory_id, head_id FROM r WHERE nxt IS NULL)
SELECT m.memory_id, m.hidden OR h.head_id IN (SELECT head_id FROM h WHERE memory_id % 25 = 3) AS hidden FROM d_memories m JOIN h USING (memory_id)
""")
def forget_hide(spark, d):
    asked = _m(spark, d).where("memory_id % 25 = 3").select("memory_id").union(spark.range(1).select(F.lit(-5).cast("long")))
    return L.forget_hide(asked, _m(spark, d), _heads(spark, d))[0].select("memory_id", "hidden")


@query("""
SELECT source_id, sha256(CASE WHEN length(text) > 30 THEN text[1:5] || regexp_replace(text[6:12], '[^\\n]', '█', 'g') || text[13:20] || regexp_replace(text[21:30], '[^\\n]', '█', 'g') || text[31:] ELSE text END) AS masked FROM d_sources WHERE kind = 'document'
""")
def redact_passages(spark, d):
    """Characters 5 to 12 and 20 to 30 of every document that has more, the first span given in two overlapping parts."""
    rows = derived(spark, d, "d_sources").where("kind = 'document'").select("source_id", "text")
    spans = rows.where(F.length("text") > 30).select("source_id", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 10), (8, 12), (20, 30))])).alias("s")).select("source_id", "s.start", "s.end")
    return L.redact_passages(rows, spans, "source_id").select("source_id", F.sha2("text", 256).alias("masked"))


@query("""
WITH v AS (SELECT source_id, document_id, text FROM d_sources WHERE kind = 'document'), p AS (SELECT DISTINCT document_id, text[11:50] AS passage FROM v WHERE source_id % 8 = 0 AND length(text) > 60),
n AS (SELECT v.source_id AS version_id, p.passage, unnest(range(0, greatest(0, length(v.text) - 39))) AS a, v.text FROM v JOIN p USING (document_id) WHERE contains(v.text, p.passage))
SELECT DISTINCT version_id, CAST(a AS INTEGER) AS start, CAST(a + 40 AS INTEGER) AS "end" FROM n WHERE text[a + 1 : a + 40] = passage
""")
def redact_versions(spark, d):
    rows = derived(spark, d, "d_sources").where("kind = 'document'")
    passages = rows.where("source_id % 8 = 0").where(F.length("text") > 60).select("document_id", F.substring("text", 11, 40).alias("passage"))
    return L.redact_versions(rows.select(F.col("source_id").alias("version_id"), "document_id", "text"), passages)


@query("""
SELECT entity_id FROM d_entities e WHERE seeded OR merged_into IS NOT NULL OR entity_id IN (SELECT entity_id FROM d_links WHERE memory_id % 10 < 3) OR entity_id IN (SELECT merged_into FROM d_entities) OR entity_id IN (9, 25)
""")
def delete_orphan_entities(spark, d):
    links = derived(spark, d, "d_links").where("memory_id % 10 < 3")
    one = lambda x: spark.range(1).select(F.lit(x).cast("long").alias("entity_id"))
    return L.delete_orphan_entities(derived(spark, d, "d_entities"), links, one(9), one(25)).select("entity_id")


@query("""
SELECT bank_id, CAST(sum(CASE WHEN gone AND kind = 'document' THEN 1 ELSE 0 END) AS BIGINT) AS documents, CAST(sum(CASE WHEN gone AND kind = 'turn' THEN 1 ELSE 0 END) AS BIGINT) AS turns
FROM (SELECT *, NOT removed AND CASE WHEN kind = 'document' THEN document_id = 'doc-8' ELSE source_id % 30 = 7 END AS gone FROM d_sources) x GROUP BY 1
""")
def remove_sources(spark, d):
    rows = derived(spark, d, "d_sources")
    asked = rows.where("document_id = 'doc-8'").select("bank_id", "document_id", F.lit(None).cast("long").alias("source_id")).unionByName(rows.where("kind = 'turn' AND source_id % 30 = 7").select("bank_id", F.lit(None).cast("string").alias("document_id"), "source_id"))
    return L.remove_sources(asked, rows, _on_sources(spark, d), _heads(spark, d))[2]


@query(f"""
WITH e AS (SELECT memory_id, CASE memory_id % 6 WHEN 0 THEN 'keep' WHEN 1 THEN 'unkeep' WHEN 2 THEN 'significance' WHEN 3 THEN 'retract' WHEN 4 THEN 'end' ELSE 'reopen' END AS action FROM d_memories WHERE superseded_by IS NULL AND NOT retracted AND NOT hidden)
SELECT m.memory_id, CASE e.action WHEN 'keep' THEN 'kept' WHEN 'unkeep' THEN NULL WHEN 'significance' THEN 'major' ELSE m.owner_significance END AS owner_significance, m.retracted OR coalesce(e.action = 'retract', false) AS retracted,
  epoch_us(CASE WHEN e.action = 'end' THEN TIMESTAMP '2024-02-14 23:59:00' WHEN e.action = 'reopen' OR b.action = 'retract' THEN NULL ELSE m.valid_until END) AS until_us, CASE WHEN e.action IN ('end', 'reopen') OR b.action = 'retract' THEN NULL ELSE m.ended_by END AS ended_by
FROM d_memories m LEFT JOIN e USING (memory_id) LEFT JOIN e b ON b.memory_id = m.ended_by
""")
def owner_edits(spark, d):
    m = _m(spark, d)
    names = F.array(*[F.lit(x) for x in ("keep", "unkeep", "significance", "retract", "end", "reopen")])
    edits = m.select(F.col("memory_id").alias("edit_id"), "memory_id", F.element_at(names, (F.col("memory_id") % 6 + 1).cast("int")).alias("action"), F.lit("major").alias("value"))
    return L.owner_edits(edits, m, NOW)[0].select("memory_id", "owner_significance", "retracted", S.micros("valid_until").alias("until_us"), "ended_by")


@query("""
WITH h AS (SELECT doc_id AS access_id, doc_id // 5 AS chunk_id, doc_id % 5 * 10 AS a, doc_id % 5 * 10 + 15 AS b FROM documents), n AS (SELECT doc_id AS memory_id, doc_id // 5 AS chunk_id, doc_id % 5 * 8 AS a, doc_id % 5 * 8 + 10 AS b FROM documents WHERE doc_id % 5 <> 4)
SELECT access_id, memory_id FROM (SELECT h.access_id, n.memory_id, row_number() OVER (PARTITION BY h.access_id ORDER BY least(h.b, n.b) - greatest(h.a, n.a) DESC, n.memory_id) AS k FROM h JOIN n ON h.chunk_id = n.chunk_id AND least(h.b, n.b) > greatest(h.a, n.a)) x WHERE k = 1
""")
def carry_accesses(spark, d):
    views(spark, d)
    rows = spark.table("documents").select("doc_id", F.floor(F.col("doc_id") / 5).alias("chunk_id"), (F.col("doc_id") % 5).alias("k"))
    held = rows.select(F.col("doc_id").alias("access_id"), "chunk_id", (F.col("k") * 10).alias("start"), (F.col("k") * 10 + 15).alias("end"))
    return L.carry_accesses(held, rows.where("k <> 4").select(F.col("doc_id").alias("memory_id"), "chunk_id", (F.col("k") * 8).alias("start"), (F.col("k") * 8 + 10).alias("end")))


@query("""SELECT bank_id, CASE WHEN removed THEN 'removed' WHEN tombstoned THEN 'swept' WHEN contains(text, '█') THEN 'masked' WHEN text = '' THEN 'empty' ELSE 'rerun' END AS outcome, count(*) AS sources FROM d_sources GROUP BY 1, 2""")
def rebuild_survey(spark, d):
    return L.rebuild_survey(derived(spark, d, "d_sources"))


# -- entities and models ---------------------------------------------------------


@recursive
@query(f"""
WITH {_SURVIVORS}, n AS (SELECT s.survivor_id AS entity_id, count(DISTINCT memory_id) AS links FROM d_links JOIN s USING (entity_id) GROUP BY 1), p AS (SELECT DISTINCT l.memory_id AS passage_id, s.survivor_id AS entity_id FROM d_links l JOIN s USING (entity_id))
SELECT passage_id, entity_id, links, rank FROM (SELECT p.passage_id, entity_id, links, row_number() OVER (PARTITION BY p.passage_id ORDER BY links DESC, entity_id) AS rank FROM p JOIN n USING (entity_id)) x WHERE rank <= 30
""")
def found_entities(spark, d):
    """Memories as passages that name what they link to."""
    links, s = derived(spark, d, "d_links"), _survivors(spark, d)
    named = links.join(s, "entity_id").select(F.col("memory_id").alias("passage_id"), F.col("survivor_id").alias("entity_id")).distinct()
    return E.found_entities(named, links, s)


@query("""
WITH a AS (SELECT entity_id, lower(name) AS k FROM d_entities WHERE merged_into IS NULL UNION SELECT entity_id, 'thing ' || entity_id % 5 FROM d_entities WHERE merged_into IS NULL),
q AS (SELECT doc_id AS reference_id, CASE WHEN doc_id % 3 = 0 THEN 'ENTITY ' || doc_id % 60 ELSE 'Thing ' || doc_id % 7 END AS reference FROM documents)
SELECT reference_id, CASE WHEN count(a.entity_id) = 1 THEN min(a.entity_id) END AS entity_id, CASE WHEN count(a.entity_id) = 0 THEN 'unknown' WHEN count(a.entity_id) > 1 THEN 'ambiguous' ELSE 'found' END AS outcome FROM q LEFT JOIN a ON a.k = lower(q.reference) GROUP BY 1
""")
def resolve_entity(spark, d):
    views(spark, d)
    entities = derived(spark, d, "d_entities").withColumn("bank_id", F.lit(0))
    aliases = entities.select("entity_id", "bank_id", F.concat(F.lit("Thing "), (F.col("entity_id") % 5).cast("string")).alias("alias"))
    asked = spark.table("documents").select(F.col("doc_id").alias("reference_id"), F.lit(0).alias("bank_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ENTITY "), (F.col("doc_id") % 60).cast("string"))).otherwise(F.concat(F.lit("Thing "), (F.col("doc_id") % 7).cast("string"))).alias("reference"))
    return E.resolve_entity(asked, entities, aliases)


_MERGED = """x AS (SELECT DISTINCT memory_id, bank_id, entity_id FROM d_links)"""


@query(f"""
WITH {_MERGED} SELECT memory_id, CAST(entity_id AS BIGINT) AS entity_id FROM x WHERE entity_id <> 3 UNION ALL SELECT a.memory_id, CAST(40 AS BIGINT) FROM x a WHERE entity_id = 3 AND NOT EXISTS (SELECT 1 FROM x b WHERE b.memory_id = a.memory_id AND b.entity_id = 40)
""")
def merge_entities(spark, d):
    """Entity 3 into 40."""
    entities, links = derived(spark, d, "d_entities"), derived(spark, d, "d_links").distinct()
    merges = spark.range(1).select(F.lit(3).cast("long").alias("entity_id"), F.lit(40).cast("long").alias("into_id"))
    return E.merge_entities(merges, entities, links, entities.select("entity_id", F.col("name").alias("alias")))[1].select("memory_id", "entity_id")


@query("""SELECT DISTINCT memory_id, entity_id FROM d_links l WHERE entity_id <> 3 OR EXISTS (SELECT 1 FROM d_links b WHERE b.memory_id = l.memory_id AND b.entity_id = 40) OR entity_id = 3""")
def unmerge_entities(spark, d):
    """Entity 3 into 40 and back again; what 40 had before stays with it, and so is lost to 3."""
    entities, links = derived(spark, d, "d_entities"), derived(spark, d, "d_links").distinct()
    merges = spark.range(1).select(F.lit(3).cast("long").alias("entity_id"), F.lit(40).cast("long").alias("into_id"))
    e, after, _, moved = E.merge_entities(merges, entities, links, entities.select("entity_id", F.col("name").alias("alias")))
    lost = links.where("entity_id = 3").join(links.where("entity_id = 40").select("memory_id"), "memory_id", "left_semi").select("memory_id", "entity_id")
    return E.unmerge_entities(moved, e, after)[1].select("memory_id", "entity_id").unionByName(lost)


@recursive
@query(f"""
WITH {_SURVIVORS}, k AS (SELECT l.memory_id, l.entity_id, s.survivor_id FROM d_links l JOIN s USING (entity_id))
SELECT DISTINCT memory_id, entity_id FROM k WHERE NOT (memory_id % 10 = 1 AND survivor_id = 44) UNION SELECT memory_id, 6 FROM d_memories WHERE memory_id % 10 = 2
""")
def edit_links(spark, d):
    """Links of 41, merged into 44, taken from every tenth memory; links of 5, merged into 6, given to others."""
    m = _m(spark, d)
    edits = m.where("memory_id % 10 = 1").select("memory_id", "bank_id", F.lit(41).cast("long").alias("entity_id"), F.lit("remove").alias("action")).unionByName(m.where("memory_id % 10 = 2").select("memory_id", "bank_id", F.lit(5).cast("long").alias("entity_id"), F.lit("add").alias("action")))
    return E.edit_links(edits, derived(spark, d, "d_links"), _survivors(spark, d)).select("memory_id", "entity_id")


@query("""SELECT DISTINCT memory_id, CASE WHEN entity_id = 41 AND memory_id % 2 = 0 THEN 9 ELSE entity_id END AS entity_id FROM d_links""")
def relink_alias(spark, d):
    """The form that even memories used for entity 41 now means entity 9."""
    links = derived(spark, d, "d_links").select("memory_id", "entity_id", F.when(F.col("memory_id") % 2 == 0, "Forty").otherwise("One").alias("surface_form"))
    alias = spark.range(1).select(F.lit(41).cast("long").alias("entity_id"), F.lit("forty").alias("alias"), F.lit(9).cast("long").alias("to_id"))
    return E.relink_alias(links, alias).select("memory_id", "entity_id").distinct()


def _filters(spark):
    return spark.createDataFrame([(b * 3 + k, b, kinds, e, v) for b in range(8) for k, (kinds, e, v) in enumerate(((["event", "state"], None, "weeks"), (None, 7, None), (["fact"], None, None)))], "model_id long, bank_id long, kinds array<string>, entity_id long, least_volatility string")


@query()
def model_pool(spark, d):
    return E.model_pool(_valued(spark, d), _filters(spark), derived(spark, d, "d_links"), NOW)


@query("""
WITH s AS (SELECT memory_id % 5 AS model_id, memory_id % 3 AS facet, memory_id, memory_id * 37 % 101 AS score, memory_id % 23 = 0 AS cited FROM d_memories),
n AS (SELECT *, row_number() OVER (PARTITION BY model_id, facet ORDER BY score DESC, memory_id) AS n FROM s)
SELECT model_id, facet, memory_id, row_number() OVER (PARTITION BY model_id, facet ORDER BY n) AS rank, cited FROM n WHERE n <= 20 OR cited
""")
def facet_rank(spark, d):
    rows = _m(spark, d).select((F.col("memory_id") % 5).alias("model_id"), (F.col("memory_id") % 3).alias("facet"), "memory_id", (F.col("memory_id") * 37 % 101).alias("score"))
    return E.facet_rank(rows, rows.where("memory_id % 23 = 0").select("model_id", "memory_id"))


@query("""
WITH m AS (SELECT b * 3 + k AS model_id, b AS bank_id, k FROM range(0, 8) AS x(b), range(0, 3) AS y(k)), n AS (SELECT * FROM d_memories WHERE observed_at > TIMESTAMP '2024-01-20 00:00:00')
SELECT DISTINCT model_id, 'new_memory' AS reason FROM m JOIN n USING (bank_id) WHERE CASE k WHEN 0 THEN kind IN ('event', 'state') WHEN 1 THEN memory_id IN (SELECT memory_id FROM d_links WHERE entity_id = 7) ELSE kind = 'fact' END
UNION ALL SELECT DISTINCT memory_id % 24, 'cited_edit' FROM d_memories WHERE memory_id % 50 = 0 AND observed_at > TIMESTAMP '2024-01-20 00:00:00'
""")
def model_triggers(spark, d):
    m = _m(spark, d)
    cites = m.select((F.col("memory_id") % 24).alias("model_id"), "memory_id")
    return E.model_triggers(_filters(spark), cites, m, derived(spark, d, "d_links"), m.where("memory_id % 50 = 0").select("memory_id", F.col("observed_at").alias("edited_at")), "2024-01-20 00:00:00")


# -- browsing and reports --------------------------------------------------------


@query("""
WITH p AS (SELECT source_id, bank_id, row_number() OVER (PARTITION BY bank_id ORDER BY ingested_at DESC, source_id DESC) AS number FROM d_sources),
c AS (SELECT source_id // 2 * 2 AS source_id, count(*) AS chunks, CAST(sum(CASE WHEN queued THEN 1 ELSE 0 END) AS BIGINT) AS queued, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM d_sources GROUP BY 1),
m AS (SELECT memory_id - memory_id % 3 AS source_id, count(*) AS live FROM d_memories WHERE NOT retracted AND NOT hidden AND superseded_by IS NULL GROUP BY 1)
SELECT source_id, bank_id, number, coalesce(chunks, 0) AS chunks, coalesce(queued, 0) AS queued, coalesce(failed, 0) AS failed, coalesce(live, 0) AS live_memories FROM p LEFT JOIN c USING (source_id) LEFT JOIN m USING (source_id) WHERE number <= 20
""")
def list_sources(spark, d):
    """The twenty newest of each bank; a source's chunks are its own and the next one's rows."""
    rows = derived(spark, d, "d_sources")
    return P.list_sources(rows, rows.select((F.floor(F.col("source_id") / 2) * 2).alias("source_id"), "queued", "failed"), _on_sources(spark, d), 20)


@query("""
SELECT s.bank_id, (SELECT count(*) FROM d_memories m WHERE m.bank_id = s.bank_id AND NOT hidden AND NOT retracted AND superseded_by IS NULL) AS live, (SELECT count(*) FROM d_memories m WHERE m.bank_id = s.bank_id AND kind = 'event') AS events, (SELECT count(*) FROM d_memories m WHERE m.bank_id = s.bank_id AND owner_significance = 'kept') AS kept,
  CAST(sum(CASE WHEN kind = 'turn' THEN 1 ELSE 0 END) AS BIGINT) AS turns, count(DISTINCT document_id) AS documents, CAST(sum(CASE WHEN tombstoned THEN 1 ELSE 0 END) AS BIGINT) AS tombstoned, CAST(sum(CASE WHEN queued THEN 1 ELSE 0 END) AS BIGINT) AS queued FROM d_sources s GROUP BY 1
""")
def bank_overview(spark, d):
    m = _m(spark, d)
    status = F.when(F.col("hidden"), "forgetting").when(F.col("retracted"), "retracted").when(F.col("superseded_by").isNotNull(), "superseded").otherwise("live")
    rows = P.bank_overview(m, derived(spark, d, "d_sources"), status)
    return rows.select("bank_id", F.coalesce(F.element_at("by_status", "live"), F.lit(0)).alias("live"), F.coalesce(F.element_at("by_kind", "event"), F.lit(0)).alias("events"), "kept", "turns", "documents", "tombstoned", "queued")


@query("""
WITH a AS (SELECT bank_id, CAST(sum(CASE WHEN queued THEN 1 ELSE 0 END) AS BIGINT) AS queued, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM d_sources GROUP BY 1), b AS (SELECT bank_id, CAST(sum(CASE WHEN memory_id % 37 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS r FROM d_memories GROUP BY 1)
SELECT bank_id, queued, failed, r AS failed_refreshes, concat_ws('; ', CASE WHEN failed > 0 THEN failed || ' failed chunks' END, CASE WHEN r > 0 THEN r || ' failed refreshes' END) AS attention FROM a JOIN b USING (bank_id)
""")
def bank_health(spark, d):
    return P.bank_health(derived(spark, d, "d_sources"), _m(spark, d).select("bank_id", (F.col("memory_id") % 37 == 0).alias("failed")))


@query("""
SELECT bank_id, kind, edit_id, number, 2 AS memories, kind = 'forget' AS pending FROM (SELECT bank_id, CASE memory_id % 2 WHEN 0 THEN 'purge' ELSE 'forget' END AS kind, memory_id AS edit_id, row_number() OVER (PARTITION BY bank_id, memory_id % 2 ORDER BY observed_at DESC, memory_id DESC) AS number FROM d_memories) x WHERE number <= 5
""")
def audit_lists(spark, d):
    m = _m(spark, d)
    details = F.concat(F.lit('{"memories":['), F.col("memory_id").cast("string"), F.lit(", -1]}"))
    edits = m.select(F.col("memory_id").alias("edit_id"), "bank_id", F.when(F.col("memory_id") % 2 == 0, "purge").otherwise("forget").alias("kind"), details.alias("details"), F.col("observed_at").alias("edited_at"))
    return P.audit_lists(edits, m, 5)


@query("""
WITH s AS (SELECT user_id % 8 AS bank_id, user_id AS memory_id, ts, value / 50 - 1 AS value, lag(value / 50 - 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT bank_id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(sum(CASE WHEN before >= -0.7 AND value < -0.7 THEN 1 ELSE 0 END) AS BIGINT) AS fade_outs FROM s GROUP BY 1, 2
""")
def fade_outs(spark, d):
    views(spark, d)
    rows = spark.table("events").select((F.col("user_id") % 8).alias("bank_id"), F.col("user_id").alias("memory_id"), F.col("ts").alias("taken_at"), (F.col("value") / 50 - 1).alias("value"))
    return P.fade_outs(rows)


@query("""
SELECT session_id, count(*) AS prefetches, CAST(sum(length(text)) AS BIGINT) AS tokens FROM d_messages WHERE role = 'user' AND session_id IN (SELECT session_id FROM d_messages WHERE role = 'assistant') GROUP BY 1
""")
def injected_tokens(spark, d):
    rows = derived(spark, d, "d_messages")
    return P.injected_tokens(rows.where("role = 'user'").select("session_id", F.length("text").cast("long").alias("tokens")), rows.where("role = 'assistant'"))


@query("""
WITH l AS (SELECT bank_id, epoch_us(message_at) % 977 AS lag_us FROM d_messages), r AS (SELECT bank_id, lag_us, row_number() OVER (PARTITION BY bank_id ORDER BY lag_us) - 1 AS i, count(*) OVER (PARTITION BY bank_id) AS n FROM l)
SELECT bank_id, max(CASE WHEN i = floor((n - 1) * 0.5 + 0.5) THEN lag_us END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.95 + 0.5) THEN lag_us END) AS p95 FROM r GROUP BY 1
""")
def extraction_lag(spark, d):
    rows = derived(spark, d, "d_messages").select("session_id", "turn", "bank_id", F.col("message_at").cast("timestamp").alias("synced_at")).withColumn("k", F.concat_ws(":", "session_id", "turn"))
    done = rows.select("k", F.timestamp_micros(S.micros("synced_at") + S.micros("synced_at") % 977).alias("completed_at"))
    return H.nearest_rank(P.extraction_lag(rows, done, "k").join(rows.select("k", "bank_id"), "k"), ["bank_id"], "lag_us", {"p50": 0.5, "p95": 0.95})


@query("""
WITH l AS (SELECT d.doc_id AS memory_id, d.doc_id % 4 AS query_id, d.n_chars % 100 AS score, l.quality AS relevant FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT query_id, score, count(*) AS n, sum(relevant) AS r FROM l GROUP BY 1, 2 UNION ALL SELECT NULL, score, count(*), sum(relevant) FROM l GROUP BY 2)
SELECT query_id, score, CAST(sum(n) OVER w AS BIGINT) AS kept, CAST(sum(r) OVER w AS BIGINT) AS relevant, sum(r) OVER w / sum(n) OVER w AS precision FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def facet_curves(spark, d):
    views(spark, d)
    rows = spark.table("labels").join(spark.table("documents"), "doc_id").select(F.col("doc_id").alias("memory_id"), (F.col("doc_id") % 4).alias("query_id"), (F.col("n_chars") % 100).alias("score"), F.col("quality").cast("long").alias("relevant"))
    return P.facet_curves(rows, rows.where("memory_id % 10 = 0").select("memory_id"))[0]


@query("""
SELECT memory_id, min(epoch_us(accessed_at)) AS created_us, CASE WHEN memory_id % 3 = 0 THEN max(epoch_us(accessed_at)) END AS purged_us FROM d_memories LEFT JOIN d_accesses USING (memory_id) GROUP BY 1
""")
def memory_outcomes(spark, d):
    a = derived(spark, d, "d_accesses").groupBy("memory_id").agg(F.min("accessed_at").alias("created_at"), F.max("accessed_at").alias("purged_at"))
    none = a.where("false").select("memory_id", F.col("created_at").alias("faded_at"))
    rows = P.memory_outcomes(_m(spark, d), a.select("memory_id", "created_at"), none, a.where("memory_id % 3 = 0").select("memory_id", "purged_at"))
    return rows.select("memory_id", S.micros("created_at").alias("created_us"), S.micros("purged_at").alias("purged_us"))


@query()
def projections(spark, d):
    """How long each memory lasts from now, when it had faded before, when it may be purged and what holds it."""
    _checkpoints(spark)
    rows = Z.fading(_m(spark, d), derived(spark, d, "d_accesses"), derived(spark, d, "d_messages"), _heads(spark, d), NOW)
    return rows.withColumn("guards", F.array_join("guards", ","))


_ZONES = ("Europe/Berlin", "America/New_York", "Asia/Kolkata")


@query("""
WITH z AS (SELECT bank_id, CASE bank_id % 3 WHEN 0 THEN INTERVAL 60 MINUTE WHEN 1 THEN INTERVAL (-300) MINUTE ELSE INTERVAL 330 MINUTE END AS off FROM range(8) r(bank_id)),
a AS (SELECT memory_id % 8 AS bank_id, access_id, kind, accessed_at, CAST(accessed_at + off AS DATE) AS day FROM d_accesses JOIN z ON memory_id % 8 = z.bank_id),
s AS (SELECT bank_id, day, sum(access_id % 3) AS purges, max_by(access_id % 11, (accessed_at, access_id % 11)) AS lines FROM a WHERE kind = 'confirmed' GROUP BY 1, 2)
SELECT 'purges' AS series, bank_id, day, CAST(purges AS BIGINT) AS n FROM s WHERE purges > 0 UNION ALL SELECT 'agenda_lines', bank_id, day, lines FROM s
UNION ALL SELECT 'refresh_calls', bank_id, day, CAST(sum(1 + access_id % 2) AS BIGINT) FROM a WHERE kind = 'used' GROUP BY 2, 3
""")
def day_series(spark, d):
    """Confirmations of the test tables as sweeps, uses as refreshes; no zone changes its clocks in the events' time."""
    a = derived(spark, d, "d_accesses").select((F.col("memory_id") % 8).alias("bank_id"), F.col("accessed_at").alias("at"), "kind", "access_id")
    zone = F.element_at(F.array(*[F.lit(z) for z in _ZONES]), (F.col("bank_id") % 3 + 1).cast("int"))
    banks = spark.range(8).select(F.col("id").alias("bank_id")).withColumn("timezone", zone)
    sweeps = a.where("kind = 'confirmed'").select("bank_id", "at", (F.col("access_id") % 3).alias("purged"), (F.col("access_id") % 11).alias("agenda_lines"))
    return P.day_series(sweeps, a.where("kind = 'used'").select("bank_id", "at", (1 + F.col("access_id") % 2).alias("calls")), banks)


@query("""
WITH p AS (SELECT CASE WHEN session_id % 7 = 0 THEN 'cron' ELSE 'turns' END AS "of", length(text) AS tokens, session_id % 7 <> 0 AND turn % 4 <> 2 AS told FROM d_messages WHERE role = 'user'),
r AS (SELECT "of", tokens, row_number() OVER (PARTITION BY "of" ORDER BY tokens) - 1 AS i, count(*) OVER (PARTITION BY "of") AS n FROM p WHERE told),
q AS (SELECT "of", max(CASE WHEN i = floor((n - 1) * 0.5 + 0.5) THEN tokens END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.95 + 0.5) THEN tokens END) AS p95 FROM r GROUP BY 1)
SELECT s.*, p50, p95 FROM (SELECT "of", count(*) AS prefetches, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (told) AS samples FROM p GROUP BY 1) s LEFT JOIN q USING ("of")
""")
def turn_tokens(spark, d):
    """Users' messages as look-ups of as many tokens as they have characters; every seventh session is cron's."""
    rows = derived(spark, d, "d_messages").where("role = 'user'")
    rows = rows.select("session_id", F.length("text").cast("long").alias("tokens"), (F.col("session_id") % 7 == 0).alias("cron"), (F.col("turn") % 4 == 2).alias("prefetch_only"))
    return P.turn_tokens(rows, {"p50": 0.5, "p95": 0.95})


@query("""
WITH e AS (SELECT user_id % 3 AS level, value, event_type = 'click' AS reranked FROM events),
r AS (SELECT level, value, row_number() OVER (PARTITION BY level ORDER BY value) AS i, count(*) OVER (PARTITION BY level) AS n FROM e)
SELECT level, any_value(n) AS samples, max(value) AS max, (SELECT avg(CASE WHEN reranked THEN 1.0 ELSE 0.0 END) FROM e WHERE e.level = r.level) AS reranked_share,
max(CASE WHEN i - 1 = floor((n - 1) * 0.5 + 0.5) THEN value END) AS p50, max(CASE WHEN i - 1 = floor((n - 1) * 0.95 + 0.5) THEN value END) AS p95, max(CASE WHEN i - 1 = floor((n - 1) * 0.99 + 0.5) THEN value END) AS p99 FROM r GROUP BY level
""")
def latency_summary(spark, d):
    views(spark, d)
    rows = spark.table("events").select((F.col("user_id") % 3).alias("level"), "value", (F.col("event_type") == "click").alias("reranked"))
    return P.latency_summary(rows, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


# -- streams ---------------------------------------------------------------------


@query()
def session_context(spark, d):
    """Events of the test tables as what happens in sessions of their users' days."""
    views(spark, d)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("prefetch", "sync", "recall", "clear")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = spark.table("events").select((F.col("user_id") % 8).alias("bank_id"), F.col("user_id").cast("string").alias("session_id"), S.micros("ts").alias("at_us"), kind.alias("type"), F.floor(F.col("event_id") / 4).cast("string").alias("recall_id"), F.array(F.col("event_id") % 50, F.col("event_id") % 7).cast("array<bigint>").alias("memories"))
    return T.session_context(rows).withColumn("in_context", F.array_join(F.col("in_context").cast("array<string>"), ","))


_SENT = f"""
p AS (SELECT session_id, bank_id, turn_no, min(message_at) AS message_at, max(CASE WHEN role = 'user' THEN text END) AS u,
  max_by(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN turn END) AS r
  FROM (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY session_id ORDER BY turn) AS turn_no FROM d_messages) m WHERE turn_no > 0 GROUP BY ALL),
t AS (SELECT *, coalesce(u, '') AS user_text, coalesce(r, '') AS reply_text, session_id * 10000 + turn_no * 10 AS n, turn_no % 5 = 2 AS forgets FROM p),
h AS (SELECT *, sha256({_length_blob('user_text')} || encode(user_text) || {_length_blob('reply_text')} || encode(reply_text)) AS content_hash FROM t),
sent AS (SELECT * FROM h UNION ALL BY NAME SELECT * REPLACE (n + 1 AS n, false AS forgets) FROM h WHERE session_id % 3 = 0)"""


@query(f"""
WITH {_SENT},
k AS (SELECT *, row_number() OVER (PARTITION BY bank_id, session_id, message_at, content_hash ORDER BY n) AS seen FROM sent)
SELECT session_id, turn_no, n % 10 AS delivery, CASE WHEN seen > 1 OR session_id % 5 = 0 THEN 'duplicate' WHEN forgets THEN 'tombstone' ELSE 'stored' END AS outcome,
  content_hash, CASE WHEN NOT forgets THEN sha256(user_text) END AS user_sha256, CASE WHEN forgets THEN 'forget_requested' END AS tombstone_reason
FROM k
""")
def ingest_turns(spark, d):
    """Turns of the test tables, those of every third session sent twice, on top of a store that holds every fifth; a session's second, seventh .. ask to forget when sent first."""
    t = H.pair_turns(derived(spark, d, "d_messages")).withColumn("n", F.col("session_id") * 10000 + F.col("turn_no") * 10)
    t = t.withColumn("forget_requested", F.col("turn_no") % 5 == 2).withColumn("recall_id", F.lit(None).cast("string"))
    again = t.where("session_id % 3 = 0").withColumn("n", F.col("n") + 1).withColumn("forget_requested", F.lit(False))
    stored = H.keyed_turns(t.where("session_id % 5 = 0"))
    rows = H.ingest_turns(t.unionByName(again), stored, "n")
    return rows.select("session_id", "turn_no", (F.col("n") % 10).alias("delivery"), "outcome", "content_hash", F.sha2("user_text", 256).alias("user_sha256"), "tombstone_reason")


@query()
def trigger_debounce(spark, d):
    views(spark, d)
    return T.trigger_debounce(spark.table("events").select((F.col("user_id") % 8).cast("long").alias("bank_id"), S.micros("ts").alias("at_us")))
