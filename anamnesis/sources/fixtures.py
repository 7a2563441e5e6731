"""Memory-bank tables derived from the driver's tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MEMORIES = """
SELECT doc_id AS memory_id, CAST(floor(doc_id / 10) AS BIGINT) % 8 AS bank_id, coalesce(text, '') AS content,
       CASE doc_id % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'event' WHEN 2 THEN 'state' WHEN 3 THEN 'task' ELSE 'recurring' END AS kind,
       CASE doc_id % 7 WHEN 0 THEN 'minor' WHEN 1 THEN 'notable' WHEN 2 THEN 'major' WHEN 3 THEN 'critical' ELSE 'trivial' END AS significance,
       CASE WHEN doc_id % 41 = 0 THEN 'kept' END AS owner_significance,
       CASE WHEN doc_id % 5 = 2 THEN CASE CAST(floor(doc_id / 5) AS BIGINT) % 5 WHEN 0 THEN 'hours' WHEN 1 THEN 'days'
            WHEN 2 THEN 'weeks' WHEN 3 THEN 'months' ELSE 'years' END END AS volatility,
       TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 600) * INTERVAL '1' HOUR AS observed_at,
       CASE WHEN doc_id % 5 = 1 THEN TIMESTAMP '2024-01-05 00:00:00' + (doc_id % 40) * INTERVAL '1' DAY END AS valid_from,
       CASE WHEN doc_id % 10 = 6 THEN TIMESTAMP '2024-01-20 00:00:00' + (doc_id % 20) * INTERVAL '1' DAY END AS valid_until,
       CASE WHEN doc_id % 10 = 8 THEN TIMESTAMP '2024-01-10 00:00:00' + (doc_id % 50) * INTERVAL '1' DAY END AS due_at,
       CASE WHEN doc_id % 10 = 6 AND doc_id + 1 < (SELECT count(*) FROM documents) THEN doc_id + 1 END AS ended_by,
       CASE WHEN doc_id % 10 IN (3, 4) AND doc_id + 1 < (SELECT count(*) FROM documents) THEN doc_id + 1 END AS superseded_by,
       doc_id % 10 = 3 AS retracted, doc_id % 97 = 0 AS hidden, CAST(doc_id % 3 AS INT) = 0 AS low_confidence
FROM documents
"""

ACCESSES = """
SELECT event_id AS access_id, event_id % (SELECT count(*) FROM documents) AS memory_id,
       CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'used' WHEN 'click' THEN 'mentioned_again' ELSE 'confirmed' END AS kind,
       ts AS accessed_at, event_id AS turn
FROM events WHERE event_type <> 'error'
"""

MESSAGES = """
SELECT conv_id AS session_id, conv_id % 8 AS bank_id, turn, role, text,
       TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 6) * INTERVAL '1' HOUR + (turn * 10) * INTERVAL '1' MINUTE AS message_at
FROM conversations
"""

LINKS = """
SELECT memory_id, bank_id, entity_id FROM (
  SELECT d.doc_id AS memory_id, CAST(floor(d.doc_id / 10) AS BIGINT) % 8 AS bank_id, CAST(d.doc_id % 40 AS BIGINT) AS entity_id FROM documents d
  UNION ALL SELECT d.doc_id, CAST(floor(d.doc_id / 10) AS BIGINT) % 8, CAST(40 + d.doc_id % 7 AS BIGINT) FROM documents d WHERE d.doc_id % 3 = 0) AS l
"""

ENTITIES = """
SELECT DISTINCT CAST(doc_id % 47 AS BIGINT) AS entity_id, 'Entity ' || CAST(doc_id % 47 AS STRING) AS name, doc_id % 47 = 0 AS seeded,
       CASE WHEN doc_id % 47 IN (41, 42, 43) THEN CAST(doc_id % 47 + 1 AS BIGINT) WHEN doc_id % 47 = 5 THEN CAST(6 AS BIGINT) END AS merged_into
FROM documents
"""

SOURCES = """
SELECT doc_id AS source_id, CAST(floor(doc_id / 10) AS BIGINT) % 8 AS bank_id, CASE WHEN doc_id % 4 = 0 THEN 'document' ELSE 'turn' END AS kind,
       CASE WHEN doc_id % 4 <> 0 THEN CAST(floor(doc_id / 12) AS BIGINT) END AS session_id, CASE WHEN doc_id % 4 = 0 THEN 'doc-' || CAST(doc_id % 24 AS STRING) END AS document_id,
       TIMESTAMP '2023-10-01 00:00:00' + (doc_id % 3000) * INTERVAL '1' HOUR AS ingested_at, coalesce(text, '') AS text, source AS author,
       doc_id % 29 = 0 AS tombstoned, doc_id % 53 = 0 AS removed, doc_id % 11 = 0 AS queued, doc_id % 31 = 0 AS failed
FROM documents
"""

DERIVED = {"d_memories": MEMORIES, "d_accesses": ACCESSES, "d_messages": MESSAGES, "d_links": LINKS, "d_entities": ENTITIES, "d_sources": SOURCES}
BASE = ("documents", "events", "conversations", "embeddings", "labels", "benchmark")


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in BASE:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(DERIVED[name])


def with_derived(sql: str) -> str:
    """DuckDB SQL that may use the derived tables."""
    used = ", ".join(f"{n} AS ({q})" for n, q in DERIVED.items() if n in sql)
    return f"WITH {used}, {sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"WITH {used} {sql}"
