"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_text, jaccard_join, mixing, packing, phrases, pii, preference_chat, prefix_trie, quality, repeats, url_filter
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.pseudonymised(table(spark, sf_dir, "documents"))
    return rows.withColumn("entities", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["surrogate"])), "|"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("file", "row")


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference_chat.preference_rows(table(spark, sf_dir, "conversations"))
    masks = {c: preference_chat.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")}
    return rows.withColumns(masks)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), jaccard_join.Similarity(width=3, num=9, den=10))


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op11_sum_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontaminate, op2_mix_sources, op3_exact_dedup, op4_pii_surrogates, op5_preference_chat,
        op6_quality, op7_jaccard_join, op8_main_text, op9_url_filter, op10_remove_repeats,
        op11_sum_squares_packing, op12_collocations, op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


_OP3 = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d
JOIN (SELECT coalesce(text, '') AS body, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g
  ON coalesce(d.text, '') = g.body
"""

_OP5 = """
WITH t AS (
  SELECT conv_id, (conv_id & -2) // 2 AS pair_id, conv_id & 1 AS side, coalesce(role, '') AS role,
         coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT pair_id, min(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, min(CASE WHEN side = 1 THEN conv_id END) AS rejected_id,
         coalesce(max(CASE WHEN side = 0 THEN i END), 0) AS na, coalesce(max(CASE WHEN side = 1 THEN i END), 0) AS nb
  FROM t GROUP BY pair_id
), m AS (
  SELECT a.pair_id, min(a.i) AS bad FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id
), c AS (
  SELECT p.*, coalesce(m.bad - 1, least(na, nb)) AS n_common FROM p LEFT JOIN m USING (pair_id)
), r AS (
  SELECT t.pair_id, t.side, t.i, t.role, '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS s, c.n_common
  FROM t JOIN c USING (pair_id)
), s AS (
  SELECT *, sum(length(s)) OVER (PARTITION BY pair_id, side ORDER BY i) AS e FROM r WHERE i > n_common
), o AS (
  SELECT pair_id,
         string_agg(CASE WHEN side = 0 THEN s END, '' ORDER BY i) AS chosen, string_agg(CASE WHEN side = 1 THEN s END, '' ORDER BY i) AS rejected,
         string_agg(CASE WHEN side = 0 AND role = 'assistant' THEN CAST(e - length(s) + length(role) + 5 AS BIGINT) || '-' || CAST(e - 1 AS BIGINT) END, ',' ORDER BY i) AS chosen_mask,
         string_agg(CASE WHEN side = 1 AND role = 'assistant' THEN CAST(e - length(s) + length(role) + 5 AS BIGINT) || '-' || CAST(e - 1 AS BIGINT) END, ',' ORDER BY i) AS rejected_mask
  FROM s GROUP BY pair_id
), q AS (SELECT pair_id, string_agg(s, '' ORDER BY i) AS prompt FROM r WHERE side = 0 AND i <= n_common GROUP BY pair_id)
SELECT c.pair_id, c.chosen_id, c.rejected_id, c.n_common, coalesce(q.prompt, '') AS prompt,
       CASE WHEN na > 0 THEN coalesce(o.chosen, '') END AS chosen, CASE WHEN nb > 0 THEN coalesce(o.rejected, '') END AS rejected,
       CASE WHEN na > 0 THEN coalesce(o.chosen_mask, '') END AS chosen_mask, CASE WHEN nb > 0 THEN coalesce(o.rejected_mask, '') END AS rejected_mask
FROM c LEFT JOIN o USING (pair_id) LEFT JOIN q USING (pair_id)
"""


_OP12 = """
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents
), p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\\x20\\x09]+') AS w FROM t
), q AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p
), f AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
  FROM q CROSS JOIN (VALUES (1), (2), (3)) AS lengths(m) WHERE i + m - 1 <= len(w) GROUP BY ALL
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, m, f AS a FROM f WHERE m > 1 AND f >= 10
), k AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), s AS (
  SELECT lang, phrase, max(a) AS over FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE m = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE m = 3) GROUP BY ALL
), o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN s ON s.lang = b.lang AND s.phrase = b.phrase AND b.m = 2 WHERE s.over IS NULL OR 100 * s.over < 50 * b.a
)
SELECT o.lang, rank, phrase, a, l, r, n.n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_collocations": _OP12, "op3_exact_dedup": _OP3, "op5_preference_chat": _OP5}
