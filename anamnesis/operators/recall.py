"""Retrieval over batches of queries: full-text and vector arms, fusion, scoring and the gate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B, RRF_K, PER_ARM = 1.2, 0.75, 60, 100


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25_top_k(memories: DataFrame, queries: DataFrame, k: int = PER_ARM) -> DataFrame:
    """(query_id, memory_id, score, rank): the ``k`` best by ``bm25_scores``, ties to the lower id."""
    return top_k(bm25_scores(memories, queries), k)


def bm25_scores(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, memory_id, score): Okapi BM25 of any query word over the memories of the query's bank.

    Words are counted over all banks; postings meet a query by word and bank, so a
    common word's are dealt out by bank. Only words that some query asks for are
    gathered, the rest go no further than their own text.
    """
    words = memories.select("memory_id", "bank_id", tokens(F.col("content")).alias("t"))
    stats = words.agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("mean_size"))
    asked = queries.select("query_id", "bank_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    terms = words.select("memory_id", "bank_id", F.size("t").alias("size"), F.explode("t").alias("term"))
    counts = terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("memory_id", "term").agg(F.first("bank_id").alias("bank_id"), F.first("size").alias("size"), F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    wanted = asked.join(df, "term").crossJoin(F.broadcast(stats))  # one row of totals
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    return wanted.join(counts, ["term", "bank_id"]).groupBy("query_id", "memory_id").agg(F.sum(part).alias("score"))


def bm25_best(memories: DataFrame, queries: DataFrame, heads: DataFrame, k: int, words_per_block: int = 4_000_000, queries_per_block: int = 1_000) -> DataFrame:
    """(query_id, memory_id, score, rank): the ``k`` best heads of ``heads(memory_id, head_id)`` by the best of their memories' ``bm25_scores``.

    For queries as long as texts, which nearly every memory of their bank shares a word with: no row is made
    per pair or per shared word. A bank's memories are cut into blocks of about ``words_per_block`` words, its queries into
    blocks too; a task takes one of each and keeps the best k heads per query. The work
    still grows with queries times memories of a bank, the rows do not.
    """
    words = memories.select("memory_id", "bank_id", tokens(F.col("content")).alias("t"))
    stats = words.agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("mean_size"))
    df = words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", "bank_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    wanted = asked.join(df, "term").crossJoin(F.broadcast(stats))  # one row of totals
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = wanted.groupBy("query_id", "bank_id").agg(F.first("mean_size").alias("mean_size"), F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("terms"))
    wanted = wanted.select("query_id", "bank_id", "mean_size", F.col("terms.term").alias("terms"), F.col("terms.idf").alias("idfs"))
    sizes = memories.groupBy("bank_id").agg(F.ceil(F.sum(F.coalesce(F.length("content") / 5, F.lit(0)) + 1) / words_per_block).alias("_s"))
    cuts = sizes.join(queries.groupBy("bank_id").agg(F.ceil(F.count("*") / queries_per_block).alias("_q")), "bank_id")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = memories.select("memory_id", "bank_id", "content").join(heads, "memory_id").join(F.broadcast(cuts), "bank_id")  # a row per bank
    left = left.select("bank_id", F.pmod(F.xxhash64("memory_id"), "_s").alias("_at"), each("_q").alias("_of"), "head_id", F.array_join(tokens(F.col("content")), " ").alias("t"))
    right = wanted.join(F.broadcast(cuts), "bank_id")
    right = right.select(F.col("bank_id").alias("_bank"), each("_s").alias("_block"), F.pmod(F.xxhash64("query_id"), "_q").alias("_part"), "query_id", "mean_size", "terms", "idfs")

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if one.num_rows and two.num_rows:
            one = one.sort_by("head_id")
            said, asked = pc.split_pattern(one["t"].combine_chunks().cast(pa.large_string()), " "), two["terms"].combine_chunks()
            asked_words = asked.flatten().cast(pa.large_string()).dictionary_encode()
            size = pc.fill_null(said.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(said.flatten(), value_set=asked_words.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            n = len(size)
            key, tf = np.unique((code * n + np.repeat(np.arange(n), size))[code >= 0], return_counts=True)
            row = key % n
            ends = np.searchsorted(key, np.arange(1, len(asked_words.dictionary) + 1) * n)
            begins = np.append(0, ends[:-1])
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / two["mean_size"][0].as_py()))
            ids = one["head_id"].to_numpy()
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            ids = ids[first]
            stops = np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))
            terms, idfs = asked_words.indices.to_numpy(), two["idfs"].combine_chunks().flatten().to_numpy()
            for query, a, b in zip(two["query_id"].to_pylist(), np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True):
                score = np.zeros(n)
                for term, weight in zip(terms[a:b].tolist(), idfs[a:b].tolist(), strict=True):
                    s = slice(begins[term], ends[term])
                    score[row[s]] += weight * part[s]
                score = np.maximum.reduceat(score, first)
                rounded = np.round(score, 9)
                live = np.flatnonzero((score > 0) & (rounded >= np.partition(rounded, -k)[-k])) if len(score) > k else np.flatnonzero(score > 0)
                best = live[np.argsort(-rounded[live], kind="stable")[:k]]
                for column, values in zip(out, (np.full(len(best), query), ids[best], score[best]), strict=True):
                    column.append(values)
        return pa.table([np.concatenate(x) for x in out], names=["query_id", "memory_id", "score"])

    found = left.groupBy("bank_id", "_at", "_of").cogroup(right.groupBy("_bank", "_block", "_part")).applyInArrow(run, "query_id long, memory_id long, score double")
    return top_k(found.groupBy("query_id", "memory_id").agg(F.max("score").alias("score")), k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "memory_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = PER_ARM, rows_per_block: int = 50_000, queries_per_block: int = 2_000, by: str = "memory_id") -> DataFrame:
    """(query_id, memory_id, score, rank): exact cosine of ``queries(query_id, bank_id, embedding)`` and the vectors of their bank.

    With another ``by``, as the head of a chain, vectors are put together by that column before
    the best are taken: each of its values counts once, with its nearest vector, and stands as memory_id.

    A bank's vectors and queries are cut into blocks by hash; a task multiplies one
    block of each and keeps the best k per query, so a large bank is many tasks.
    Null vectors and ones with NaN match nothing; a zero vector has similarity 0.
    """
    size = vectors.groupBy("bank_id").agg(F.ceil(F.count("*") / rows_per_block).alias("_s"))
    asked = queries.groupBy("bank_id").agg(F.ceil(F.count("*") / queries_per_block).alias("_q"))
    cuts = size.join(asked, "bank_id")
    left = vectors.where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x))").join(cuts, "bank_id")
    left = left.select("bank_id", F.pmod(F.xxhash64("memory_id"), "_s").alias("_vs"), F.explode(F.sequence(F.lit(0), F.col("_q") - 1)).alias("_qs"), F.col(by).alias("memory_id"), "embedding")
    right = queries.where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x))").join(cuts, "bank_id")
    right = right.select(F.col("bank_id").alias("_bank"), F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_block"), F.pmod(F.xxhash64("query_id"), "_q").alias("_part"), "query_id", F.col("embedding").alias("asked"))

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if one.num_rows and two.num_rows:
            ids, m = one["memory_id"].to_numpy(), unit(one["embedding"])
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], m[order]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            ids, sims = ids[first], np.maximum.reduceat(np.round(unit(two["asked"]) @ m.T, 9), first, axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            out = [np.repeat(two["query_id"].to_numpy(), best.shape[1]), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()]
        return pa.table(out, names=["query_id", "memory_id", "score"])

    found = left.groupBy("bank_id", "_vs", "_qs").cogroup(right.groupBy("_bank", "_block", "_part")).applyInArrow(run, "query_id long, memory_id long, score double")
    return top_k(found if by == "memory_id" else found.groupBy("query_id", "memory_id").agg(F.max("score").alias("score")), k)


def rrf_fuse(arms: DataFrame, *more: Column, k: int = RRF_K) -> DataFrame:
    """(query_id, memory_id, rrf, rank) from (arm, query_id, memory_id, rank), and ``more`` aggregates; ties to the lower id."""
    fused = arms.groupBy("query_id", "memory_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), *more)
    order = W.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "memory_id")
    return fused.withColumn("rank", F.row_number().over(order))


def effective_query(message: Column, previous: Column, least: int = 8) -> Column:
    """A message of fewer than eight words takes the previous one before it."""
    short = F.size(F.filter(F.split(message, r"\s+"), lambda w: w != "")) < least
    return F.when(short & (F.length(F.coalesce(previous, F.lit(""))) > 0), F.concat_ws("\n", previous, message)).otherwise(message)


def gate(scored: DataFrame, floor: float, cap: int = 8, budget: int = 600, header: int = 0, by: str = "score") -> DataFrame:
    """(query_id, memory_id, rank, decision): in score order what enters a prompt.

    Below the floor: under_floor; when ``cap`` are taken: over_cap; a line that
    would pass the token budget: over_budget, while later shorter ones may fit.
    ``by`` names the column that the floor holds for.
    """
    rows = scored.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "memory_id", "chars", F.col(by).alias("floored")))).alias("rows"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(header).cast("long").alias("used"), F.array().cast("array<struct<memory_id:bigint,decision:string>>").alias("out"))

    def step(acc, r):
        fits = F.ceil((acc["used"] + r["chars"] + 1) / 4) <= budget
        decision = F.when(r["floored"] < floor, "under_floor").when(acc["n"] >= cap, "over_cap").when(~fits, "over_budget").otherwise("taken")
        took = decision == "taken"
        return F.struct(
            (acc["n"] + F.when(took, 1).otherwise(0)).alias("n"), F.when(took, acc["used"] + r["chars"] + 1).otherwise(acc["used"]).cast("long").alias("used"),
            F.concat(acc["out"], F.array(F.struct(r["memory_id"].cast("long").alias("memory_id"), decision.alias("decision")))).alias("out"),
        )

    done = rows.select("query_id", F.posexplode(F.aggregate("rows", zero, step, lambda acc: acc["out"])).alias("rank", "r"))
    return done.select("query_id", "r.memory_id", (F.col("rank") + 1).cast("long").alias("rank"), "r.decision")
