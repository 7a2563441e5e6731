"""A kept full-text index: posting lists in blocks by impact, and each text's own words.

``write_index`` counts the words of texts once. The postings of a word in a bank are
cut into parts by hash and, within a part, into blocks from the highest impact down; a
block knows its largest count and its shortest text, which bound any score in it whatever the
collection's statistics become. ``update_index`` reads the words of new and changed
texts only.

``index_top_k`` gives the rows of ``recall.bm25_top_k``. The first blocks of each asked word
give a score that k memories reach. Words whose best scores together do not reach it are not
looked up: no memory that has only these can be among the k. Of the other words' blocks those
are opened that can reach it with the best of all other words, and only memories found there are scored, from
their own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.operators.recall import K1, PER_ARM, B, tokens, top_k

#: What the order of a sum may move a score.
SLACK = 1e-6
BLOCK, PART = 128, 50_000
#: So many words of all queries go to every task; more are shuffled, and the index with them.
AT_ONCE = 1_000_000


def _spread(words: DataFrame):
    return F.broadcast if words.count() <= AT_ONCE else lambda rows: rows


def _impact(tf: Column, size: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def _texts(memories: DataFrame) -> DataFrame:
    return memories.select("memory_id", "bank_id", F.sha2("content", 256).alias("hash"), "content")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text with their counts, told apart where the text is."""
    for batch in batches:
        said = batch.column(3)
        size = pc.fill_null(said.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = said.flatten().dictionary_encode()
        many = max(len(coded.dictionary), 1)
        key, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + coded.indices.to_numpy(), return_counts=True)
        ends = np.searchsorted(key, np.arange(len(size) + 1) * many)
        pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % many)), pa.array(tf)], ["term", "tf"])
        own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), said.value_lengths().cast(pa.int32()), own], ["memory_id", "bank_id", "hash", "size", "words"])


def _append(texts: DataFrame, path: str, block: int, part: int) -> None:
    """Add ``texts(memory_id, bank_id, hash, content)`` to the index at ``path``."""
    words = texts.select("memory_id", "bank_id", "hash", tokens(F.col("content")).alias("t")).mapInArrow(_counted, "memory_id long, bank_id long, hash string, size int, words array<struct<term:string,tf:bigint>>")
    words.write.mode("append").parquet(f"{path}/texts")
    mean = texts.sparkSession.read.parquet(f"{path}/texts").agg(F.greatest(F.avg("size"), F.lit(1e-9))).first()[0]
    counts = words.select("memory_id", "bank_id", "size", F.inline("words"))
    parts = counts.groupBy("bank_id", "term").agg(F.ceil(F.count("*") / part).alias("parts")).where("parts > 1")  # fewer than postings / part
    rows = counts.join(F.broadcast(parts), ["bank_id", "term"], "left").withColumn("part", F.pmod(F.xxhash64("memory_id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    order = W.partitionBy("bank_id", "term", "part").orderBy(_impact(F.col("tf"), F.col("size"), F.lit(mean)).desc(), "memory_id")
    rows = rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / block))
    blocks = rows.groupBy("bank_id", "term", "part", "block").agg(
        F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("size").alias("least_size"), F.collect_list(F.struct("memory_id", "tf", "size")).alias("postings")
    )
    blocks.write.mode("append").parquet(f"{path}/blocks")


def write_index(memories: DataFrame, path: str, block: int = BLOCK, part: int = PART) -> str:
    """Index ``memories(memory_id, bank_id, content)``, whose ids are distinct, in the folder ``path``."""
    _append(_texts(memories), path, block, part)
    return path


def update_index(memories: DataFrame, path: str, target: str, block: int = BLOCK, part: int = PART) -> str:
    """Bring the index at ``path`` to ``memories``; the path of the index that is now right.

    Where texts are only added, their blocks are added to ``path``. Where texts changed or went,
    the rest of the index is copied to ``target`` without their postings, from the index alone.
    """
    spark = memories.sparkSession
    texts, blocks = spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/blocks")
    now = _texts(memories)
    key = ["memory_id", "bank_id", "hash"]
    gone, new = texts.select(*key).join(now.select(*key), key, "left_anti"), now.join(texts.select(*key), key, "left_anti")
    if not gone.isEmpty():
        texts.join(gone, key, "left_anti").write.parquet(f"{target}/texts")
        lost = gone.select("memory_id")
        rows = blocks.select("bank_id", "term", "part", "block", F.monotonically_increasing_id().alias("list"), F.explode("postings").alias("p"))
        rows = rows.join(lost, F.col("p.memory_id") == lost["memory_id"], "left_anti")
        kept = rows.groupBy("bank_id", "term", "part", "block", "list").agg(F.count("*").alias("n"), F.max("p.tf").alias("most_tf"), F.min("p.size").alias("least_size"), F.collect_list("p").alias("postings"))
        kept.drop("list").write.parquet(f"{target}/blocks")
        new = now.join(spark.read.parquet(f"{target}/texts").select(*key), key, "left_anti")
        path = target
    if not new.isEmpty():
        _append(new, path, block, part)
    return path


def candidates(spark: SparkSession, path: str, queries: DataFrame, k: int = PER_ARM) -> tuple[DataFrame, DataFrame]:
    """(query_id, memory_id) that can be among the ``k`` best, and (query_id, bank_id, term, idf) of the words asked for."""
    blocks = spark.read.parquet(f"{path}/blocks")
    stats = spark.read.parquet(f"{path}/texts").agg(F.count("*").alias("docs"), F.greatest(F.avg("size"), F.lit(1e-9)).alias("mean"))
    asked = queries.select("query_id", "bank_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    spread = _spread(asked)
    heads = blocks.drop("postings").join(spread(asked.select("term").distinct()), "term", "left_semi")
    lists = heads.groupBy("term", "bank_id").agg(F.sum("n").alias("n"), F.max("most_tf").alias("most_tf"), F.min("least_size").alias("least_size"))
    df = lists.groupBy("term").agg(F.sum("n").alias("df"))
    words = asked.join(df, "term").crossJoin(F.broadcast(stats))  # one row of totals
    words = words.select("query_id", "bank_id", "term", "mean", _idf(F.col("docs"), F.col("df")).alias("idf"))
    bound = F.col("idf") * _impact(F.col("most_tf"), F.col("least_size"), F.col("mean"))
    best = words.join(lists, ["term", "bank_id"]).withColumn("best", bound).drop("n", "most_tf", "least_size").checkpoint()
    # what k memories reach by the first blocks of each word alone
    part = F.col("idf") * _impact(F.col("p.tf"), F.col("p.size"), F.col("mean"))
    size = blocks.agg(F.max("n")).first()[0] or 1
    first = blocks.where(F.col("block") < -(-k // size)).join(spread(best), ["term", "bank_id"]).select("query_id", "idf", "mean", F.explode("postings").alias("p"))
    reached = first.groupBy("query_id", F.col("p.memory_id").alias("memory_id")).agg(F.sum(part).alias("score"))
    reached = top_k(reached, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("reach"))
    # words from the weakest up: as long as they do not reach it together, they need no look
    rows = best.join(reached, "query_id").withColumn("upto", F.sum("best").over(W.partitionBy("query_id").orderBy("best", "term")))
    rows = rows.withColumn("all", F.sum("best").over(W.partitionBy("query_id")))
    needed = rows.where(F.col("upto") >= F.col("reach") - SLACK)
    opened = blocks.join(spread(needed), ["term", "bank_id"]).where(bound + F.col("all") - F.col("best") >= F.col("reach") - SLACK)
    found = opened.select("query_id", F.explode("postings.memory_id").alias("memory_id")).distinct()
    return found, best.select("query_id", "bank_id", "term", "idf", "mean")


def index_top_k(spark: SparkSession, path: str, queries: DataFrame, k: int = PER_ARM) -> DataFrame:
    """(query_id, memory_id, score, rank): the rows of ``recall.bm25_top_k`` over the indexed memories."""
    found, words = candidates(spark, path, queries, k)
    spread = _spread(words)
    texts = spark.read.parquet(f"{path}/texts").select("memory_id", "size", F.inline("words"))
    texts = texts.join(spread(words.select("term").distinct()), "term", "left_semi")  # words that nobody asks for go no further
    rows = found.join(texts, "memory_id").join(spread(words.select("query_id", "term", "idf", "mean")), ["query_id", "term"])
    part = F.col("idf") * _impact(F.col("tf"), F.col("size"), F.col("mean"))
    return top_k(rows.groupBy("query_id", "memory_id").agg(F.sum(part).alias("score")), k)
