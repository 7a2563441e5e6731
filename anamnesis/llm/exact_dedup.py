"""Exact deduplication by stateful streaming.

Documents stream through a keyed state on disk (RocksDB) that never expires: for
each SHA-256 it keeps the number of rows, the identifier that stays with its place,
and the locator (file and row) of the content seen first. A row that hits a known
digest has its full bytes compared with those at the locator. A state that is kept in
a folder goes on with the next table: its rows meet the digests of all before. Only
DataFrame and streaming functions run on the executors.
"""

from __future__ import annotations

import time
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collected, fresh_path, located, placed, staged, text_of

#: The state on disk. Many small stores: no disk is set aside in advance, and a
#: batch uploads what it changed.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Rows of one group that meet one copy of the text that stays.
ROWS_PER_SALT = 2_000


def streamed_state(spark: SparkSession, home: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """Stream what is new in the folders ``home/digests/*`` through the state in ``home``.

    Returns (digest, group_size, stay, origin) of all digests ever seen: ``stay`` the
    largest (doc_id, file, row), ``origin`` the first (run, file, row). Each
    micro-batch writes the keys it changed; numbers and identifiers only grow and
    places only shrink, so a key's extremes over its lines are its state, and a batch
    that is run again after a failure overwrites its own folder.
    """
    out = f"{home}/groups"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/digests/*")
    state = stream.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("stay"), F.min(F.struct("run", "file", "row")).alias("origin"))
    spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{out}/batch=none")
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .option("checkpointLocation", f"{home}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    seen = spark.read.schema(state.schema).parquet(f"{out}/batch=*")
    return seen.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max("stay").alias("stay"), F.min("origin").alias("origin"))


def exact_groups(docs: DataFrame, state_dir: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, file, row), one row per document.

    Texts are equal when all their bytes are; null counts as empty. Of equal
    texts the row with the largest doc_id stays (null ids are the smallest). Of
    repeated rows with that doc_id exactly one is ``kept``. An empty table gives
    no rows. Should two texts share a digest, the byte check finds it and that
    digest's rows are grouped by the text itself.

    With a ``state_dir``, a shared folder used by one call at a time, the state is kept
    there and goes on with the tables of later calls: ids and sizes are judged over
    this table and all before, whose files must still stand and have the column
    ``text``. A call that failed there must be repeated over a copy of the folder as
    it was, and two texts of one digest are an error.
    """
    return _grouped(located(docs), state_dir)


def _grouped(rows: DataFrame, state_dir: str | None = None) -> DataFrame:
    spark, run = rows.sparkSession, time.time_ns()
    home = state_dir.rstrip("/") if state_dir else fresh_path(spark, "exact")
    digest = F.sha2(F.encode(text_of(), "UTF-8"), 256)
    slim = rows.select(digest.alias("digest"), "doc_id", F.lit(run).cast("long").alias("run"), "file", "row")
    slim.write.option("compression", "zstd").parquet(f"{home}/digests/{run}")
    schema = slim.schema
    slim = spark.read.schema(schema).parquet(f"{home}/digests/{run}")
    state = staged(streamed_state(spark, home, schema), "exact-groups")
    collected(spark)

    hits = state.where("group_size > 1").withColumn("salts", F.ceil(F.col("group_size") / ROWS_PER_SALT))
    place = slim.join(hits, "digest").select("digest", "file", "row", "origin", F.pmod(F.xxhash64("file", "row"), F.col("salts")).alias("salt"), "salts")
    texts = place.join(rows.select("file", "row", text_of().alias("text")), ["file", "row"])
    first = texts.where((F.col("file") == F.col("origin.file")) & (F.col("row") == F.col("origin.row"))).select("digest", "salts", "text")
    if state_dir:
        old = place.where(F.col("origin.run") != run).select("digest", "salts", F.col("origin.file").alias("file"), F.col("origin.row").alias("row")).distinct()
        files = [unquote(r.file) for r in old.select("file").distinct().collect()]  # no more than the files of all tables
        if files:
            before = spark.read.parquet(*files)
            meta = before.metadataColumn("_metadata")
            before = before.select(meta["file_path"].alias("file"), meta["row_index"].alias("row"), text_of().alias("text"))
            first = first.unionByName(old.join(before, ["file", "row"]).select("digest", "salts", "text"))
    first = first.select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("first_text"))
    differ = staged(texts.join(first, ["digest", "salt"]).where("text <> first_text").select("digest").distinct(), "exact-differ")

    found = slim.join(state, "digest")
    kept = (F.col("file") == F.col("stay.file")) & (F.col("row") == F.col("stay.row"))
    out = ("doc_id", F.col("stay.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"), "file", "row")
    if differ.isEmpty():
        return found.select(*out)
    if state_dir:
        raise ValueError("different texts share a SHA-256 digest")
    odd = rows.withColumn("digest", digest).join(differ, "digest", "left_semi").withColumn("text", text_of())
    groups = odd.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("stay"))
    return found.join(differ, "digest", "left_anti").select(*out).unionByName(odd.join(groups, ["digest", "text"]).select(*out))


def exact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    One row of each text stays, null counting as empty: that of the largest doc_id
    (null is the smallest), of its repeats the last by file and row.
    """
    where, *place = placed(docs)
    rows = where.select("doc_id", "text", F.col(place[0]).alias("file"), F.col(place[1]).alias("row"))
    kept = _grouped(rows).where("kept").select(F.col("file").alias(place[0]), F.col("row").alias(place[1]))
    return where.join(kept, place, "left_semi").drop(*place)
