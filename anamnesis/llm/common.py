"""What the training-data operators share: the shared folder, staging, tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
#: Numbers of files up to this many are broadcast; more are joined as any table.
FILES_BROADCAST = 100_000
#: Rows that a file may have.
ROWS_PER_FILE = 1 << 36


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; a folder of our own is made
    only where that is unset and Spark runs on this machine alone, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="anamnesis-"))
    return _OWN_DIR[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/anamnesis/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs only the tasks it ran; the
    files outlive executors.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame, collect: bool = False) -> None:
    """Delete the files of staged tables that nothing reads any more.

    With ``collect`` the driver also collects its garbage, so that Spark's cleaner
    removes the shuffle files of plans that only served to write staged tables;
    else they stay on the executors' disks until the driver happens to collect.
    """
    for df in tables:
        jvm, path = df.sparkSession._jvm, df.__dict__.get("staged_at")
        if path:
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if collect and tables:
        collected(tables[0].sparkSession)


def collected(spark: SparkSession) -> None:
    """Have the driver collect its garbage: plans, compiled code and shuffle files that nothing uses any more."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, row): rows of files as they are, others written first.

    File and row tell rows apart whatever their columns hold, and are the same
    each time a task runs.
    """
    rows, file, row = placed(docs)
    return rows.select("doc_id", "text", F.col(file).alias("file"), F.col(row).alias("row"))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores after it as it takes to be no column's name."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def placed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with each row's file and row number in two more columns, and these columns' names.

    For tables of any columns, one named _metadata too; rows that are not those of
    files as they are get written first.
    """
    file, row = free_names(docs.columns, "_file", "_row")
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select("*", meta["file_path"].alias(file), meta["row_index"].alias(row)), file, row
    except AnalysisException:
        return placed(staged(docs, "input"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows(file, row, ...)`` with an ``id`` of their own: the file's number and the row, no hash.

    The files are numbered in one task: they are no more than those that the driver
    lists to plan the scan.
    """
    files = rows.select("file").distinct().select("file", F.row_number().over(Window.orderBy("file")).cast("long").alias("no"))
    files = staged(files, "files")
    if files.count() <= FILES_BROADCAST:
        files = F.broadcast(files)
    return rows.join(files, "file").withColumn("id", F.col("no") * ROWS_PER_FILE + F.col("row")).drop("no")


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """Enough partitions for ``rows``, at least the session's shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_partition), 1)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges(a, b)``.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder. Only the test whether anything changed comes to the driver.
    Nodes without edges are not listed.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = previous = staged(both, f"{name}-edges")
    before = None
    while True:
        # large star: every larger neighbour of u (and u) is tied to u's least neighbour
        sym = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every smaller neighbour of u (and u) is tied to the least of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = staged(small.union(m.select("u", F.col("m").alias("v"))).distinct(), f"{name}-stars")
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        discard(previous, collect=state == before)
        if state == before:
            break
        before, previous = state, current
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        current.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))
