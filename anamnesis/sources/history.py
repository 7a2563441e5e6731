"""Histories, event corpora and bank tables: readers that check their schema, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = {"id": "string", "source": "string", "parent_session_id": "string", "started_at": "double"}
MESSAGE = {"id": "bigint", "session_id": "string", "role": "string", "content": "string", "timestamp": "double", "active": "bigint", "compacted": "bigint"}
#: Columns that older histories lack; there they are null.
LATER = {"_compressed_summary": "bigint", "tool_calls": "string", "display_kind": "string"}
# Session sources that carry no conversation.
NOT_CONVERSATIONS = ("kanban", "subagent", "tool", "oneshot")
EVENTS = "type string, at string, seq long, session string, body string"


def checked(rows: DataFrame, wanted: dict[str, str], name: str) -> DataFrame:
    """``rows`` if it has the columns with their types; else a ValueError that names them."""
    have = dict(rows.dtypes)
    wrong = [f"{c} {t}" for c, t in wanted.items() if have.get(c) != t]
    if wrong:
        raise ValueError(f"{name} needs {', '.join(wrong)}")
    return rows


def read_history(spark: SparkSession, sessions: str, messages: str, form: str = "parquet", **options: str) -> tuple[DataFrame, DataFrame]:
    """The sessions and messages of a history, with checked columns.

    ``form`` is parquet, json (one object a line) or jdbc, where both are names of
    tables and ``options`` say how to connect.
    """

    def one(place: str, wanted: dict[str, str], name: str) -> DataFrame:
        if form == "json":
            # columns that no line holds must fail as in the other forms
            found = spark.read.json(place)
            typed = [F.col(c).cast(t).alias(c) for c, t in wanted.items() if c in found.columns]
            typed += [F.col(c).cast(t).alias(c) for c, t in LATER.items() if c in found.columns and wanted is MESSAGE]
            return checked(found.select(*typed), wanted, name)
        rows = spark.read.format("jdbc").options(**options).option("dbtable", place).load() if form == "jdbc" else spark.read.parquet(place)
        return checked(rows, wanted, name)

    rows = one(messages, MESSAGE, "messages")
    rows = checked(rows.withColumns({c: F.lit(None).cast(t) for c, t in LATER.items() if c not in rows.columns}), LATER, "messages")
    return one(sessions, SESSION, "sessions"), rows


def select_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions of their own that hold conversations, with their class."""
    kept = sessions.where(F.col("parent_session_id").isNull() & ~F.coalesce(F.col("source").isin(*NOT_CONVERSATIONS), F.lit(False)))
    return kept.withColumn("class", F.when(F.col("source") == "cron", "cron").otherwise("primary"))


def active_messages(messages: DataFrame) -> DataFrame:
    """Messages that are part of their session; its order is that of (timestamp, id)."""
    return messages.where("active = 1 OR compacted = 1")


def write_corpus(events: DataFrame, path: str) -> None:
    """Events in time order as JSON lines, split over files in that order."""
    events.orderBy("at", "seq").write.mode("errorifexists").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(path)


def write_bank_table(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet in folders of banks; a bank's rows go to one folder, each task writes its own files there."""
    rows.withColumn("bank_bucket", F.pmod(F.xxhash64("bank_id"), F.lit(buckets))).write.partitionBy("bank_bucket").mode("errorifexists").parquet(path)


def read_bank_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bank_bucket")
