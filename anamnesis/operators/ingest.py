"""Message parts, speakers, flags, counts, earlier turns and checked claims of an ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The mark before content in parts, and how much of a conversation a query takes.
PARTS = "\u0000json:"
CONTEXT_CHARS, EARLIER_TURNS, EARLIER_CHARS, BEFORE_CHARS = 300, 3, 6_000, 400
#: White space as DuckDB has it: without Java's vertical tab. ``$`` would also match before a last line break, ``\\z`` does not.
SPACE = r"[ \t\n\f\r]"
# The fields that a claim of a kind may have.
DATED = {"event": ("valid_from", "valid_until"), "state": ("valid_from", "valid_until"), "fact": ("valid_from", "valid_until"), "task": ("due_at",), "recurring": ("valid_from", "valid_until")}


def plain_text(content: Column) -> tuple[Column, Column]:
    """(text, images dropped): content in parts gives its text parts, a line each; other content is text as it is."""
    parts = F.from_json(F.substr(content, F.lit(len(PARTS) + 1)), "array<struct<type:string,text:string>>")
    said = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
    marked = content.startswith(PARTS) & parts.isNotNull()
    images = F.size(F.filter(parts, lambda p: p["type"].isin("image", "image_url", "input_image")))
    return F.when(marked, said).otherwise(content), F.when(marked, images).otherwise(0)


def speaker_prefix(text: Column) -> Column:
    """The name in brackets at the start of a line of talk, null without one; the text keeps it."""
    return F.nullif(F.regexp_extract(text, r"^\[([^\]\n]+)\] ", 1), F.lit(""))


def cut_back(text: Column, most: int = CONTEXT_CHARS) -> Column:
    """At most so many characters, a longer text cut back to its last white space, also where the cut falls right behind a line break."""
    head = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.when(head.rlike(SPACE), F.regexp_replace(head, rf"{SPACE}+[^ \t\n\f\r]*\z", "")).otherwise(head))


def conversation_query(message: Column, previous: Column, reply: Column) -> Column:
    """The message and the beginnings of what was said before it, a line each, empty ones left out."""
    return F.array_join(F.filter(F.array(message, cut_back(previous), cut_back(reply)), lambda t: t.isNotNull() & (t != "")), "\n")


def turn_chunk(user: Column, reply: Column, separator: str = "\n\n") -> Column:
    """A turn's one chunk: what the user said and the reply."""
    return F.concat_ws(separator, user, F.nullif(reply, F.lit("")))


def turn_flags(messages: DataFrame) -> DataFrame:
    """(session_id, turn_no, human, forget_requested, prefetch_only) of ``messages(session_id, turn_no, role, display_kind, tool_calls)``.

    A user's row that is shown as anything but a steer is not human; a reply that
    calls ``memory_forget`` asks to forget; a turn that is not human is only looked up.
    """
    calls = F.from_json("tool_calls", "array<struct<function:struct<name:string>,name:string>>")
    forgets = F.coalesce(F.exists(calls, lambda c: F.coalesce(c["function"]["name"], c["name"]) == "memory_forget"), F.lit(False))
    human = (F.col("role") == "user") & (F.col("display_kind").isNull() | (F.col("display_kind") == "steer"))
    rows = messages.groupBy("session_id", "turn_no").agg(F.bool_or(human).alias("human"), F.bool_or((F.col("role") == "assistant") & forgets).alias("forget_requested"))
    return rows.withColumn("prefetch_only", ~F.col("human"))


def import_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(counter, n): what an import takes and what it skips, by kind."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    nested = F.col("parent_session_id").isNotNull()
    a = sessions.agg(n(nested).alias("nested_sessions"), n(~nested & F.coalesce(F.col("source").isin("kanban", "subagent", "tool", "oneshot"), F.lit(False))).alias("other_sessions"), F.count("*").alias("sessions"))
    live = (F.coalesce("active", F.lit(0)) == 1) | (F.coalesce("compacted", F.lit(0)) == 1)
    b = messages.agg(n(~live).alias("inactive_rows"), *[n(live & (F.col("role") == r)).alias(f"{r}_rows") for r in ("user", "assistant", "tool", "system")], n(live & ~F.col("role").isin("user", "assistant", "tool", "system")).alias("other_rows"))
    flat = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("long") for c in df.columns]))).alias("counter", "n"))
    return flat(a).unionByName(flat(b)).withColumn("n", F.coalesce("n", F.lit(0)))


def resolve_speakers(turns: DataFrame, speaker_ids: DataFrame, survivors: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with speaker_entity, new persons): authors by platform id only, through merges; none is the bank's seeded user.

    ``turns(bank_id, author, author_name)``, ``speaker_ids(bank_id, platform_id,
    entity_id)``, ``survivors(entity_id, survivor_id)``, ``users(bank_id,
    entity_id)``. An unknown author's entity is null; it is a new person with the
    names it was called by as aliases.
    """
    known = speaker_ids.join(survivors, "entity_id").select("bank_id", F.col("platform_id").alias("author"), "survivor_id")
    seeded = users.select("bank_id", F.col("entity_id").alias("_user"))
    rows = turns.join(known, ["bank_id", "author"], "left").join(seeded, "bank_id", "left")
    rows = rows.withColumn("speaker_entity", F.when(F.col("author").isNull(), F.col("_user")).otherwise(F.col("survivor_id"))).drop("_user", "survivor_id")
    new = turns.where("author IS NOT NULL").join(known, ["bank_id", "author"], "left_anti").groupBy("bank_id", "author").agg(F.array_sort(F.collect_set("author_name")).alias("aliases"))
    return rows, new


def earlier_turns(turns: DataFrame, most: int = EARLIER_TURNS, chars: int = EARLIER_CHARS) -> DataFrame:
    """(source_id, position, earlier_id, text): up to three turns before each in its session that still hold text, the oldest first.

    ``turns(session_id, source_id, text, masked)``. Together they have at most
    ``chars`` characters: the newest are whole, the one that would pass the limit
    keeps its end, and older ones are left out.
    """
    own = W.partitionBy("session_id").orderBy("source_id")
    usable = F.col("text").isNotNull() & (F.col("text") != "") & ~F.col("masked")
    # the last usable turns before a row, however many unusable ones stand between
    marks = turns.withColumn("_k", F.sum(F.when(usable, 1).otherwise(0)).over(own.rowsBetween(W.unboundedPreceding, 0)) - F.when(usable, 1).otherwise(0))
    said = marks.where(usable).select("session_id", (F.col("_k") + 1).alias("_n"), F.col("source_id").alias("earlier_id"), "text")
    steps = marks.select("session_id", "source_id", "_k", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("back")).withColumn("_n", F.col("_k") + 1 - F.col("back"))
    rows = steps.join(said, ["session_id", "_n"])
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("source_id").orderBy("back").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_left", F.lit(chars) - before).where("_left > 0")
    rows = rows.withColumn("text", F.when(F.length("text") <= F.col("_left"), F.col("text")).otherwise(F.substr("text", (F.length("text") - F.col("_left") + 1).cast("int"))))
    return rows.withColumn("position", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("back")))).select("source_id", "position", "earlier_id", "text")


def link_forgets(requests: DataFrame, turns: DataFrame) -> DataFrame:
    """(request_id, source_id): a request to forget is answered by the first turn of its session after the one it names.

    ``requests(request_id, bank_id, session_id, after)``; ``after`` null stands
    for the session's beginning. As-of by the turn before: one equi join.
    """
    own = W.partitionBy("bank_id", "session_id").orderBy("source_id")
    rows = turns.select("bank_id", "session_id", "source_id", F.lag("source_id").over(own).alias("after"))
    same = requests["after"].eqNullSafe(rows["after"]) & (requests["bank_id"] == rows["bank_id"]) & requests["session_id"].eqNullSafe(rows["session_id"])
    return requests.join(rows, same).select("request_id", "source_id")


def text_before(chunks: DataFrame, versions: DataFrame, most: int = BEFORE_CHARS) -> DataFrame:
    """(version_id, position, before): up to 400 characters of the document before each chunk.

    ``chunks(version_id, position, start, end, masked)``, ``versions(version_id,
    text)``. It goes back over chunks of the same version that touch each other;
    nothing is given where one of them is masked.
    """
    own = W.partitionBy("version_id").orderBy("position")
    apart = F.coalesce(F.lag("end").over(own) < F.col("start"), F.lit(True))
    rows = chunks.withColumn("_run", F.sum(F.when(apart, 1).otherwise(0)).over(own.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("version_id", "_run").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    first, hidden = F.min("start").over(run), F.bool_or("masked").over(run)
    rows = rows.withColumn("_from", F.when(first.isNotNull(), F.greatest(first, F.col("start") - most))).withColumn("_hidden", hidden).join(versions, "version_id")
    size = (F.col("start") - F.col("_from")).cast("int")
    before = F.when(F.col("_hidden") | F.col("_from").isNull(), "").otherwise(F.substr("text", (F.col("_from") + 1).cast("int"), size))
    return rows.select("version_id", "position", before.alias("before"))


def check_claims(claims: DataFrame) -> DataFrame:
    """Claims that stand, with quote_start, quote_end, valid_from, low_confidence and kept; ``reason`` tells why others fall.

    ``claims(content, quote, text, kind, by_assistant, remember_this, own_message,
    valid_from, valid_until, due_at, observed_at, timezone, low_confidence)``. A
    claim falls if its content is empty, its quote is not in the text, or it is an
    assistant's task without a date. The span is the quote's first occurrence, in
    characters. Dates that its kind has not are dropped; an event without a start
    has the local midnight of the day it was said, uncertainly. A weekday that the
    quote names and no date falls on makes the dates uncertain. Only what the
    owner says is kept for good.
    """
    at = F.instr(F.col("text"), F.col("quote"))
    reason = (
        F.when(F.trim("content") == "", "empty").when((at == 0) | (F.col("quote") == ""), "quote_not_found")
        .when((F.col("kind") == "task") & F.col("by_assistant") & F.col("due_at").isNull(), "undated_assistant_task")
    )
    may = lambda c: F.when(F.col("kind").isin(*[k for k, fields in DATED.items() if c in fields]), F.col(c))
    local = F.from_utc_timestamp("observed_at", F.col("timezone"))
    guessed = (F.col("kind") == "event") & F.col("valid_from").isNull()
    start = F.when(guessed, F.to_utc_timestamp(F.date_trunc("day", local), F.col("timezone"))).otherwise(may("valid_from"))
    rows = claims.select("*", reason.alias("reason"), (at - 1).alias("quote_start"), (at - 1 + F.length("quote")).alias("quote_end"))
    rows = rows.withColumns({"_start": start, "_until": may("valid_until"), "_due": may("due_at")})
    day = F.lower(F.regexp_extract("quote", r"(?i)\b(mon|tues|wednes|thurs|fri|satur|sun)day\b", 0))
    falls = lambda c: F.coalesce(F.lower(F.date_format(F.from_utc_timestamp(F.col(c), F.col("timezone")), "EEEE")) == day, F.lit(False))
    some = F.col("_start").isNotNull() | F.col("_until").isNotNull() | F.col("_due").isNotNull()
    odd = (day != "") & some & ~(falls("_start") | falls("_until") | falls("_due"))
    rows = rows.withColumn("low_confidence", F.col("low_confidence") | guessed | odd).withColumn("kept", F.col("remember_this") & F.col("own_message"))
    return rows.drop("valid_from", "valid_until", "due_at").withColumnsRenamed({"_start": "valid_from", "_until": "valid_until", "_due": "due_at"})
