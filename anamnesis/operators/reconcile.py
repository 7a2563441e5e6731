"""Claims against stored memories: neighbours, the plan that labels make, and the edits that follow."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.operators import cells as N
from anamnesis.operators import recall as R
from anamnesis.operators import strength as S

# Fixed values of reconciliation.
PER_CLAIM, PER_CHUNK, GAP = 10, 40, 2
LEVELS = {"trivial": 0, "minor": 1, "notable": 2, "major": 3, "critical": 4, "kept": 5}
TASKS = ("task", "recurring")
#: A time after all others; the cosine of a pair that has none, below all others.
LAST, NO_COSINE = (1 << 63) - 1, -3.0
REPEATS, CHANGES = ("mentioned_again", "confirmed"), ("ends", "retracts", "denies", "refines")


def claim_neighbours(claims: DataFrame, memories: DataFrame, vectors: DataFrame, heads: DataFrame, floor: float, per_arm: int = 40, most: int = PER_CLAIM) -> DataFrame:
    """(claim_id, memory_id, similarity, rank): the ten stored heads nearest to each claim by vector and by words, fused.

    ``claims(claim_id, bank_id, content, embedding, flagged)``. Versions count as their chain's
    head before anything is cut, so a memory of a thousand versions takes one of an arm's
    ``per_arm`` places. Retracted heads are out, faded, ended and hidden ones stay. Claims that
    flag no change take vector hits of at least ``floor`` only.
    """
    asked = claims.select(F.col("claim_id").alias("query_id"), "bank_id", F.col("content").alias("query"), "embedding")
    up = heads.join(memories.where("NOT retracted").select(F.col("memory_id").alias("head_id")), "head_id", "left_semi")
    near = R.vector_top_k(vectors.join(up, "memory_id"), asked, per_arm, by="head_id")
    near = near.join(claims.select(F.col("claim_id").alias("query_id"), "flagged"), "query_id").where(F.col("flagged") | (F.col("score") >= floor))
    said = R.bm25_best(memories, asked, up, per_arm)
    arms = near.select("query_id", "memory_id", "rank", F.col("score").alias("similarity")).unionByName(said.select("query_id", "memory_id", "rank", F.lit(None).cast("double").alias("similarity")))
    fused = R.rrf_fuse(arms, F.max("similarity").alias("similarity"))
    return fused.where(F.col("rank") <= most).select(F.col("query_id").alias("claim_id"), "memory_id", "similarity", "rank")


def linked_open(claims: DataFrame, claim_entities: DataFrame, links: DataFrame, memories: DataFrame, vectors: DataFrame, most: int = PER_CLAIM, claims_per_block: int = 2_000, rows_per_block: int = 20_000) -> DataFrame:
    """(claim_id, memory_id, rank): for claims that flag a change, open tasks and states of an entity they name.

    Only heads that stand and had not ended when the claim was said; by cosine,
    those without a vector last, then newer, then the lower id. An entity's claims and
    memories meet in blocks that give each claim's best ``most``, so no row is made per pair.
    """
    key = ["bank_id", "entity_id"]
    whole = F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding"))
    said = F.coalesce(S.micros(F.col("observed_at").cast("timestamp")), F.lit(LAST - 1))
    flagged = claims.where("flagged").select("claim_id", "bank_id", said.alias("said"), whole.alias("asked"))
    asked = flagged.join(claim_entities.select("claim_id", "entity_id").distinct(), "claim_id")
    open_ = memories.where("kind IN ('task', 'state') AND NOT retracted AND NOT hidden AND superseded_by IS NULL")
    end = S.unit_end(F.col("valid_until").cast("timestamp"), S._column(memories, "valid_until_precision", "day"), S._column(memories, "timezone", "UTC"))
    open_ = open_.select("memory_id", F.coalesce(S.micros(F.col("observed_at").cast("timestamp")), F.lit(-LAST)).alias("observed"), F.coalesce(S.micros(end), F.lit(LAST)).alias("end"))
    held = links.select("memory_id", *key).distinct().join(open_, "memory_id").join(vectors.select("memory_id", whole.alias("embedding")), "memory_id", "left")
    parts = asked.groupBy(*key).agg(F.ceil(F.count("*") / claims_per_block).alias("_parts"))
    blocks = held.groupBy(*key).agg(F.ceil(F.count("*") / rows_per_block).alias("_blocks"))
    sizes = parts.join(blocks, key)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, key).select(*key, F.pmod(F.xxhash64("claim_id"), "_parts").alias("_part"), each("_blocks").alias("_block"), "claim_id", "said", "asked")
    right = held.join(sizes, key).select(*[F.col(c).alias(f"_{c}") for c in key], each("_parts").alias("_of"), F.pmod(F.xxhash64("memory_id"), "_blocks").alias("_at"), "memory_id", "observed", "end", "embedding")

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        claim, memory, near, seen = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
        if one.num_rows and two.num_rows:
            two = two.sort_by([("observed", "descending"), ("memory_id", "ascending")])
            ids, observed, ends, said = (t[c].to_numpy() for t, c in ((two, "memory_id"), (two, "observed"), (two, "end"), (one, "said")))
            v, q = two["embedding"].combine_chunks(), one["asked"].combine_chunks()
            for a in range(0, len(q), 256):
                score = _cosines(q[a : a + 256], v)
                score[ends[None, :] <= said[a : a + 256, None]] = -np.inf
                row, col = _best(score, most)
                claim.append(one["claim_id"].to_numpy()[a + row])
                memory.append(ids[col])
                near.append(score[row, col])
                seen.append(observed[col])
        return pa.table([np.concatenate(x) for x in (claim, memory, near, seen)], names=["claim_id", "memory_id", "near", "observed"])

    found = left.groupBy(*key, "_part", "_block").cogroup(right.groupBy("_bank_id", "_entity_id", "_of", "_at")).applyInArrow(run, "claim_id long, memory_id long, near double, observed long")
    found = found.groupBy("claim_id", "memory_id").agg(F.max("near").alias("near"), F.max("observed").alias("observed"))
    order = W.partitionBy("claim_id").orderBy(F.desc("near"), F.desc("observed"), "memory_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("claim_id", "memory_id", "rank")


def _cosines(one: pa.ListArray, two: pa.ListArray) -> np.ndarray:
    """Cosines of all pairs, rounded to nine digits; NaN is above all, pairs that have none are at NO_COSINE."""
    out = np.full((len(one), len(two)), NO_COSINE)
    sizes = [np.array([-1 if n is None else n for n in x.value_lengths().to_pylist()], np.int64) for x in (one, two)]
    for n in np.intersect1d(*sizes):
        if n < 1:
            continue
        at = [np.flatnonzero(s == n) for s in sizes]
        a, b = (x.take(pa.array(k)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n) for x, k in zip((one, two), at, strict=True))
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            cos = np.round((a @ b.T) / norm, 9)
        out[np.ix_(*at)] = np.where(norm == 0, NO_COSINE, np.where(np.isnan(cos), np.inf, cos))
    return out


def _best(score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``most`` largest scores above -inf; of equal ones the first columns."""
    live = score > -np.inf
    if score.shape[1] > most:
        live &= score >= np.partition(score, -most, axis=1)[:, [-most]]
    row, col = np.nonzero(live)
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < most], col[place < most]


def neighbour_lists(fused: DataFrame, open_: DataFrame, claims: DataFrame, most: int = PER_CHUNK) -> DataFrame:
    """(chunk_id, memory_id, position): fused and open neighbours in turns by rank, each once, a chunk's best forty over its claims.

    ``claims(claim_id, chunk_id, ordinal)``.
    """
    both = fused.select("claim_id", "memory_id", "rank", F.lit(0).alias("list")).unionByName(open_.select("claim_id", "memory_id", "rank", F.lit(1).alias("list")))
    best = both.join(claims.select("claim_id", "chunk_id", "ordinal"), "claim_id").groupBy("chunk_id", "memory_id").agg(F.min(F.struct("rank", "list", "ordinal")).alias("at"))
    order = W.partitionBy("chunk_id").orderBy("at.rank", "at.list", "at.ordinal", "memory_id")
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("chunk_id", "memory_id", "position")


def needs_review(claims: DataFrame, neighbours: DataFrame, floor: float) -> DataFrame:
    """(chunk_id, review): whether labels are wanted: it has neighbours and a claim that flags a change, or one near enough to a memory.

    ``claims(claim_id, chunk_id, flagged)``, ``neighbours(claim_id, memory_id, similarity)``.
    """
    near = neighbours.groupBy("claim_id").agg(F.coalesce(F.max("similarity"), F.lit(float("-inf"))).alias("near"), F.count("*").alias("n"))
    rows = claims.join(near, "claim_id", "left")
    wanted = F.bool_or(F.col("flagged") | (F.coalesce("near", F.lit(float("-inf"))) >= floor)) & (F.coalesce(F.sum("n"), F.lit(0)) > 0)
    return rows.groupBy("chunk_id").agg(wanted.alias("review"))


def end_at(valid_from: Column, observed: Column, timezone: Column) -> tuple[Column, Column]:
    """(end, uncertain): the ending memory's start, else local midnight of the day it was said."""
    day = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(observed, timezone)), timezone)
    return F.coalesce(valid_from, day), valid_from.isNull()


def compatible(a: str, b: str) -> bool:
    return a == b or (a in TASKS and b == "task")


def plan_chunk(rows: list[dict], gap: int = GAP, kind_guard: bool = True) -> list[dict]:
    """What the labels of one chunk come to: a list of (ordinal, action, memory_id, detail).

    ``rows`` has one dict per claim and label, in the order of claims and then of
    labels; claims without labels have one with memory_id None. State carries over:
    a memory that one claim retracted is no neighbour of the next.
    """
    ended: dict[int, bool] = {}
    gone: set[int] = set()
    accesses: dict[int, str] = {}
    raises: dict[int, int] = {}
    out: list[dict] = []

    def say(ordinal: int, action: str, memory: int | None = None, detail: str | None = None) -> None:
        out.append({"ordinal": ordinal, "action": action, "memory_id": memory, "detail": detail})

    claims: dict[int, list[dict]] = {}
    for r in rows:
        claims.setdefault(r["ordinal"], []).append(r)
    for ordinal, labels in claims.items():
        changed = nothing = False
        older_end: int | None = None
        mentions: list[tuple[dict, str]] = []
        repeats: list[tuple[dict, str, str]] = []
        for r in labels:
            m, label = r["memory_id"], r["label"]
            if m is None or label is None or m in gone:
                continue
            over = ended.setdefault(m, bool(r["n_ended"]))
            newer = bool(r["newer"])
            repeat = newer and label in REPEATS
            dated = repeat and bool(r["new_date"])
            base = LEVELS[r["n_significance"]] if not r["n_owner"] else max(LEVELS[r["n_significance"]], LEVELS[r["n_owner"]])
            heavier = repeat and not dated and r["n_owner"] != "kept" and LEVELS[r["significance"]] >= base + gap
            cause = "date" if dated else "weight" if heavier else "explicit" if label == "refines" else None
            called, label = label, "refines" if dated or heavier else label
            if newer and r["n_kind"] == "task" and not over and label in ("retracts", "refines") and r["kind"] not in TASKS:
                continue
            if cause and not over and not compatible(r["kind"], r["n_kind"]):
                say(ordinal, "mismatch", m, f"{cause}{'' if newer else ':older'}{':rejected' if kind_guard else ''}")
                if kind_guard:
                    continue
            if label in REPEATS:
                if newer and over:
                    continue
                mentions.append((r, label))
                if newer:
                    repeats.append((r, called, label))
            elif over:
                continue
            elif newer:
                say(ordinal, label, m, "promoted" if heavier else None)
                changed = True
                if label == "ends":
                    ended[m] = True
                else:
                    gone.add(m)
            elif label == "ends":
                older_end = m if older_end is None else older_end
            else:
                nothing = True
                say(ordinal, "passage", m)
        for r, label in mentions:
            m = r["memory_id"]
            say(ordinal, "passage", m)
            if r["same_document"]:
                continue
            if accesses.get(m) != "confirmed":
                accesses[m] = label
            if label == "mentioned_again" and not r["n_owner"] and LEVELS[r["significance"]] > LEVELS[r["n_significance"]]:
                raises[m] = max(raises.get(m, 0), LEVELS[r["significance"]])
        fate = "new" if changed else "absorbed" if nothing else "new_ended" if older_end is not None else "absorbed" if mentions else "new"
        say(ordinal, f"fate:{fate}", older_end if fate == "new_ended" else None)
        if fate == "absorbed":
            if labels[0]["kept"]:
                for m in dict.fromkeys(r["memory_id"] for r, _ in mentions):
                    say(ordinal, "keep", m)
            for r, called, label in repeats:
                if not r["same_document"]:
                    say(ordinal, "restatement", r["memory_id"], f"{called}:{label}")
    names = {v: k for k, v in LEVELS.items()}
    for m, label in accesses.items():
        say(-1, f"access:{label}", m)
    for m, level in raises.items():
        say(-1, "raise", m, names[level])
    return out


def plan_reconcile(claims: DataFrame, labels: DataFrame, neighbours: DataFrame, gap: int = GAP, kind_guard: bool = True) -> DataFrame:
    """(chunk_id, seq, ordinal, action, memory_id, detail): the plan that each chunk's labels make.

    ``claims(chunk_id, ordinal, kind, significance, kept, observed_at, ingested_at,
    source_id, document_id, valid_from, valid_until, due_at)``, ``labels(chunk_id,
    ordinal, memory_id, label)``, ``neighbours(memory_id, kind, significance,
    owner_significance, ended, observed_at, ingested_at, source_id, document_id,
    valid_from, valid_until, due_at)``. A chunk has at most forty neighbours and its
    labels are the unit of the fold. ``ordinal`` is -1 where a line is the chunk's.
    """
    stored = neighbours.select("memory_id", *[F.col(c).alias(f"n_{c}") for c in neighbours.columns if c != "memory_id"])
    rows = claims.join(labels, ["chunk_id", "ordinal"], "left").join(stored, "memory_id", "left")
    key = lambda p: F.struct(F.col(f"{p}observed_at").alias("a"), F.col(f"{p}ingested_at").alias("b"), F.col(f"{p}source_id").alias("c"))
    date = F.lit(False)
    for c in ("valid_from", "valid_until", "due_at"):
        date |= F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
    same = F.coalesce(F.col("document_id") == F.col("n_document_id"), F.lit(False))
    rows = rows.select(
        "chunk_id", "ordinal", "memory_id", "label", "kind", "significance", "kept", "n_kind", "n_significance", F.col("n_owner_significance").alias("n_owner"), F.coalesce("n_ended", F.lit(False)).alias("n_ended"),
        F.coalesce(key("") >= key("n_"), F.lit(False)).alias("newer"), date.alias("new_date"), same.alias("same_document"),
    )

    def run(key: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(["ordinal", "memory_id"], na_position="last").astype(object)
        chunk = chunk.where(chunk.notna(), None)
        found = pd.DataFrame(plan_chunk(chunk.to_dict("records"), gap, kind_guard), columns=["ordinal", "action", "memory_id", "detail"])
        found.insert(0, "seq", range(len(found)))
        found.insert(0, "chunk_id", key[0])
        return found.astype({"memory_id": "Int64"})

    return rows.groupBy("chunk_id").applyInPandas(run, "chunk_id long, seq int, ordinal int, action string, memory_id long, detail string")


def new_memories(plan: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, accesses): claims whose fate is new become rows with an id of their own and one ``created`` access.

    The id is a hash of source, chunk and place, so a job that runs again makes
    the same. A claim that promoted a repeat of its kind, or retracted, without
    naming dates takes over the first such neighbour's whole window, given as
    ``w_valid_from``, ``w_valid_until`` and ``w_due_at`` of the claim's row.
    """
    fates = plan.where(F.col("action").isin("fate:new", "fate:new_ended")).select("chunk_id", "ordinal", F.when(F.col("action") == "fate:new_ended", F.col("memory_id")).alias("ended_by"))
    rows = claims.join(fates, ["chunk_id", "ordinal"]).withColumn("memory_id", F.xxhash64("source_id", "chunk_id", "ordinal"))
    undated = F.col("valid_from").isNull() & F.col("valid_until").isNull() & F.col("due_at").isNull()
    for c in ("valid_from", "valid_until", "due_at"):
        if f"w_{c}" in claims.columns:
            rows = rows.withColumn(f"_{c}", F.when(undated, F.col(f"w_{c}")).otherwise(F.col(c)))
    taken = [c for c in ("valid_from", "valid_until", "due_at") if f"w_{c}" in claims.columns]
    rows = rows.drop(*taken, *[f"w_{c}" for c in taken]).withColumnsRenamed({f"_{c}": c for c in taken})
    return rows, rows.select("memory_id", F.lit("created").alias("kind"), F.col("observed_at").alias("accessed_at"), "source_id")


def restatements(plan: DataFrame, claims: DataFrame) -> DataFrame:
    """(memory_id, chunk_id, ordinal, label, outcome, start, end): what absorbed claims said, kept on the memories they are credited to, each once."""
    rows = plan.where("action = 'restatement'").join(claims.select("chunk_id", "ordinal", "start", "end"), ["chunk_id", "ordinal"])
    return rows.select("memory_id", "chunk_id", "ordinal", F.split("detail", ":")[0].alias("label"), F.split("detail", ":")[1].alias("outcome"), "start", "end").dropDuplicates(["memory_id", "chunk_id", "ordinal"])


def apply_edits(memories: DataFrame, edits: DataFrame) -> DataFrame:
    """``memories`` after ``edits(memory_id, action, by_id, by_observed_at, by_valid_from, timezone)``, at most one supersession and one end per memory.

    ``ends`` sets valid_until and ended_by: a task ends when it was said, anything
    else where the ending memory starts, or uncertainly on the day it was said.
    ``retracts`` and ``denies`` retract and supersede, ``refines`` supersedes. Ends
    that pointed at a superseded memory point at its successor, and are taken back
    after a denial. A successor of a hidden memory is hidden.
    """
    ends = edits.where("action = 'ends'").groupBy("memory_id").agg(F.min_by(F.struct("by_id", "by_observed_at", "by_valid_from", "timezone"), "by_id").alias("e"))
    over = edits.where("action IN ('retracts', 'denies', 'refines')").groupBy("memory_id").agg(F.min_by(F.struct("by_id", "action", "by_observed_at"), "by_id").alias("o"))
    until, guessed = end_at(F.col("e.by_valid_from").cast("timestamp"), F.col("e.by_observed_at").cast("timestamp"), F.col("e.timezone"))
    task = F.col("kind") == "task"
    rows = memories.join(ends, "memory_id", "left").join(over, "memory_id", "left")
    hit = F.col("e").isNotNull()
    rows = rows.withColumns({
        "_until": F.when(hit, F.when(task, F.date_trunc("minute", F.col("e.by_observed_at").cast("timestamp"))).otherwise(until)).otherwise(F.col("valid_until").cast("timestamp")),
        "_ended_by": F.coalesce("e.by_id", "ended_by"),
        "_low": F.col("low_confidence") | F.coalesce(hit & ~task & guessed, F.lit(False)),
        "_superseded": F.coalesce("o.by_id", "superseded_by"),
        "_retracted": F.col("retracted") | F.coalesce(F.col("o.action").isin("retracts", "denies"), F.lit(False)),
    })
    moved = over.select(F.col("memory_id").alias("_ended_by"), F.col("o.by_id").alias("_next"), (F.col("o.action") == "denies").alias("_denied"))
    rows = rows.join(moved, "_ended_by", "left")
    back = F.coalesce("_denied", F.lit(False))
    hides = edits.where("action <> 'ends'").join(memories.where("hidden").select("memory_id"), "memory_id").select(F.col("by_id").alias("memory_id"), F.lit(True).alias("_hide")).distinct()
    rows = rows.join(hides, "memory_id", "left")
    new = {
        "valid_until": F.when(~back, F.col("_until")), "ended_by": F.when(~back, F.coalesce("_next", "_ended_by")), "low_confidence": F.col("_low"),
        "superseded_by": F.col("_superseded"), "retracted": F.col("_retracted"), "hidden": F.col("hidden") | F.coalesce("_hide", F.lit(False)),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in memories.columns])


def re_mentioned_rate(created: DataFrame, purged: DataFrame, floor: float) -> DataFrame:
    """(bank_id, purged, re_mentioned, rate): memories of a bank made after one as near as ``floor`` was purged, to all that were purged.

    ``created(memory_id, bank_id, embedding, created_at)``, ``purged(memory_id, bank_id, embedding, purged_at)``.
    Each created memory counts once however many it is near to. The rate is 0 where nothing was purged.
    """
    gone = N.cells(purged.select("memory_id", "bank_id", "embedding", F.col("purged_at").alias("at")))
    asked = created.select(F.col("memory_id").alias("query_id"), "bank_id", "embedding", F.col("created_at").alias("at"))
    again = asked.join(N.any_before(gone, asked, floor), "query_id", "left_semi").groupBy("bank_id").agg(F.count("*").alias("re_mentioned"))
    banks = purged.groupBy("bank_id").agg(F.count("*").alias("purged")).join(created.select("bank_id").distinct(), "bank_id", "full").join(again, "bank_id", "left").fillna(0, ["purged", "re_mentioned"])
    return banks.select("bank_id", "purged", "re_mentioned", F.coalesce(F.try_divide("re_mentioned", "purged"), F.lit(0.0)).alias("rate"))
