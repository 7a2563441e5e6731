"""Exact nearest neighbours over vectors in cells, without a scan of all vectors.

Some vectors of a bank, chosen by hash, are pivots; every vector lies in the cell of the pivot
at the smallest angle. By the triangle inequality of angles nothing in a cell is
nearer to a query than the query's angle to the pivot less the cell's largest angle, or
the cell's smallest angle less that of the query. A search scores the cells that
look nearest until they hold k vectors, and then only those other cells whose bound does not
exceed the k-th angle found: the answer is that of a full scan.

The cells are a table that can be kept (``write_cells``, ``read_cells``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.operators import recall as R

#: What rounding may move an angle.
SLACK = 1e-6
FINITE = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x))"


@dataclass(frozen=True)
class Cells:
    """``members(bank_id, cell, memory_id, angle, embedding, ...)`` and ``centres(bank_id, cell, n, low, high, pivot)``.

    Vectors of length zero have no angle; they lie in a cell without a pivot, which every search scores.
    """

    members: DataFrame
    centres: DataFrame


def unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def cells(vectors: DataFrame, per_cell: int = 1_000, most: int = 1_024, rows_per_block: int = 50_000) -> Cells:
    """The cells of ``vectors(memory_id, bank_id, embedding, ...)``: about one per ``per_cell`` vectors, about ``most`` a bank.

    Null vectors and ones with null or NaN are left out. Vectors meet their bank's pivots in blocks, so a large bank is many tasks.
    """
    rows = vectors.where(FINITE).withColumn("_h", F.xxhash64("memory_id"))
    size = rows.groupBy("bank_id").agg(F.count("*").alias("_n"), F.min("_h").alias("_least"))
    size = size.select("bank_id", "_least", F.ceil(F.col("_n") / rows_per_block).alias("_blocks"), (F.least(F.lit(float(most)), F.ceil(F.col("_n") / per_cell)) / F.col("_n")).alias("_share"))
    rows = rows.join(size, "bank_id")
    chosen = (F.col("_h") == F.col("_least")) | (F.shiftrightunsigned("_h", 11) / float(1 << 53) < F.col("_share"))
    pivots = rows.where(chosen).select(F.col("bank_id").alias("_bank"), F.col("memory_id").alias("_pivot"), F.col("embedding").alias("_at"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_part"))
    given = [c for c in vectors.columns if c not in ("bank_id", "memory_id", "embedding")]
    left = rows.select("bank_id", F.pmod("_h", "_blocks").alias("_block"), "memory_id", "embedding", *given)
    kinds = dict(vectors.dtypes)
    out = f"bank_id {kinds['bank_id']}, cell long, memory_id long, angle double, embedding {kinds['embedding']}" + "".join(f", {c} {kinds[c]}" for c in given)

    def assign(one: pa.Table, two: pa.Table) -> pa.Table:
        cell, angle = pa.nulls(one.num_rows, pa.int64()), np.zeros(one.num_rows)
        if one.num_rows and two.num_rows:
            two = two.sort_by("_pivot")
            v, p = unit(one["embedding"]), unit(two["_at"])
            live = np.abs(p).sum(1) > 0
            if live.any():
                cos = np.clip(v @ p[live].T, -1, 1)
                best = cos.argmax(1)
                some = np.abs(v).sum(1) > 0
                angle = np.where(some, np.arccos(cos[np.arange(len(v)), best]), 0.0)
                cell = pa.array(two["_pivot"].to_numpy()[live][best], mask=~some)
        return pa.table([one["bank_id"], cell, one["memory_id"], pa.array(angle), one["embedding"], *(one[c] for c in given)], names=["bank_id", "cell", "memory_id", "angle", "embedding", *given])

    members = left.groupBy("bank_id", "_block").cogroup(pivots.groupBy("_bank", "_part")).applyInArrow(assign, out)
    centres = members.groupBy("bank_id", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    where = pivots.where("_part = 0").select(F.col("_bank").alias("bank_id"), F.col("_pivot").alias("cell"), F.col("_at").alias("pivot"))
    return Cells(members, centres.join(where, ["bank_id", "cell"], "left"))


def write_cells(found: Cells, path: str) -> None:
    found.members.write.mode("overwrite").partitionBy("bank_id").parquet(f"{path}/members")
    members = found.members.sparkSession.read.parquet(f"{path}/members")
    centres = members.groupBy("bank_id", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    pivots = members.select("bank_id", F.col("memory_id").alias("cell"), F.col("embedding").alias("pivot"))
    centres.join(pivots, ["bank_id", "cell"], "left").write.mode("overwrite").parquet(f"{path}/centres")


def read_cells(spark: SparkSession, path: str) -> Cells:
    return Cells(spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/centres"))


def _routed(queries: DataFrame, centres: DataFrame, k: int | None, queries_per_block: int = 2_000) -> DataFrame:
    """(query_id, bank_id, cell): with ``k`` the nearest cells that hold k vectors; else those whose bound is within ``reach``.

    ``queries`` has query_id, bank_id, embedding and, without ``k``, reach (an angle).
    """
    parts = queries.groupBy("bank_id").agg(F.ceil(F.count("*") / queries_per_block).alias("_parts"))
    left = queries.where(FINITE).join(parts, "bank_id").withColumn("_part", F.pmod(F.xxhash64("query_id"), "_parts")).drop("_parts")
    right = centres.join(parts, "bank_id").select(F.col("bank_id").alias("_bank"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_block"), F.coalesce("cell", F.lit(-1)).cast("long").alias("cell"), F.col("cell").isNull().alias("loose"), "n", "low", "high", "pivot")

    def route(one: pa.Table, two: pa.Table) -> pa.Table:
        query, cell, loose = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        if one.num_rows and two.num_rows:
            two = two.sort_by([("loose", "descending"), ("cell", "ascending")])
            free = two["loose"].to_numpy()
            v, bound = unit(one["embedding"]), np.zeros((one.num_rows, two.num_rows))
            if not free.all():
                with_pivot = two.filter(pa.array(~free))
                angle = np.arccos(np.clip(v @ unit(with_pivot["pivot"]).T, -1, 1))
                bound[:, ~free] = np.maximum(0, np.maximum(angle - with_pivot["high"].to_numpy(), with_pivot["low"].to_numpy() - angle) - SLACK)
            bound[np.abs(v).sum(1) == 0] = 0
            if k is None:
                take = bound <= one["reach"].to_numpy()[:, None] + SLACK
            else:
                order = np.argsort(bound, axis=1, kind="stable")
                held = np.cumsum(two["n"].to_numpy()[order], axis=1)
                first = np.concatenate((np.ones((len(v), 1), bool), held[:, :-1] < k), axis=1)
                take = np.zeros_like(first)
                np.put_along_axis(take, order, first, 1)
            at, of = np.nonzero(take)
            query, cell, loose = one["query_id"].to_numpy()[at], two["cell"].to_numpy()[of], free[of]
        bank = pa.array([one["bank_id"][0].as_py()] * len(query) if len(query) else [], pa.int64())
        return pa.table([pa.array(query), bank, pa.array(cell, mask=loose)], names=["query_id", "bank_id", "cell"])

    found = left.groupBy("bank_id", "_part").cogroup(right.groupBy("_bank", "_block"))
    return found.applyInArrow(route, "query_id long, bank_id long, cell long")


def _met(pairs: DataFrame, queries: DataFrame, index: Cells, run, out: str, carry: tuple[str, ...] = (), rows_per_block: int = 50_000) -> DataFrame:
    """``run`` over the queries of a cell and a block of its members, for all pairs of query and cell."""
    blocks = index.centres.select("bank_id", F.coalesce("cell", F.lit(-1)).alias("_cell"), F.ceil(F.col("n") / rows_per_block).alias("_blocks"))
    key = ["bank_id", "_cell"]
    asked = pairs.withColumn("_cell", F.coalesce("cell", F.lit(-1))).drop("cell").join(queries.drop("bank_id"), "query_id").join(blocks, key)
    asked = asked.select(*key, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "query_id", F.col("embedding").alias("asked"), *carry).withColumnRenamed("bank_id", "_bank").withColumnRenamed("_cell", "_of")
    held = index.members.withColumn("_cell", F.coalesce("cell", F.lit(-1))).join(blocks, key).withColumn("_part", F.pmod(F.xxhash64("memory_id"), "_blocks")).drop("_blocks", "cell", "angle")
    return held.groupBy(*key, "_part").cogroup(asked.groupBy("_bank", "_of", "_block")).applyInArrow(run, out)


def cell_top_k(index: Cells, queries: DataFrame, k: int = R.PER_ARM) -> DataFrame:
    """(query_id, memory_id, score, rank): the rows of ``recall.vector_top_k``, from the cells that can hold them."""

    def best(one: pa.Table, two: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if one.num_rows and two.num_rows:
            one = one.sort_by("memory_id")
            sims = np.round(unit(two["asked"]) @ unit(one["embedding"]).T, 9)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            out = [np.repeat(two["query_id"].to_numpy(), order.shape[1]), one["memory_id"].to_numpy()[order].ravel(), np.take_along_axis(sims, order, 1).ravel()]
        return pa.table(out, names=["query_id", "memory_id", "score"])

    asked = queries.where(FINITE).select("query_id", "bank_id", "embedding")
    out = "query_id long, memory_id long, score double"
    near = _routed(asked, index.centres, k).checkpoint()
    first = _met(near, asked, index, best, out).checkpoint()
    reach = R.top_k(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    reach = asked.join(reach, "query_id").select("query_id", "bank_id", "embedding", F.when(F.col("n") < k, 4.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("last") - 1e-9)))).alias("reach"))
    more = _routed(reach, index.centres, None).exceptAll(near)
    return R.top_k(first.unionByName(_met(more, asked, index, best, out)), k)


def any_before(index: Cells, queries: DataFrame, floor: float) -> DataFrame:
    """(query_id): queries at least as near as ``floor`` to some member of their bank with an earlier ``at``.

    ``queries(query_id, bank_id, embedding, at)``; the members carry ``at`` too. A task goes
    through a block's members by time and stops when all its queries have met one;
    no pairs are written.
    """

    def some(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64())})
        one = one.sort_by("at")
        asked, when, ids = unit(two["asked"]), two["at"].to_numpy(), two["query_id"].to_numpy()
        met = np.zeros(len(ids), bool)
        for a in range(0, one.num_rows, 4_096):
            if met.all():
                break
            part = one.slice(a, 4_096)
            left = np.flatnonzero(~met)
            near = np.round(asked[left] @ unit(part["embedding"]).T, 9) >= floor
            met[left] = (near & (part["at"].to_numpy()[None, :] < when[left, None])).any(1)
        return pa.table({"query_id": ids[met]})

    asked = queries.where(FINITE)
    reach = asked.withColumn("reach", F.lit(float(np.arccos(np.clip(floor - 1e-9, -1, 1)))))
    pairs = _routed(reach.select("query_id", "bank_id", "embedding", "reach"), index.centres, None)
    return _met(pairs, asked, index, some, "query_id long", ("at",)).distinct()
