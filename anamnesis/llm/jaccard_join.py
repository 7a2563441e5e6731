"""Exact Jaccard similarity join of shingle sets in metric space.

The Jaccard distance d = 1 - J is a metric. Texts are joined in regions around
pivots, and regions are joined recursively:

1. Rows with one shingle set are one node, named by the set's fingerprint.
2. First pivots are the one-shingle sets {s}. Most texts are at distance 1 from
   each other, so only these pivots are near a text: d(x, {s}) = 1 - 1/|x| when
   s is in x, else 1. A text ties between its own shingles; the rarest one wins.
   The triangle inequality then says how many further regions a boundary text
   must be copied into: with T a set of t shingles of x, D = |x delta y| obeys
   D(y, T) <= D(x, y) + D(x, T), so a y linked with x cannot miss T once t is
   above the most that x can have and y lack. That many of the rarest shingles
   are the window of x; linked texts share a region. Rarity is counted over all
   nodes, within the samples described below.
3. Each region takes a document as pivot and measures its distance to every
   member. Members within eps are linked to it. The rest is cut into the
   members within 2 eps and those beyond eps; the band between the two stands
   on both sides, so by the triangle inequality every linked pair that does not
   contain the pivot is inside one part. Parts whose members are one component
   already, or that have one member, are done; the others get new pivots.
4. What is left after the last round is compared pair by pair, each pair in one
   region only, across components only, and only where the distances to the last
   pivot differ by eps at most and neither the shingles that only one node has
   nor the two parity sketches put the two too far apart. A sketch is one bit
   for each slot that shingles hash to, whether an odd number of them do: two
   sketches differ in |x delta y| bits at most, so no link is lost.

Distances come from the whole sets, so links are exact. A group of thousands of
near copies costs one comparison per member and round, not one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, discard, free_names, located, partitions_for, placed, staged
from .textvec import pieces, shingles

#: 64-bit words of a set's parity sketch.
SKETCH_WORDS = 8


@dataclass(frozen=True)
class Similarity:
    """J >= num / den on distinct ``width``-word shingles."""

    width: int = 5
    num: int = 4
    den: int = 5
    #: Shingles sampled per text beyond its window, in units of the window.
    reach: int = 1
    #: Rounds of document pivots before what is left is compared by pairs.
    rounds: int = 2

    def missing(self, n: int) -> int:
        """The most shingles that a set of n can have and a linked set lack."""
        return n - -(-self.num * n // self.den)

    def shared(self, n: int) -> int:
        """How many sampled shingles linked sets share, for the smaller one's n."""
        return min(self.reach * (self.missing(n) + 1), n - self.missing(n))

    def sampled(self, n: int) -> int:
        return self.missing(n) + self.shared(n)

    def window(self, n: int) -> int:
        """How many of the rarest sampled shingles a set of n needs as pivots."""
        return self.sampled(n) - self.shared(-(-self.num * n // self.den)) + 1


def shingle_sets(docs: DataFrame, how: Similarity) -> DataFrame:
    """(doc_id, n_shingles, node, sample, id): the set's size, fingerprint and its lowest hashes.

    Hashes of the sample are cut to 40 bits; two shingles that then look alike
    only put texts into one region that need not share it, and count as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch, "text"):
                size, node, sample, ends = [], [], [], [0]
                for row in shingles(data, offsets, how.width):
                    size.append(len(row))
                    node.append(_fingerprint(row))
                    sample.append(row[: how.sampled(len(row))] if len(row) else row)
                    ends.append(ends[-1] + len(sample[-1]))
                flat = (np.concatenate(sample) >> np.uint64(24)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first).cast(pa.int64()), pa.array(size, pa.int64()),
                        pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                        batch.column("id").slice(first, last - first),
                    ],
                    ["doc_id", "n_shingles", "node", "sample", "id"],
                )

    return docs.select("doc_id", "text", "id").mapInArrow(run, "doc_id long, n_shingles long, node long, sample array<long>, id long")


def _fingerprint(row: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(row.tobytes()) - (1 << 63)


def _windows(rows: DataFrame) -> DataFrame:
    """The rows (s, node, slack, ..) in their node's window with ``met``, ``rows`` lying together by s.

    Some of a node's shingles make its window, the rarest first; ``slack`` is
    their number less that of all its shingles in ``rows``. A shingle that one
    node has needs no region, but counts as one of them; ``met`` counts the rest.
    """
    met = rows.withColumn("f", F.count("*").over(W.partitionBy("s"))).where("f > 1")
    own = W.partitionBy("node")
    met = met.withColumn("rank", F.row_number().over(own.orderBy("f", "s"))).withColumn("met", F.count("*").over(own))
    return met.where(F.col("rank") <= F.col("slack") + F.col("met")).drop("f", "rank", "slack")


def _sampled_windows(sets: DataFrame, how: Similarity) -> DataFrame:
    """(node, n) of the nodes that share a region, judged by samples.

    Rows are dealt out by shingle once; a shingle has one row per node at most,
    and a node dozens of shingles, so no shingle holds more than a small part
    of them.
    """
    sets = sets.select("node", F.col("n_shingles").alias("n"), F.array_distinct("sample").alias("sample"))
    slack = (_sizes(how)("window") - F.size("sample")).cast("int")
    total = sets.agg(F.sum(F.size("sample"))).first()[0] or 0
    rows = sets.select("node", slack.alias("slack"), F.explode("sample").alias("s"))
    rows = rows.repartition(partitions_for(sets.sparkSession, total, 2_000_000), "s").groupBy("s", "node").agg(F.min("slack").alias("slack"))
    return _windows(rows).select("node").distinct()


def _regions(sets: DataFrame, how: Similarity, turns: int = 2) -> DataFrame:
    """(region, node, n, own), ``own`` the shingles no other node has: the windows over the rarest pivots, now of whole sets.

    Rarity is counted among the nodes that are left, and again among those that
    this leaves: what was common among all texts is rare there, and a text with
    more shingles of its own than a linked one may lack drops out. Regions with
    the same members are one.
    """
    slack = (_sizes(how)("missing") + 1 - F.col("n")).cast("int")
    for turn in range(turns):
        rows = sets.select("node", F.col("n").cast("int").alias("n"), slack.alias("slack"), F.explode("set").alias("s"))
        total = sets.agg(F.sum("n")).first()[0] or 0
        rows = rows.repartition(partitions_for(sets.sparkSession, total, 2_000_000), "s")
        chosen = staged(_windows(rows).select("s", "node", F.col("n").cast("long").alias("n"), (F.col("n") - F.col("met")).alias("own")), "jaccard-windows")
        if turn < turns - 1:
            left = staged(sets.select("node", "n", "set").join(chosen.select("node").distinct(), "node", "left_semi"), "jaccard-left")
            del rows
            discard(chosen, collect=True)
            sets = left
    members = chosen.groupBy("s").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("m > 1")
    out = staged(chosen.join(members, "s").select(F.xxhash64("m", "x", "y").alias("region"), "node", "n", "own").distinct(), "jaccard-regions")
    del rows, members
    discard(sets, chosen, collect=True)
    return out


def _sizes(how: Similarity):
    """``how``'s sizes as columns of n (exact integer arithmetic)."""
    n = F.col("n")

    def least(x):
        return F.floor((how.num * x + how.den - 1) / how.den).cast("long")

    def missing(x):
        return x - least(x)

    def shared(x):
        return F.least(how.reach * (missing(x) + 1), least(x))

    def get(what: str):
        if what == "missing":
            return missing(n)
        sampled = missing(n) + shared(n)
        return sampled if what == "sampled" else sampled - shared(least(n)) + 1

    return get


def _sketch(row: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each slot, as signed words."""
    odd = np.bincount((row % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _too_far(how: Similarity) -> Column:
    """Whether the sketches of a and b differ in more bits than linked sets can."""
    bits = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    return bits * (how.den + how.num) > (F.col("n_a") + F.col("n_b")) * (how.den - how.num)


def _sets_of(docs: DataFrame, wanted: DataFrame, how: Similarity) -> DataFrame:
    """(node, n, set, sketch) of the documents ``wanted(id)``: whole sets of 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch, "text"):
                rows = list(shingles(data, offsets, how.width))
                size = np.array([len(x) for x in rows])
                flat = pa.array(np.concatenate(rows).view(np.int64))
                ends = pa.array(np.concatenate(([0], size.cumsum())), pa.int32())
                sketch = pa.array([_sketch(x) for x in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(x) for x in rows], pa.int64()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(ends, flat), sketch], ["node", "n", "set", "sketch"])

    some = docs.select("id", "text").join(wanted, "id", "left_semi").select("text")
    return some.mapInArrow(run, "node long, n long, set array<long>, sketch array<long>").where("n > 0").dropDuplicates(["node"])


def _distances(tests: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """(node, pivot, d, linked) for the pairs of ``tests``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, linked = [], []
            for x, y in zip(batch.column("set"), batch.column("pivot_set"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = np.concatenate((x, y))
                both.sort()
                inside = int((both[1:] == both[:-1]).sum())
                union = len(both) - inside
                d.append(1 - inside / union)
                linked.append(how.den * inside >= how.num * union)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivot"), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], ["node", "pivot", "d", "linked"])

    rows = tests.join(sets.select("node", "set"), "node").join(sets.select(F.col("node").alias("pivot"), F.col("set").alias("pivot_set")), "pivot")
    return rows.select("node", "pivot", "set", "pivot_set").mapInArrow(run, "node long, pivot long, d double, linked boolean")


def _near_sizes(a: str, b: str, how: Similarity):
    return (F.col(a) * how.den >= F.col(b) * how.num) & (F.col(b) * how.den >= F.col(a) * how.num)


def links(docs: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """Edges (a, b) between linked nodes, enough to join every two that any links connect; the staged ``sets`` are used up."""
    eps = 1 - how.num / how.den
    wanted = sets.join(_sampled_windows(sets, how), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    samples, sets = sets, staged(_sets_of(docs, wanted.select("id"), how), "jaccard-sets")
    del wanted
    discard(samples, collect=True)
    regions = _regions(sets, how)
    found = None
    for turn in range(how.rounds):
        if regions.isEmpty():
            break
        key = F.struct(F.xxhash64(F.lit(turn), F.col("node")).alias("h"), "node", "n")
        pivots = regions.groupBy("region").agg(F.min(key).alias("p")).select("region", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
        rest = regions.join(pivots, "region").where("node <> pivot")
        tests = rest.select("node", "pivot").distinct()
        measured = staged(_distances(tests, sets, how), "jaccard-distances")
        new = measured.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        # a component's nodes are all tied to its least one, which stands for the links so far
        found = staged(new if found is None else found.union(new), "jaccard-links")
        component = staged(components(found, "jaccard"), "jaccard-component")
        discard(found)
        found = component.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        here = rest.join(measured, ["node", "pivot"]).join(component, "node", "left").withColumn("c", F.coalesce("component", "node"))
        side = F.explode(F.array_compact(F.array(F.when(F.col("d") <= 2 * eps + 1e-9, F.lit(0)), F.when(~F.col("linked"), F.lit(1)))))
        parts = here.select("region", "node", "n", "own", "c", F.col("d").alias("gap"), side.alias("side"))
        parts = parts.select(F.xxhash64("region", F.lit(turn), "side").alias("region"), "node", "n", "own", "c", "gap")
        live = parts.groupBy("region").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("m > 1 AND low <> high")
        spent, regions = regions, staged(parts.join(live.select("region"), "region", "left_semi"), "jaccard-parts")
        discard(spent, measured, collect=True)
    if found is not None and not regions.isEmpty():
        cells = regions.groupBy("node").agg(F.collect_set("region").alias("cells"))
        sides = regions.join(cells, "node").join(sets.select("node", "sketch"), "node")
        one, two = (sides.select("region", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "own", "gap", "c", "cells", "sketch")]) for s in "ab")
        may = (F.col("c_a") != F.col("c_b")) & (F.col("node_a") < F.col("node_b")) & _near_sizes("n_a", "n_b", how)
        may &= F.abs(F.col("gap_a") - F.col("gap_b")) <= eps + 1e-9
        may &= (F.col("own_a") + F.col("own_b")) * (how.den + how.num) <= (F.col("n_a") + F.col("n_b")) * (how.den - how.num)
        may &= ~_too_far(how)
        may &= F.array_min(F.array_intersect("cells_a", "cells_b")) == F.col("region_a")
        pairs = one.withColumnRenamed("region", "region_a").join(two.withColumnRenamed("region", "region_b"), (F.col("region_a") == F.col("region_b")) & may)
        tests = pairs.select(F.col("node_a").alias("node"), F.col("node_b").alias("pivot"))
        last = _distances(tests, sets, how).where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        found = staged(found.union(last), "jaccard-links")
    if found is None:
        found = docs.sparkSession.createDataFrame([], "a long, b long")
    return found


def jaccard_components(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document.

    Words are runs of other than space and \\x09-\\x0D, with A-Z lower-cased; a
    text with fewer words than ``width`` has one shingle, all of it; null,
    empty and blank texts have none and are linked with nothing. Two documents
    link when their sets' similarity is ``num / den`` or more; a component's id
    is the smallest doc_id that links reach. Documents with equal sets are
    linked. Repeated rows count as rows of their own with one result; rows with
    a null doc_id link like others, but keep a null component id. An empty table
    gives no rows.
    """
    return _judged(_identified(located(docs)), how).select("doc_id", "n_shingles", "component_id")


def _identified(rows: DataFrame) -> DataFrame:
    """``rows(file, row)`` with an ``id`` that tells them apart."""
    return rows.withColumn("id", F.xxhash64("file", "row")).drop("file", "row")


def _judged(docs: DataFrame, how: Similarity) -> DataFrame:
    """(id, doc_id, n_shingles, component_id, stays) of ``docs(doc_id, text, id)``; one row of each component stays."""
    samples = staged(shingle_sets(docs, how), "jaccard-samples")
    sets = staged(samples.drop("sample"), "jaccard-rows")
    known = sets.where("n_shingles > 0")
    component = components(links(docs, samples, how), "jaccard-all")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "id")).alias("first")
    nodes = known.groupBy("node").agg(first).join(component, "node", "left")
    nodes = staged(nodes.select("node", "first", F.coalesce("component", "node").alias("component")), "jaccard-nodes")
    ids = nodes.groupBy("component").agg(F.min("first").alias("first"))
    named = nodes.select("node", "component").join(ids, "component").select(F.col("node").alias("of"), F.col("first.doc_id").alias("component_id"), F.col("first.id").alias("stay"))
    rows = sets.select("id", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    rows = rows.join(named, F.col("node") == F.col("of"), "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("id", "doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("id") == F.col("stay"), F.lit(True)).alias("stays"))


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, of the least doc_id; rows without shingles all stay.

    Rows with a null doc_id link like others and stay only where no other row of
    their component has one. The columns are those of ``docs``, whatever their names.
    """
    where, *place = placed(docs)
    (name,) = free_names(where.columns, "_id")
    rows = where.select("doc_id", "text", F.xxhash64(*place).alias("id"))
    gone = _judged(rows, Similarity()).where("NOT stays").select(F.col("id").alias(name))
    return where.withColumn(name, F.xxhash64(*place)).join(gone, name, "left_anti").drop(name, *place)
