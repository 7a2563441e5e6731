"""A trie of conversation prefixes in adaptive radix trees.

Conversations are rebuilt from a donor's first turns and their own later ones. A turn
becomes an id of fixed width, 16 bytes of a hash of role and text and 4 of
the text's length, so that a conversation is one binary key and equal prefixes are
equal bytes. Equal keys are counted before they are shuffled; distinct keys are dealt
by ranges of the sorted order, which cuts through any first turn, however common. Each
range grows an adaptive radix tree with nodes for 4, 16, 48 and 256 branches and
compressed paths; only where a turn ends does the tree give a row.

A prefix can go on in the next range. Each range knows the last key before it and
the first one after it, so it knows which of its nodes are shared, and adds what it
owns: a shared node counts as a child, and pays for its own text once, in the first
range that has it. Sums over the ranges are then exact.

The conv_ids of the conversations that end at a node are joined in sorted stretches and
hashed stretch after stretch, so that a third of all conversations may be one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged, text_of

DIGEST, LENGTH = 16, 4
WIDTH = DIGEST + LENGTH
NO_ENDS = hashlib.sha256().hexdigest()
DONORS_EVERY, HEADS = 5, 9


def turn_id(role: Column, text: Column) -> Column:
    """A turn's id in hexadecimal digits: ``DIGEST`` bytes of role and text, then the text's length in bytes."""
    length = lambda c: F.lpad(F.hex(F.octet_length(c)), 2 * LENGTH, "0")
    digest = F.sha2(F.concat(length(role), role, text).cast("binary"), 256)
    return F.concat(F.substring(digest, 1, 2 * DIGEST), length(text))


def rebuilt(conversations: DataFrame, donors_every: int = DONORS_EVERY, heads: int = HEADS) -> DataFrame:
    """(conv_id, key): the first h turns of conversation c - c % ``donors_every``, then c's own after its first h.

    h is crc32 of c's decimal digits modulo ``heads``. Turns go by turn, null first,
    ties by role and text; a null role or text is empty. Rows without a conv_id belong to no
    conversation. Donor and receivers meet under one key of at most 2 * ``donors_every`` - 1
    conversations; the turns themselves are sorted, not gathered, and only their ids are gathered.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.col("conv_id") % donors_every).alias("donor"), F.col("conv_id").cast("long"), "turn", text_of("role").alias("role"), text_of().alias("text")
    )
    rows = rows.select("*", turn_id(F.col("role"), F.col("text")).alias("id")).repartition("donor")
    order = Window.partitionBy("donor", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select("donor", "conv_id", "id", F.row_number().over(order).alias("i"))
    own = rows.groupBy("donor", "conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "id")))["id"].alias("ids"))
    family = own.groupBy("donor").agg(F.collect_list(F.struct("conv_id", "ids")).alias("members"), F.first(F.when(F.col("conv_id") == F.col("donor"), F.col("ids")), ignorenulls=True).alias("given"))
    each = family.select("given", F.inline("members"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    given = F.coalesce("given", F.array().cast("array<string>"))
    kept = F.slice("ids", h + 1, F.greatest(F.size("ids") - h, F.lit(0)))
    return each.select("conv_id", F.unhex(F.array_join(F.concat(F.slice(given, F.lit(1), h), kept), "")).alias("key"))


class Small:
    """A node of up to 4 or 16 branches: their bytes in order, and the nodes below in that order."""

    __slots__ = ("prefix", "value", "bytes", "below", "most")

    def __init__(self, prefix: bytes, value: int = -1, most: int = 4):
        self.prefix, self.value, self.bytes, self.below, self.most = prefix, value, bytearray(), [], most

    def find(self, byte: int):
        at = self.bytes.find(byte)
        return self.below[at] if at >= 0 else None

    def put(self, byte: int, node) -> Small | Medium:
        """Add or replace a branch; the node itself, or the larger one that takes its place."""
        at = self.bytes.find(byte)
        if at >= 0:
            self.below[at] = node
            return self
        if len(self.bytes) == self.most:
            if self.most == 16:
                return Medium(self).put(byte, node)
            self.most = 16
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.below.insert(at, node)
        return self

    def nodes(self) -> list:
        return self.below


class Medium:
    """A node of up to 48 branches: 256 slot numbers, and the nodes in the order they came."""

    __slots__ = ("prefix", "value", "slots", "below")

    def __init__(self, small: Small):
        self.prefix, self.value, self.slots, self.below = small.prefix, small.value, bytearray(256), list(small.below)
        for slot, byte in enumerate(small.bytes, 1):
            self.slots[byte] = slot

    def find(self, byte: int):
        return self.below[self.slots[byte] - 1] if self.slots[byte] else None

    def put(self, byte: int, node) -> Medium | Large:
        if self.slots[byte]:
            self.below[self.slots[byte] - 1] = node
        elif len(self.below) == 48:
            return Large(self).put(byte, node)
        else:
            self.below.append(node)
            self.slots[byte] = len(self.below)
        return self

    def nodes(self) -> list:
        return [self.below[s - 1] for s in self.slots if s]


class Large:
    """A node of up to 256 branches, one place for each byte."""

    __slots__ = ("prefix", "value", "below")

    def __init__(self, medium: Medium):
        self.prefix, self.value = medium.prefix, medium.value
        self.below = [medium.find(byte) for byte in range(256)]

    def find(self, byte: int):
        return self.below[byte]

    def put(self, byte: int, node) -> Large:
        self.below[byte] = node
        return self

    def nodes(self) -> list:
        return [node for node in self.below if node is not None]


def common(a: bytes, b: bytes) -> int:
    """How many bytes the two begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class Tree:
    """An adaptive radix tree from keys to numbers; a key may be the beginning of another."""

    def __init__(self):
        self.root = None

    def insert(self, key: bytes, value: int) -> None:
        if self.root is None:
            self.root = Small(key, value)
            return
        above, via, node, at = None, 0, self.root, 0
        while True:
            prefix = node.prefix
            n = len(prefix) if key.startswith(prefix, at) else common(prefix, key[at : at + len(prefix)])
            if n < len(prefix):
                new = Small(prefix[:n])
                node.prefix = prefix[n + 1 :]
                new.put(prefix[n], node)
            else:
                new = node
            at += n
            if at == len(key):
                new.value = value
            elif (child := new.find(key[at])) is not None:
                above, via, node, at = new, key[at], child, at + 1
                continue
            else:
                new = new.put(key[at], Small(key[at + 1 :], value))
            if new is not node:
                if above is None:
                    self.root = new
                else:
                    above.put(via, new)
            return

    def walk(self) -> list[tuple]:
        """(node, depth of the branch into it, depth of its end, index of the node above, first, last), nodes above first.

        first and last tell whether the node lies on the path of the first or last key.
        """
        out = [(self.root, -1, len(self.root.prefix), -1, True, True)]
        for i, (node, _, end, _, first, last) in enumerate(out):  # grows while it is read
            below = node.nodes()
            for k, child in enumerate(below):
                out.append((child, end, end + 1 + len(child.prefix), i, first and k == 0 and node.value < 0, last and k == len(below) - 1))
        return out


ROW = "part int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shared binary, parent_shared binary"


def range_rows(part: int, keys: list[bytes], convs: list[int], counts: list[int], ends: list[str], before: bytes | None, after: bytes | None) -> pa.Table:
    """The trie's nodes over one range of sorted distinct keys; ``before`` and ``after`` are the keys next to the range."""
    tree = Tree()
    for value, key in enumerate(keys):
        tree.insert(key, value)
    # whole turns that the range has in common with its neighbours; -1 without a neighbour
    early = -1 if before is None else common(before, keys[0]) // WIDTH
    late = -1 if after is None else common(keys[-1], after) // WIDTH
    nodes = tree.walk()
    size = len(nodes)
    number, least, leaves, saved, children = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    some, tops = [b""] * size, [[] for _ in range(size)]
    o_conv, o_depth, parents, o_n, o_children, o_leaves, o_saved, o_ends, o_shared, parent_shared = ([] for _ in range(10))
    for i in range(size - 1, -1, -1):
        node, start, end, above, first, last = nodes[i]
        n, conv, below, value = number[i], least[i], tops[i], node.value
        if value >= 0:
            n += counts[value]
            conv = convs[value] if conv is None else min(conv, convs[value])
            some[i] = keys[value]
        key, n_leaves, n_saved, n_children = some[i], leaves[i], saved[i], children[i]
        for at in range(end - end % WIDTH, start, -WIDTH):
            depth = at // WIDTH
            old = first and depth <= early  # an earlier range has it too, and counts it
            is_shared = old or last and depth <= late
            if value >= 0 and at == end and not node.nodes() and not (last and depth == late):
                n_leaves += 1
            if at:
                n_saved += (n if old else n - 1) * int.from_bytes(key[at - LENGTH : at], "big")
            digest = hashlib.sha256(key[:at]).digest()[:DIGEST] if is_shared else None
            for row in below:
                parents[row], parent_shared[row] = conv, digest
            below = [len(o_conv)]
            o_conv.append(conv)
            o_depth.append(depth)
            o_n.append(n)
            o_children.append(n_children)
            o_leaves.append(n_leaves)
            o_saved.append(n_saved)
            o_ends.append(ends[value] if value >= 0 and at == end else None)
            o_shared.append(digest)
            parents.append(None)
            parent_shared.append(None)
            n_children = 0 if old else 1
        if above >= 0:
            number[above] += n
            least[above] = conv if least[above] is None else min(conv, least[above])
            leaves[above] += n_leaves
            saved[above] += n_saved
            children[above] += n_children
            some[above] = key
            tops[above] += below
            tops[i] = []
    long = pa.int64()
    columns = [pa.array([part] * len(o_conv), pa.int32()), pa.array(o_conv, long), pa.array(o_depth, long), pa.array(parents, long), *(pa.array(c, long) for c in (o_n, o_children, o_leaves, o_saved)), pa.array(o_ends, pa.string()), pa.array(o_shared, pa.binary()), pa.array(parent_shared, pa.binary())]
    return pa.table(columns, names=[c.split()[0] for c in ROW.split(", ")])


def _range(key: tuple[pa.Scalar, ...], rows: pa.Table, bounds: pa.Table) -> pa.Table:
    rows = rows.sort_by("key")
    keys, convs, counts, ends = (rows.column(c).to_pylist() for c in ("key", "conv_id", "n", "ends"))
    return range_rows(key[0].as_py(), keys, convs, counts, ends, bounds.column("before")[0].as_py(), bounds.column("after")[0].as_py())


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (kd, conv_id) to (kd, first, ids): decimals of a stretch of one kd, joined by commas."""
    for batch in batches:
        kds, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[list] = [[], [], []]
        a = 0
        for b in range(1, len(kds) + 1):
            if b == len(kds) or kds[b] != kds[a]:
                for column, value in zip(out, (kds[a], ids[a], ",".join(map(str, ids[a:b]))), strict=True):
                    column.append(value)
                a = b
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["kd", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (kd, first, ids) to (kd, ends): a hash over the stretches of a kd, one after the other."""
    now, state = None, hashlib.sha256()
    for batch in batches:
        kds, ends = [], []
        for kd, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if kd != now:
                if now is not None:
                    kds.append(now)
                    ends.append(state.hexdigest())
                now, state = kd, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(kds, pa.binary()), pa.array(ends, pa.string())], ["kd", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["kd", "ends"])


def ends_of(keyed: DataFrame) -> DataFrame:
    """(kd, ends) from (kd, conv_id): SHA-256 of the conv_ids of a kd in numeric order, joined by commas."""
    runs = keyed.repartitionByRange("kd", "conv_id").sortWithinPartitions("kd", "conv_id").mapInArrow(_stretches, "kd binary, first long, ids string")
    return runs.repartition("kd").sortWithinPartitions("kd", "first").mapInArrow(_hashed, "kd binary, ends string")


def trie(keyed: DataFrame, bytes_per_range: int = 16 << 20, keys_per_range: int = 50_000) -> DataFrame:
    """The trie's nodes from (conv_id, key), one row per distinct prefix of whole turns.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. No conversations give no nodes, not even a root.
    A range holds about ``bytes_per_range`` of keys, and no more than about ``keys_per_range``.
    """
    keyed = staged(keyed, "trie-keys")
    kd = F.unhex(F.substring(F.sha2("key", 256), 1, 2 * DIGEST))
    texts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).withColumn("kd", kd)
    texts = staged(texts.join(ends_of(keyed.select(kd.alias("kd"), "conv_id")), "kd").drop("kd"), "trie-texts")
    discard(keyed)
    size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    ranges = max(1, -(-size[0] // keys_per_range), -(-size[1] // bytes_per_range))
    dealt = staged(texts.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "trie-ranges")
    discard(texts)
    # one row per range: its first and last key, and those of its neighbours
    order = Window.orderBy("part")
    edges = dealt.groupBy("part").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    bounds = edges.select("part", F.lag("most").over(order).alias("before"), F.lead("least").over(order).alias("after"))
    nodes = staged(dealt.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(_range, ROW), "trie-nodes")
    discard(dealt)
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    parts = nodes.where("shared IS NOT NULL")
    joint = parts.groupBy("shared").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in sums], F.max("ends_sha256").alias("ends_sha256"), F.max("parent_shared").alias("parent_shared"))
    joint = staged(joint, "trie-joint")
    above = joint.select(F.col("shared").alias("parent_shared"), F.col("conv_id").alias("parent"))
    # parents of whole nodes are looked up by range, so that the root's children are not one key
    known = parts.select("part", F.col("shared").alias("parent_shared")).join(above, "parent_shared")
    whole = nodes.where("shared IS NULL")
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    inside = whole.where("parent_shared IS NULL").select(*columns)
    edge = whole.where("parent_shared IS NOT NULL").drop("parent_conv_id").join(known.withColumnRenamed("parent", "parent_conv_id"), ["part", "parent_shared"]).select(*columns)
    joint = joint.join(above.withColumnRenamed("parent", "parent_conv_id"), "parent_shared", "left").select(*columns)
    out = inside.unionByName(edge).unionByName(joint)
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def conversation_trie(conversations: DataFrame, donors_every: int = DONORS_EVERY, heads: int = HEADS, **ranges: int) -> DataFrame:
    """The prefix trie of all rebuilt conversations; see ``rebuilt`` for odd rows and ``trie`` for the columns.

    Repeated rows are turns of their own. Very long texts only lengthen what is
    hashed. Other columns are left out whatever their names. An empty table gives no rows.
    """
    return trie(rebuilt(conversations, donors_every, heads), **ranges)
