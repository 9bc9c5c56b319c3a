"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

Conversations are sorted by their turns, so every prefix is one stretch of them. A task writes a
stretch as a sequence of parentheses and answers all nodes inside it from excess, rank and
cumulative arrays. Only the paths to a shard's first and last conversation can go on in another
shard; these spines are merged by node and cut out of sums over all shards. The library has no
dialogue records, so the operator is general: conversation rows conv_id, turn, role, text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import turn_order, written

STEP = 16
BLOCK = 64
NODES = ("node binary, parent binary, depth long, chars long, shard long, spine boolean, conv_id long, "
         "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "open long, close long, leaves_open long, leaves_close long, saved_open long, saved_close long")


def conversation_paths(turns: DataFrame) -> DataFrame:
    """One row per conv_id with its path: array<struct<digest, chars>> of the turns in order.

    A null role or text is empty; rows without conv_id are left out. Texts are not shuffled: a turn
    is a digest and its code points, about 100 bytes on the way and 24 in the trie, so a
    conversation is one row however long its texts are.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct(*turn_order(F.col("turn").cast("long"), role, text),
                            F.char_length(text).cast("long").alias("chars")).alias("said"))
    return said.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said")).select(
        "conv_id", F.transform("said", lambda x: F.struct(x["digest"], x["chars"])).alias("path"))


class Parens:
    """Balanced parentheses with a range minimum tree over the excess of blocks."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int64)
        self.opens = np.cumsum(bits, dtype=np.int64)
        leaf = np.zeros(len(bits), bool)
        leaf[:-1] = bits[:-1] & ~bits[1:]
        self.leaves = np.cumsum(leaf, dtype=np.int64)
        blocks = -(-len(bits) // BLOCK)
        self.size = 1 << max(0, int(blocks - 1).bit_length())
        top = np.iinfo(np.int64).max
        self.padded = np.full(self.size * BLOCK, top)
        self.padded[:len(bits)] = self.excess
        self.low = np.full(2 * self.size, top)
        self.low[self.size:] = self.padded.reshape(self.size, BLOCK).min(axis=1)
        for i in range(self.size - 1, 0, -1):
            self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])

    def _scan(self, block: np.ndarray, after: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """First place in each block behind after whose excess is at most goal, or -1."""
        at = block[:, None] * BLOCK + np.arange(BLOCK)
        hit = (self.padded[at] <= goal[:, None]) & (at > after[:, None])
        first = hit.argmax(axis=1)
        rows = np.arange(len(block))
        return np.where(hit[rows, first], at[rows, first], -1)

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Place of the parenthesis that closes each open one: the next of lower excess.

        The own block is scanned; beyond it the tree is climbed until a right neighbour's minimum
        is low enough, then descended to its first block of this kind.
        """
        out = np.empty(len(opens), np.int64)
        for lo in range(0, len(opens), 4096):
            p = opens[lo:lo + 4096]
            goal = self.excess[p] - 1
            found = self._scan(p // BLOCK, p, goal)
            rest = np.flatnonzero(found < 0)
            if len(rest):
                want, node = goal[rest], self.size + p[rest] // BLOCK
                climbing = np.ones(len(rest), bool)
                while climbing.any():
                    left = climbing & (node % 2 == 0)
                    good = np.zeros(len(rest), bool)
                    good[left] = self.low[node[left] + 1] <= want[left]
                    node = np.where(good, node + 1, np.where(climbing, node // 2, node))
                    climbing &= ~good
                while (inner := node < self.size).any():
                    child = 2 * node[inner]
                    node[inner] = np.where(self.low[child] <= want[inner], child, child + 1)
                found[rest] = self._scan(node - self.size, p[rest], want)
            out[lo:lo + 4096] = found
        return out


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] for many ranges, from doubling tables."""
    tables = [values]
    while len(tables[-1]) > (step := 1 << (len(tables) - 1)):
        tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
    out = np.empty(len(first), np.int64)
    level = np.floor(np.log2(last - first + 1)).astype(int)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(tables[k][first[at]], tables[k][last[at] - (1 << k) + 1])
    return out


class Shard:
    """Distinct paths in their order, as parentheses and arrays over nodes in the order of opening."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.bits: list[int] = [1]
        self.node, self.parent, self.depth, self.chars = [hashlib.md5().digest()], [-1], [0], [0]
        self.ends: list[tuple[int, int, int]] = []
        self.stack, self.state, self.last = [0], [hashlib.md5()], b""
        self.first_path: list[int] | None = None

    def __len__(self) -> int:
        return len(self.node)

    def add(self, path: bytes, chars: list[int], n: int, conv_id: int) -> None:
        shared = 0
        while (shared < min(len(path), len(self.last))
               and path[shared:shared + STEP] == self.last[shared:shared + STEP]):
            shared += STEP
        keep = shared // STEP + 1
        self.bits += [0] * (len(self.stack) - keep)
        del self.stack[keep:], self.state[keep:]
        for at in range(shared, len(path), STEP):
            state = self.state[-1].copy()
            state.update(path[at:at + STEP])
            self.bits.append(1)
            self.parent.append(self.stack[-1])
            self.depth.append(len(self.stack))
            self.chars.append(chars[at // STEP])
            self.stack.append(len(self.node))
            self.node.append(state.digest())
            self.state.append(state)
        self.ends.append((self.stack[-1], n, conv_id))
        self.last = path
        if self.first_path is None:
            self.first_path = list(self.stack)

    def nodes(self) -> pa.RecordBatch:
        """All nodes: those off the spines with their results, spines with their part of them."""
        size = len(self)
        trie = Parens(np.array(self.bits + [0] * len(self.stack), bool))
        opens = np.flatnonzero(trie.bits)
        closes = trie.findclose(opens)
        stop = trie.opens[closes]
        end, n, conv = (np.array(x, np.int64) for x in zip(*self.ends, strict=True))
        members = np.zeros(size + 1, np.int64)
        np.add.at(members, end + 1, n)
        members = np.cumsum(members)
        n_convs = members[stop] - members[np.arange(size)]
        # Paths come in the order of their end nodes, so a subtree's are a stretch of them.
        least = _range_min(conv, np.searchsorted(end, np.arange(size)), np.searchsorted(end, stop) - 1)
        parent = np.array(self.parent)
        spine = np.zeros(size, bool)
        spine[self.first_path] = spine[self.stack] = True
        chars = np.array(self.chars, np.int64)
        own = np.where(spine, 0, (n_convs - 1) * chars)
        saved = np.concatenate([[0], np.cumsum(own)])
        # A leaf counts where it is no spine; ranks of spine leaves are taken off.
        spine_leaf = np.cumsum(np.concatenate([[0], spine & (closes == opens + 1)]))
        before = trie.leaves[opens] - (closes == opens + 1) - spine_leaf[:-1]
        behind = trie.leaves[closes] - spine_leaf[stop]
        children = np.bincount(parent[1:][~spine[1:]], minlength=size)
        parents = [None if p < 0 else self.node[p] for p in self.parent]
        inner = ~spine & (parent >= 0)
        inner[inner] &= ~spine[parent[inner]]

        def column(values, mask=None):
            return pa.array(values, pa.int64(), mask=mask)

        return pa.RecordBatch.from_arrays([
            pa.array(self.node, pa.binary()), pa.array(parents, pa.binary()), column(self.depth),
            column(chars), column(np.full(size, self.number)), pa.array(spine), column(least),
            column(least[np.maximum(parent, 0)], ~inner), column(n_convs), column(children),
            column(behind - before, spine), column(saved[stop] - saved[:-1], spine),
            column(opens), column(closes), column(before), column(behind), column(saved[:-1]),
            column(saved[stop])], names=[c.split()[0] for c in NODES.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch], shard_nodes: int) -> Iterator[pa.RecordBatch]:
    part, count, shard = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        for path, chars, n, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard is None:
                shard = Shard((part << 32) + count)
            shard.add(path, chars, n, conv_id)
            if len(shard) >= shard_nodes:
                yield shard.nodes()
                shard, count = None, count + 1
    if shard is not None:
        yield shard.nodes()


def _merged_spines(spines: DataFrame) -> DataFrame:
    """Results of the nodes that several shards may hold.

    Places of all shards form one sequence, so what a spine node has off the spines is the last
    cumulative sum at its closing less the first at its opening. Its share of the spine nodes comes
    the same way from a running sum over their openings, each counted in its first shard.
    """
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    # One row a shard: its root, whose sums are those of the whole shard.
    starts = spines.filter("depth = 0").select(
        "shard", *(F.coalesce(F.sum(f"{c}_close").over(earlier), none).alias(f"{c}_base")
                   for c in ("leaves", "saved")))
    placed = spines.join(starts, "shard")
    merged = written(placed.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"),
        F.first("chars").alias("chars"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("inner"),
        F.min(F.struct("shard", "open")).alias("from"), F.max(F.struct("shard", "close")).alias("to"),
        *((F.max(F.col(f"{c}_close") + F.col(f"{c}_base"))
           - F.min(F.col(f"{c}_open") + F.col(f"{c}_base"))).alias(f"{c}_inside")
          for c in ("leaves", "saved"))), "spines")
    below = merged.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("spine"))
    full = written(merged.join(below, "node", "left").withColumn(
        "n_children", F.col("inner") + F.coalesce("spine", none)).withColumns({
            "own_leaves": (F.col("n_children") == 0).cast("long"),
            "own_saved": (F.col("n_convs") - 1) * F.col("chars")}), "spines")
    events = full.select("node", F.explode(F.array(
        F.struct(F.col("from.shard"), F.col("from.open").alias("place"), "own_leaves", "own_saved",
                 F.lit(-1).alias("sign")),
        F.struct(F.col("to.shard"), F.col("to.close").alias("place"), none.alias("own_leaves"),
                 none.alias("own_saved"), F.lit(1).alias("sign")))).alias("e")).select("node", "e.*")
    bases = events.groupBy("shard").agg(F.sum("own_leaves").alias("a"), F.sum("own_saved").alias("b")) \
        .select("shard", *(F.coalesce(F.sum(c).over(earlier), none).alias(f"{c}_base")
                           for c in ("a", "b")))
    so_far = (Window.partitionBy("shard").orderBy("place")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = (events.withColumns({"a": F.sum("own_leaves").over(so_far) - F.col("own_leaves"),
                                "b": F.sum("own_saved").over(so_far) - F.col("own_saved")})
            .join(bases, "shard").groupBy("node").agg(
                *(F.sum(F.col("sign") * (F.col(c) + F.col(f"{c}_base"))).alias(c) for c in ("a", "b"))))
    return full.join(sums, "node").select(
        "node", "parent", "depth", "conv_id", "n_convs", "n_children",
        (F.col("leaves_inside") + F.col("a")).alias("n_leaves"),
        (F.col("saved_inside") + F.col("b")).alias("saved_tokens"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node as comma-joined text, at most a batch long."""
    for batch in batches:
        nodes, ids = (c.to_pylist() for c in batch.columns)
        cuts = [i for i in range(len(nodes)) if i == 0 or nodes[i] != nodes[i - 1]] + [len(nodes)]
        yield pa.RecordBatch.from_arrays([
            pa.array([nodes[i] for i in cuts[:-1]], pa.binary()),
            pa.array([ids[i] for i in cuts[:-1]], pa.int64()),
            pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)],
                     pa.string())], names=["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, digest = None, None
    for batch in batches:
        done = []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if node != last:
                if digest is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()),
                                          pa.array([d for _, d in done], pa.string())],
                                         names=["node", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()),
                                          pa.array([digest.hexdigest()], pa.string())],
                                         names=["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined conv_ids of each node: node, ends_sha256.

    Ids are range-partitioned by node and id, packed into runs where they lie and hashed run after
    run, so a node that ends a large share of all conversations is never held as a list.
    """
    packed = (ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
              .mapInArrow(_packed, "node binary, first long, ids string"))
    return (packed.repartition("node").sortWithinPartitions("node", "first")
            .mapInArrow(_digests, "node binary, ends_sha256 string"))


def prefix_trie(paths: DataFrame, shard_nodes: int = 1 << 16) -> DataFrame:
    """One row per distinct prefix of the paths, the empty one included.

    paths: conv_id (unique, not null) and path as conversation_paths gives it; an empty path ends
    at the root; other columns are left out. Returns node and parent (digests), conv_id (smallest
    member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves
    (childless nodes in the subtree), saved_tokens (over the subtree, members less one times the
    code points of the node's last text) and ends_sha256 of the members that end at the node. No
    paths give no rows.

    Equal paths are folded first. The others are dealt by ranges of their first 32 digests and
    sorted in full; shards of shard_nodes nodes bound the memory of a task, and results do not
    depend on where they are cut.
    """
    hexed = F.array_join(F.transform("path", lambda x: x["digest"]), "")
    keyed = written(paths.select("conv_id", F.unhex(hexed).alias("key"),
                                 F.transform("path", lambda x: x["chars"]).alias("chars"))
                    .withColumn("node", F.unhex(F.md5("key"))), "paths")
    distinct = written(keyed.groupBy("node").agg(
        F.first("key").alias("key"), F.first("chars").alias("chars"),
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).drop("node"), "distinct")
    nodes = written(distinct.repartitionByRange(F.substring("key", 1, 32 * STEP))
                    .sortWithinPartitions("key")
                    .mapInArrow(lambda b: _shards(b, shard_nodes), NODES), "nodes")
    spines = written(_merged_spines(nodes.filter("spine")), "merged")
    done = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens"]
    inner = nodes.filter("NOT spine").select(*done, "parent_conv_id")
    above = spines.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    rows = inner.filter("parent_conv_id IS NOT NULL").unionByName(
        inner.filter("parent_conv_id IS NULL").drop("parent_conv_id").unionByName(spines)
        .join(above, "parent", "left").withColumnRenamed("above", "parent_conv_id"))
    empty = hashlib.sha256().hexdigest()
    return rows.join(end_digests(keyed.select("node", "conv_id")), "node", "left").select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
