"""SimHash fingerprints of descriptions and their near duplicates by BK-trees.

Fingerprints that differ in at most radius bits agree in one of radius + 1 bit blocks. Equal block
values form buckets; a bucket is cut into shards of bounded size, every shard becomes a BK-tree
(children keyed by the Hamming distance to the parent) and is sent to each block of queries of its
bucket, which follow only edges within the radius. A shard and its queries are one small unit of
work, so a bucket of any size is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected
from .rows import runs, slices, written

SHARD = 512
BLOCK_ROWS = 16_384
TEXTS = 256


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, unsigned.

    A-Z are lower-cased and words are runs without ASCII white space. With fewer words than width
    the whole sequence is the one shingle; without words the fingerprint is 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], seed)
                       for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)], "<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK_ROWS):
        part = hashes[i:i + BLOCK_ROWS].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(rows: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """row_id and fingerprint (long, the 64 bits signed) of every description row, one pass."""
    def hashed(batches):
        for batch in slices(batches, TEXTS):
            found = np.array([fingerprint_of(t, width, seed)
                              for t in batch.column("description").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").cast(pa.int64()), pa.array(found.view(np.int64))],
                ["row_id", "fingerprint"])

    return rows.select(F.col("row_id").cast("long").alias("row_id"), "description").mapInArrow(
        hashed, "row_id long, fingerprint long")


def with_fingerprint(rows: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """All columns of description rows and fingerprint (16 lowercase hex digits)."""
    rows = rows.drop("fingerprint")

    def hashed(batches):
        for batch in slices(batches, TEXTS):
            found = [f"{fingerprint_of(t, width, seed):016x}"
                     for t in batch.column("description").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())],
                                             [*batch.schema.names, "fingerprint"])

    return rows.mapInArrow(hashed, rows.withColumn("fingerprint", F.lit(None).cast("string")).schema)


class BKTree:
    """Integers by Hamming distance: a child hangs under the distance to its parent."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = []
        for i, v in enumerate(values):
            self.children.append({})
            if not i:
                continue
            at = 0
            while True:
                gap = (values[at] ^ v).bit_count()
                step = self.children[at].get(gap)
                if step is None:
                    self.children[at][gap] = i
                    break
                at = step

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at most radius bits away; other edges are not followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            gap = (self.values[at] ^ value).bit_count()
            if gap <= radius:
                found.append(at)
            below = self.children[at]
            todo += [below[d] for d in range(gap - radius, gap + radius + 1) if d in below]
        return found


def spanning(n: int, pairs) -> list[tuple[int, int]]:
    """The pairs that join two parts not joined before; n - 1 at most."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def linked_within(queries: list[int], shard: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Spanning links among the queries, or between the queries and the tree of a shard."""
    own = shard is None
    tree = BKTree(queries if own else shard)
    base = 0 if own else len(queries)
    total = len(queries) + (0 if own else len(shard))
    values = queries if own else queries + shard
    pairs = ((i, base + j) for i, q in enumerate(queries) for j in tree.within(q, radius)
             if not own or j < i)
    return [(values[a], values[b]) for a, b in spanning(total, pairs)]


def block_values(value: Column, blocks: int) -> list[Column]:
    """The bit blocks of a 64-bit value."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [F.shiftrightunsigned(F.shiftleft(value, 64 - high), 64 - high + low)
            for low, high in zip(edges, edges[1:], strict=False)]


def fingerprint_links(values: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """Links a, b that connect just the fingerprints within radius bits of each other.

    values: fingerprint (distinct longs). Of the links inside a unit of work only a spanning forest
    is returned, so there are at most as many as rows read, and classes stay the same.
    """
    buckets = values.select("fingerprint", F.posexplode(F.array(
        *block_values(F.col("fingerprint"), radius + 1))).alias("block", "value"))
    sizes = (buckets.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > 1)
             .withColumn("shards", F.ceil(F.col("n") / shard).cast("int")))
    buckets = written(buckets, "buckets")
    held = (buckets.join(written(sizes, "sizes"), ["block", "value"])
            .withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("shards")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))))
    units = held.select(
        F.xxhash64("block", "value", F.least("own", "other"), F.greatest("own", "other"))
        .alias("unit"), "block", "value", F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"), "own", "fingerprint")
    keys = ["unit", "block", "value", "low", "high"]

    def search(batches):
        for run in runs(batches, keys):
            values_ = run.column("fingerprint").to_numpy().view(np.uint64).tolist()
            if run.column("low")[0] == run.column("high")[0]:
                found = linked_within(values_, None, radius)
            else:
                own = run.column("own").to_numpy() == run.column("low")[0].as_py()
                found = linked_within([v for v, o in zip(values_, own, strict=True) if o],
                                      [v for v, o in zip(values_, own, strict=True) if not o],
                                      radius)
            if found:
                ends = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])],
                                                 ["a", "b"])

    return (units.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(search, "a long, b long"))


def simhash_classes(rows: DataFrame, radius: int = 2, width: int = 3, seed: int = 42,
                    shard: int = SHARD) -> DataFrame:
    """Near-duplicate classes of description rows.

    rows: row_id (long), description; returns row_id, fingerprint (16 lowercase hex digits) and
    component_id, the smallest row_id reachable over links of at most radius differing bits. Null
    descriptions count as empty; they share fingerprint 0. Equal fingerprints are one node, so
    copies make no pairs. Other columns are ignored; a repeated row_id gives a row each time.
    """
    marked = written(fingerprints(rows, width, seed), "fingerprints")
    nodes = written(marked.groupBy("fingerprint").agg(F.min("row_id").alias("first_id")), "nodes")
    joined = connected(fingerprint_links(nodes.select("fingerprint"), radius, shard))
    classes = nodes.join(joined.withColumnRenamed("id", "fingerprint"), "fingerprint", "left")
    classes = classes.select("fingerprint", "first_id", F.coalesce(
        "component", "fingerprint").alias("component"))
    classes = written(classes, "classes")
    lowest = written(classes.groupBy("component").agg(F.min("first_id").alias("component_id")),
                     "lowest")
    labelled = written(classes.join(lowest, "component").select("fingerprint", "component_id"),
                       "labelled")
    return marked.join(labelled, "fingerprint").select(
        "row_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id")
