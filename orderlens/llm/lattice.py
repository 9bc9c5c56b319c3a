"""Near-duplicate vectors by lattice hashing.

Each table projects unit vectors to blocks of eight dimensions at random, decodes every block to
the nearest point of the E8 lattice and joins the points to a cell. A vector stands in its own cell
and in the neighbouring cells nearest to it; vectors that share a cell are verified by cosine in
double precision. A pair counts in the smallest cell it shares only.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected
from .rows import runs, written

SHARD = 256


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: steps from a lattice point to its neighbours."""
    found = []
    for i in range(8):
        for j in range(i):
            for a, b in product((1.0, -1.0), repeat=2):
                step = np.zeros(8)
                step[i], step[j] = a, b
                found.append(step)
    found += [np.array(s) for s in product((0.5, -0.5), repeat=8)
              if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest whole-numbered points with an even sum."""
    near = np.rint(x)
    gap = x - near
    odd = near.sum(axis=1) % 2 != 0
    at = np.abs(gap).argmax(axis=1)
    rows = np.flatnonzero(odd)
    near[rows, at[rows]] += np.where(gap[rows, at[rows]] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer of the D8 point and the shifted D8 point."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def unit_vector(values) -> np.ndarray | None:
    """The vector at length one in double precision; None if it links with nothing."""
    if values is None or len(values) == 0 or any(v is None for v in values):
        return None
    v = np.array(values, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v) + 0.0


class Cells:
    """Cells of vectors of one dimension in all tables, own cell first in each table."""

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, probes: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.tables, self.blocks, self.probes = dim, tables, blocks, probes
        self.maps = rng.standard_normal((tables, blocks, dim, 8))
        for t in range(tables):
            for b in range(blocks):
                if dim >= 8:
                    self.maps[t, b] = np.linalg.qr(self.maps[t, b])[0]
                else:
                    self.maps[t, b] /= np.linalg.norm(self.maps[t, b], axis=1, keepdims=True) + 1
        self.maps *= scale * (dim / 64) ** 0.5 if dim >= 8 else scale
        self.shift = rng.random((tables, blocks, 8))
        self.mix = rng.integers(1, 2 ** 63, (tables, blocks * 8), dtype=np.int64).astype(
            np.uint64) | np.uint64(1)
        self.steps = roots()

    def of(self, units: np.ndarray) -> np.ndarray:
        """uint64 cells, one row a vector: 1 + probes in each table."""
        out = []
        for t in range(self.tables):
            points, others, costs = [], [], []
            for b in range(self.blocks):
                x = units @ self.maps[t, b] + self.shift[t, b]
                near = nearest_e8(x)
                cost = 2 - 2 * (x - near) @ self.steps.T
                few = np.argsort(cost, axis=1, kind="stable")[:, :self.probes]
                points.append(near)
                others.append(near[:, None] + self.steps[few])
                costs.append(np.take_along_axis(cost, few, axis=1))
            own = np.concatenate(points, axis=1)
            cells = [own[:, None]]
            for b in range(self.blocks):
                moved = np.repeat(own[:, None], self.probes, axis=1)
                moved[:, :, 8 * b:8 * b + 8] = others[b]
                cells.append(moved)
            every = np.concatenate(cells, axis=1)
            order = np.argsort(np.concatenate(costs, axis=1), axis=1, kind="stable")
            picked = np.concatenate([np.zeros((len(units), 1), int), order[:, :self.probes] + 1], 1)
            every = np.take_along_axis(every, picked[:, :, None], axis=1)
            twice = np.rint(2 * every).astype(np.int64).astype(np.uint64)
            code = (twice * self.mix[t]).sum(axis=2, dtype=np.uint64)
            code ^= code >> np.uint64(31)
            out.append(code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.dim * 64 + t))
        return np.concatenate(out, axis=1)


def parts_of(near: np.ndarray) -> np.ndarray:
    """Smallest member of the connected part of each node of a symmetric adjacency."""
    label = np.arange(len(near))
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], len(label)).min(axis=1, initial=len(label)))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def pairs_in_cell(cell: int, vectors: np.ndarray, cells: np.ndarray, copies: np.ndarray,
                  own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs between the own and the other vectors of a unit (all own: among them).

    Returns each vector's partners (with their copies) over pairs whose smallest common cell is
    this one, and the smallest place of its part over all verified pairs.
    """
    near = vectors @ vectors.T >= least
    np.fill_diagonal(near, False)
    if not own.all():
        near &= own[:, None] != own[None, :]
    lower = np.unique(cells[cells < cell])
    if len(lower) and near.any():
        stands = np.zeros((len(cells), len(lower)), np.float32)
        at = np.searchsorted(lower, cells)
        rows, columns = np.nonzero(cells < cell)
        stands[rows, at[rows, columns]] = 1
        first = stands @ stands.T == 0
    else:
        first = np.ones_like(near)
    return (near & first) @ copies, parts_of(near)


def lattice_links(points: DataFrame, least: float = 0.95, tables: int = 6, blocks: int = 2,
                  scale: float = 5.0, probes: int = 4, seed: int = 5,
                  shard: int = SHARD) -> DataFrame:
    """Links and classes of vector points: point_id, n_links, component_id, kept.

    points: point_id (long), vector (array of numbers). Vectors whose cosine is least or more are
    linked; n_links counts the other points linked directly, component_id is the smallest point_id
    reachable and kept marks the point of that id. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, and so do vectors of different length with each
    other. Equal vectors are one node with a count of copies. Vectors of a cell are cut into shards
    of bounded size; a unit of work holds two shards, so a crowded cell is spread over tasks.
    Rows that repeat a point_id are one node of the classes; rows without one link with nothing
    and are kept.
    """
    def normed(batches):
        for batch in batches:
            units = [None if i is None else unit_vector(v) for i, v in zip(*(
                batch.column(c).to_pylist() for c in ("point_id", "vector")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("point_id").cast(pa.int64()),
                 pa.array([None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16)
                           .digest() for u in units], pa.binary()),
                 pa.array([None if u is None else u.tobytes() for u in units], pa.binary())],
                ["point_id", "key", "unit"])

    def celled(batches):
        known: dict[int, Cells] = {}
        for batch in batches:
            units = [np.frombuffer(u) for u in batch.column("unit").to_pylist()]
            found: list = [None] * len(units)
            for dim in {len(u) for u in units}:
                if dim not in known:
                    known[dim] = Cells(dim, tables, blocks, scale, probes, seed)
                at = [i for i, u in enumerate(units) if len(u) == dim]
                for i, row in zip(at, known[dim].of(np.array([units[i] for i in at])), strict=True):
                    found[i] = np.unique(row).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int64()))],
                [*batch.schema.names, "cells"])

    ready = written(points.select(F.col("point_id").cast("long").alias("point_id"), "vector")
                    .mapInArrow(normed, "point_id long, key binary, unit binary"), "units")
    nodes = (ready.filter(F.col("key").isNotNull()).groupBy("key")
             .agg(F.min("point_id").alias("node"), F.count(F.lit(1)).alias("copies"),
                  F.first("unit").alias("unit")))
    nodes = written(nodes.mapInArrow(
        celled, "key binary, node long, copies long, unit binary, cells array<long>"), "nodes")
    entries = nodes.select("key", F.explode("cells").alias("cell"))
    sizes = (entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
             .select("cell", F.ceil(F.col("n") / shard).cast("int").alias("shards")))
    held = (entries.join(written(sizes, "sizes"), "cell")
            .withColumn("own", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
            .select("key", "cell", "own", F.least("own", "other").alias("low"),
                    F.greatest("own", "other").alias("high")))
    units = written(held, "held").join(nodes, "key")
    keys = ["cell", "low", "high"]

    def verify(batches):
        for run in runs(batches, keys):
            cell = np.array([run.column("cell")[0].as_py()], np.int64).view(np.uint64)[0]
            low, high = run.column("low")[0].as_py(), run.column("high")[0].as_py()
            own = run.column("own").to_numpy() == low if low != high else \
                np.ones(run.num_rows, bool)
            names = np.array(run.column("node").to_pylist(), np.int64)
            vectors = [np.frombuffer(u) for u in run.column("unit").to_pylist()]
            lists = run.column("cells").to_pylist()
            for dim in {len(v) for v in vectors}:
                at = np.array([i for i, v in enumerate(vectors) if len(v) == dim])
                wide = max(len(lists[i]) for i in at)
                cells = np.array([lists[i] + [lists[i][0]] * (wide - len(lists[i])) for i in at],
                                 np.int64).view(np.uint64)
                counts, parts = pairs_in_cell(
                    cell, np.array([vectors[i] for i in at]), cells,
                    run.column("copies").to_numpy()[at], own[at], least)
                told = np.flatnonzero((counts > 0) | (parts != np.arange(len(at))))
                if len(told):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(run.column("key").take(pa.array(at[told])).to_pylist(),
                                  pa.binary()),
                         pa.array(counts[told].astype(np.int64)), pa.array(names[at[told]]),
                         pa.array(names[at[parts[told]]])], ["key", "partners", "a", "b"])

    found = written(units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        verify, "key binary, partners long, a long, b long"), "verified")
    counts = found.groupBy("key").agg(F.sum("partners").alias("partners"))
    classes = connected(found.select("a", "b"))
    named = (nodes.select("key", "node", "copies").join(counts, "key", "left")
             .join(classes.withColumnRenamed("id", "node"), "node", "left")
             .select("key", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0)))
                     .alias("links"), F.coalesce("component", "node").alias("component")))
    return (ready.select("point_id", "key").join(written(named, "named"), "key", "left")
            .select("point_id", F.coalesce("links", F.lit(0)).alias("n_links"),
                    F.coalesce("component", "point_id").alias("component_id"),
                    (F.coalesce("component", "point_id").eqNullSafe(F.col("point_id")))
                    .alias("kept")))
