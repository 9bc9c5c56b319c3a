"""Exact vector retrieval by tiles, hit aggregation, rerank fusion and description search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, normalize_code, strip
from ..functions.vectors import SCORE_DIGITS, unit
from ..plans.scale import cut_lineage, salted_lookup, top_k

TILE_ROWS = 4096
CELL_ROWS = 1024
MAX_CENTERS, SAMPLE_ROWS = 1024, 4096
# Added to bounds before they are compared, for the rounding of angles and scores.
SLACK = 1e-6
CHILD_POOL = 300
# Query tiles of a large group, hits that one task holds at most, and rows of a tile whatever k is.
QUERY_TILES, HELD_HITS, MAX_TILE = 16, 5_000_000, 32_768
# Queries that are multiplied at once, and points of a task's pool before unused ones go.
BLOCK_ROWS, POOL_ROWS = 1024, 200_000
# One of so many points comes before the cells, for a first k-th score.
SEED_EVERY = 8


def tile_pairs(q: DataFrame, p: DataFrame, tile_rows: int) -> tuple:
    """Group both sides by (group, query tile, point tile), every tile about tile_rows rows.

    q holds group and qid, p holds group and pid; all columns travel along.
    """
    sizes = (q.select("group", F.lit(1).alias("nq"), F.lit(0).alias("np"))
             .unionByName(p.select("group", F.lit(0).alias("nq"), F.lit(1).alias("np")))
             .groupBy("group").agg(*[F.greatest(F.ceil(F.sum(c) / tile_rows), F.lit(1)).cast("int")
                                     .alias(t) for c, t in (("nq", "qts"), ("np", "pts"))]))

    def tiled(side: DataFrame, id_column: str, own: str, other: str, own_count: str,
              other_count: str) -> DataFrame:
        placed = salted_lookup(side, sizes, ["group"], id_column, how="inner")
        return placed.select(
            *side.columns, F.pmod(F.xxhash64(id_column), F.col(own_count)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)).alias(other))

    key = ["group", "qt", "pt"]
    return (tiled(q, "qid", "qt", "pt", "qts", "pts").groupBy(*key),
            tiled(p, "pid", "pt", "qt", "pts", "qts").groupBy(*key))


def _centers(points: DataFrame, cell_rows: int) -> np.ndarray:
    """Unit centers of cells, far from each other first, from at most SAMPLE_ROWS points.

    Any centers give exact results; the sample, the first points by a hash of pid, only decides how
    tight the cells are. Up to MAX_CENTERS of them, one per cell_rows points.
    """
    rows = (points.select("vector", F.xxhash64("pid").alias("at"), "pid")
            .orderBy("at", "pid").limit(SAMPLE_ROWS).select("vector").toPandas())
    if len(rows) <= cell_rows:
        return np.zeros((1, 1 if rows.empty else len(rows["vector"].iloc[0])))
    sample, length = _directions(np.stack(rows["vector"].to_numpy()))
    sample = sample[length > 0] if length.any() else sample[:1]
    count = MAX_CENTERS if len(rows) == SAMPLE_ROWS else min(MAX_CENTERS, -(-len(rows) // cell_rows))
    chosen, closest = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, sample @ sample[chosen[-1]])
    centers = sample[chosen]
    for _ in range(3):
        at = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 0, sums / np.where(length > 0, length, 1.0), centers)
    return centers


def _directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length (zero stays zero) and their lengths."""
    length = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(length > 0, length, 1.0)[:, None], length


def _angles(vectors: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit_length, length = _directions(vectors)
    return np.arccos(np.clip(unit_length @ centers.T, -1.0, 1.0)), length


def _celled(points: DataFrame, centers: np.ndarray, cell_rows: int) -> DataFrame:
    """Points with the cell of their nearest center; its number only orders the points.

    A group uses as many of the centers as it has cells of cell_rows points.
    """
    sizes = points.groupBy("room").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int")
                                       .alias("cells"))
    sized = salted_lookup(points, sizes, ["room"], "id", how="inner")

    @F.pandas_udf("int")
    def cell(vectors: pd.Series, cells: pd.Series) -> pd.Series:
        angle = _angles(np.stack(vectors.to_numpy()), centers)[0]
        angle[np.arange(len(centers))[None, :] >= cells.to_numpy()[:, None]] = np.inf
        return pd.Series(angle.argmin(axis=1).astype("int32"))

    return sized.withColumn("cell", cell("vector", "cells")).drop("cells")


def _ordered(row: np.ndarray, value: np.ndarray, at: np.ndarray, names, k: int) -> tuple:
    """The k hits of highest value per row, ties to the smaller name; names(at) gives names."""
    order = np.lexsort((-value, row))
    row, value, at = row[order], value[order], at[order]
    tie = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    if tie.any():
        spots = np.flatnonzero(np.append(tie, False) | np.append(False, tie))
        run = np.cumsum(np.append(True, ~tie))[spots]
        used, inverse = np.unique(at[spots], return_inverse=True)
        place = np.empty(len(used), int)
        place[np.argsort(names(used), kind="stable")] = np.arange(len(used))
        at[spots] = at[spots][np.lexsort((place[inverse], run))]
    first = np.searchsorted(row, np.arange(row[-1] + 1 if len(row) else 0))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], value[keep], at[keep]


class _Block:
    """The best hits so far of some queries of a tile, and those that wait to be merged."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, skip_self: bool):
        self.ids, self.vectors, self.k, self.skip_self = ids, vectors, k, skip_self
        self.directions, self.length = _directions(vectors)
        self.kth = np.full(len(ids), -np.inf)
        self.best = np.empty(0, int), np.empty(0), np.empty(0, int)
        self.waiting, self.count = [], 0

    def meet(self, names: np.ndarray, vectors: np.ndarray, base: int, cap: tuple) -> int:
        """Take the points whose bound reaches the k-th score; returns the pairs computed.

        Angles obey the triangle inequality, so no point is closer to a query than the difference
        of their angles to a center allows; lengths scale the cosine.
        """
        center, low, high, shortest, longest = cap
        angle = np.arccos(np.clip(self.directions @ center, -1.0, 1.0))
        cosine = np.cos(np.maximum(0.0, np.maximum(angle - high, low - angle)))
        bound = self.length * cosine * np.where(cosine >= 0, longest, shortest)
        asked = np.flatnonzero(~(np.maximum(bound, -1.0) + SLACK < self.kth))
        if not len(asked):
            return 0
        scores = np.clip(self.vectors[asked] @ vectors.T, -1.0, 1.0)
        if np.isnan(scores).any():
            scores[np.isnan(scores)] = -np.inf
        floor = self.kth[asked] - SLACK
        empty = np.flatnonzero(np.isneginf(floor))
        size = self.k + self.skip_self
        if len(empty) and scores.shape[1] > size:
            floor[empty] = np.partition(scores[empty], -size, axis=1)[:, -size] - SLACK
        row, col = np.nonzero(scores >= floor[:, None])
        value = np.round(scores[row, col], SCORE_DIGITS)
        fit = np.isfinite(value)
        if self.skip_self:
            fit &= self.ids[asked[row]] != names[col]
        self.waiting.append((asked[row][fit], value[fit], base + col[fit]))
        self.count += int(fit.sum())
        return scores.size

    def merge(self, names) -> None:
        row, value, at = (np.concatenate(c) for c in zip(self.best, *self.waiting, strict=True))
        self.best = row, value, at = _ordered(row, value, at, names, self.k)
        self.waiting, self.count = [], 0
        held = np.bincount(row, minlength=len(self.ids))
        last = np.cumsum(held) - 1
        full = held >= self.k
        self.kth[full] = value[last[full]]


class _Tile:
    """One tile of queries, which all points of its group pass."""

    def __init__(self, k: int, skip_self: bool):
        self.k, self.skip_self = k, skip_self
        self.asked, self.blocks, self.visited = [], None, 0
        self.pool, self.rows, self.limit = [], 0, POOL_ROWS

    def ask(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.asked.append((ids, vectors))

    def _split(self) -> list:
        """Blocks of queries in the order of their ids; equal ids share a block."""
        ids, vectors = (np.concatenate(c) for c in zip(*self.asked, strict=True))
        order = np.argsort(ids, kind="stable")
        ids, vectors, self.asked = ids[order], vectors[order], []
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        cuts = np.append(starts[np.searchsorted(starts, np.arange(0, len(ids), BLOCK_ROWS),
                                                "right") - 1], len(ids))
        cuts = np.unique(cuts)
        return [_Block(ids[a:b], vectors[a:b], self.k, self.skip_self)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _names(self, at: np.ndarray) -> np.ndarray:
        self.pool = [pa.concat_tables(self.pool).combine_chunks()]
        return self.pool[0].column("id").take(pa.array(at)).to_numpy(zero_copy_only=False)

    def meet(self, points: pa.Table, vectors: np.ndarray) -> None:
        if self.blocks is None:
            self.blocks = self._split() if self.asked else []
        if not self.blocks:
            return
        names = points.column("id").to_numpy()
        directions, length = _directions(vectors)
        center = directions.mean(axis=0)
        center = center / (np.linalg.norm(center) or 1.0)
        angle = np.arccos(np.clip(directions @ center, -1.0, 1.0))
        cap = center, angle.min(), angle.max(), length.min(), length.max()
        self.pool.append(points)
        for block in self.blocks:
            self.visited += block.meet(names, vectors, self.rows, cap)
            if block.count >= len(block.ids) * self.k:
                block.merge(self._names)
        self.rows += len(names)
        if self.rows > self.limit:
            self._tidy()

    def _tidy(self) -> None:
        """Drop points from the pool that no query holds."""
        for block in self.blocks:
            if block.waiting:
                block.merge(self._names)
        used = np.zeros(self.rows, bool)
        for block in self.blocks:
            used[block.best[2]] = True
        place = np.cumsum(used) - 1
        for block in self.blocks:
            block.best = (*block.best[:2], place[block.best[2]])
        self.pool = [pa.concat_tables(self.pool).combine_chunks().take(
            pa.array(np.flatnonzero(used)))]
        self.rows = self.pool[0].num_rows
        self.limit = max(POOL_ROWS, 2 * self.rows)

    def hits(self) -> Iterator[tuple]:
        """(qid, points, score, rank) of each block."""
        for block in self.blocks or []:
            if block.waiting:
                block.merge(self._names)
            row, value, at = block.best
            if not len(row):
                continue
            starts = np.append(True, block.ids[1:] != block.ids[:-1])
            if not starts.all():
                row, value, at = _ordered((np.cumsum(starts) - 1)[row], value, at, self._names,
                                          self.k)
            held = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            rank = np.arange(len(row)) - np.repeat(held, np.diff(np.append(held, len(row)))) + 1
            self._names(at[:0])
            yield block.ids[starts][row], self.pool[0].take(pa.array(at)), value, rank


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = pc.list_value_length(column)
    if lengths.null_count or pc.count_distinct(lengths).as_py() != 1:
        raise ValueError("vectors must not be null and need equal lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _stream_best(k: int, skip_self: bool, carried: list[str], count: bool):
    """Task kernel: tiles of queries one after the other, each followed by its points."""

    def results(group, tile: _Tile) -> Iterator[pa.RecordBatch]:
        if count:
            yield pa.RecordBatch.from_pydict({
                "group": pa.array([group], pa.string()),
                "visited": pa.array([tile.visited], pa.int64())})
            return
        for qid, points, score, rank in tile.hits():
            columns = {"group": pa.array([group] * len(qid), pa.string()),
                       "qid": pa.array(qid, pa.string()), "pid": points.column("id"),
                       "score": pa.array(score), "rank": pa.array(rank.astype("int32"))}
            for name in carried:
                columns[name] = points.column(name)
            yield from pa.table(columns).combine_chunks().to_batches()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, tile = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).to_numpy(zero_copy_only=False)
                     for c in ("room", "tile", "turn", "cell")]
            change = np.any([m[1:] != m[:-1] for m in marks], axis=0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                here = marks[0][start], marks[1][start]
                part = batch.slice(start, end - start)
                if here != key:
                    if tile is not None:
                        yield from results(group, tile)
                    key, group, tile = here, part.column("group")[0].as_py(), _Tile(k, skip_self)
                vectors = _matrix(part.column("vector"))
                if marks[2][start] == 0:
                    tile.ask(part.column("id").to_numpy(zero_copy_only=False), vectors)
                else:
                    tile.meet(pa.table({c: part.column(c) for c in ("id", *carried)}), vectors)
        if tile is not None:
            yield from results(group, tile)

    return kernel


def _search(queries: DataFrame, points: DataFrame, k: int, group: str | None, skip_self: bool,
            tile_rows: int, cell_rows: int, carry: tuple = (), count: bool = False) -> DataFrame:
    g = F.col(group).cast("string") if group else F.lit("all")
    schema = {f.name: f.dataType for f in points.schema.fields}
    place = {c: f"carried_{at}" for at, c in enumerate(carry)}

    def side(df: DataFrame, name: str, extra: list) -> DataFrame:
        own = df.select(g.alias("group"), F.col(name).cast("string").alias("id"),
                        F.col("vector").cast("array<double>").alias("vector"), *extra)
        return own.withColumn("room", F.concat_ws("\x01", F.lit(""), "group"))

    q = side(queries, "qid", [F.lit(None).cast(schema[c]).alias(n) for c, n in place.items()])
    p = side(points, "pid", [F.col(c).alias(n) for c, n in place.items()])
    held = min(MAX_TILE, max(1, HELD_HITS // k))
    asked = F.sum("asked")
    sizes = cut_lineage(
        q.select("room", F.lit(1).alias("asked")).unionByName(p.select("room", F.lit(0).alias("asked")))
        .groupBy("room").agg(F.greatest(F.lit(1), F.least(F.ceil(asked / tile_rows), F.greatest(
            F.lit(QUERY_TILES), F.ceil(asked / held)))).cast("int").alias("tiles"),
            asked.alias("asked"), F.count(F.lit(1)).alias("rows"))
        .filter((F.col("asked") > 0) & (F.col("rows") > F.col("asked"))).select("room", "tiles"))
    tiles = sizes.agg(F.coalesce(F.sum("tiles"), F.lit(1))).first()[0]
    centers = _centers(p.select("vector", F.col("id").alias("pid")), cell_rows) if cell_rows else []
    if len(centers) > 1:
        p = _celled(p, centers, cell_rows).withColumn("turn", F.when(
            F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SEED_EVERY)) == 0, 1).otherwise(2))
        p = p.withColumn("cell", F.when(F.col("turn") == 1, 0).otherwise(F.col("cell")))
    else:
        p = p.withColumns({"turn": F.lit(1), "cell": F.lit(0)})
    q = salted_lookup(q, sizes, ["room"], "id", how="inner").withColumns({
        "tile": F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"), "turn": F.lit(0),
        "cell": F.lit(0)})
    p = salted_lookup(p, sizes, ["room"], "id", how="inner").withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # More partitions than tiles, so that few of them meet in one.
    placed = q.unionByName(p).drop("tiles").repartition(
        min(4 * tiles, 2000), "room", "tile").sortWithinPartitions("room", "tile", "turn", "cell")
    if count:
        return placed.mapInArrow(_stream_best(k, skip_self, [], True),
                                 "group string, visited bigint")
    out = "group string, qid string, pid string, score double, rank int" + "".join(
        f", {n} {schema[c].simpleString()}" for c, n in place.items())
    return placed.mapInArrow(_stream_best(k, skip_self, list(place.values()), False),
                             out).withColumnsRenamed({n: c for c, n in place.items()})


def nearest(queries: DataFrame, points: DataFrame, k: int, group: str | None = None,
            skip_self: bool = False, tile_rows: int = TILE_ROWS,
            cell_rows: int = CELL_ROWS, carry: tuple = ()) -> DataFrame:
    """Exact k points of highest dot product per query: (group, qid, pid, score, rank, carried).

    queries: qid, vector [, group]; points: pid, vector [, group]; vectors of equal length, scores
    are cut to [-1, 1] and rounded to nine digits, ties go to the smaller pid. Queries meet points
    of the same group only. Further columns of the points, named by carry, come with their hits.

    Queries lie in tiles of tile_rows, or more in large groups, at most QUERY_TILES of them while a
    task can hold their hits. The points of the group pass each tile as a stream in batches, so a
    task holds one tile, its k best hits per query and one batch; no hit beyond these leaves a task,
    and neither a pair table nor a whole group ever exists in one place. Some points come first for
    a k-th score, the others by cells around centers: a query is not multiplied with a batch of a
    cell whose range of angles and lengths cannot reach its k-th score. The centers, at most
    MAX_CENTERS, are all that tasks share; cell_rows 0 goes without them.
    """
    return _search(queries, points, k, group, skip_self, tile_rows, cell_rows, carry)


def visited_share(queries: DataFrame, points: DataFrame, k: int, group: str | None = None,
                  skip_self: bool = False, tile_rows: int = TILE_ROWS,
                  cell_rows: int = CELL_ROWS) -> DataFrame:
    """(group, visited, possible): pairs of query and point that a search computes, of all."""
    done = _search(queries, points, k, group, skip_self, tile_rows, cell_rows, count=True).groupBy(
        "group").agg(F.sum("visited").alias("visited"))
    g = F.col(group).cast("string") if group else F.lit("all")
    every = (queries.groupBy(g.alias("group")).agg(F.count(F.lit(1)).alias("q"))
             .join(points.groupBy(g.alias("group")).agg(F.count(F.lit(1)).alias("n")), "group"))
    return done.join(every, "group").select(
        "group", "visited", (F.col("q") * F.col("n")).alias("possible"))


def with_vectors(df: DataFrame, text: str, embed=None, size: int | None = None,
                 name: str = "vector") -> DataFrame:
    """Vector per distinct text. ``embed`` maps a string column to an array column (for example a
    pandas UDF over batches); a given size is checked on every vector."""
    texts = df.select(text).distinct()
    vectors = texts.withColumn(name, embed(blank(F.col(text))))
    if size is not None:
        wrong = F.concat(F.lit("embedding dim mismatch: expected "), F.lit(size))
        vectors = vectors.withColumn(name, F.when(F.size(name) == size, F.col(name)).otherwise(
            F.raise_error(wrong)))
    return df.join(vectors, text, "left")


def batch_embedder(encode=None, batch_size: int = 64, load=None, model: str = ""):
    """Column function from ``encode(list of texts) -> list of vectors``, run on Arrow batches.

    Instead of encode, ``load()`` may return it: a Python worker calls it once per model name and
    keeps the result for its later tasks.
    """
    if (encode is None) == (load is None):
        raise ValueError("give encode or load")

    @F.pandas_udf("array<double>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encode or worker_model(model, load)
        for texts in batches:
            texts = texts.fillna("").tolist()
            out = []
            for start in range(0, len(texts), batch_size):
                out.extend(list(map(float, v)) for v in run(texts[start:start + batch_size]))
            yield pd.Series(out)
    return udf


_WORKER_MODELS: dict = {}


def worker_model(name: str, load):
    """The model of a name in this Python worker, loaded on first use."""
    if name not in _WORKER_MODELS:
        _WORKER_MODELS[name] = load()
    return _WORKER_MODELS[name]


def stored_vectors(df: DataFrame, text: str, path: str, embed, size: int, model: str) -> DataFrame:
    """Rows with the vector of their text from a stored table; only texts it lacks are embedded.

    The table below path holds text_hash and vector per model. Its new rows are appended in one
    job, so a lost run adds nothing; a vector of another size fails the run. One writer at a time.
    """
    spark = df.sparkSession
    place = f"{path}/model={model}"
    schema = "text_hash binary, vector array<double>"
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def table() -> DataFrame:
        if not files.exists(folder):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(place)

    hashed = F.unhex(F.sha2(blank(F.col(text)).cast("binary"), 256))
    texts = df.select(blank(F.col(text)).alias("text"), hashed.alias("text_hash")).distinct()
    unseen = cut_lineage(texts.join(table(), "text_hash", "left_anti"))
    if not unseen.isEmpty():
        with_vectors(unseen, "text", embed, size).select("text_hash", "vector").write.mode(
            "append").parquet(place)
    keyed = df.withColumn("text_hash", hashed)
    return keyed.join(table(), "text_hash", "left").drop("text_hash")


def child_hits(requests: DataFrame, children: DataFrame, pool: int = CHILD_POOL,
               group: str | None = None, min_score: float | None = None) -> DataFrame:
    """Hits of requests (request_id, vector [, group]) among children (child_id, vector, ...)."""
    extra = [group] if group else []
    carried = [c for c in children.columns if c not in ("child_id", "vector")]
    child = F.col("child_id").cast("string").alias("child_id")
    # Every hit of an id meets all rows of that id, so that hits need no join of their own.
    rows = children.groupBy(child).agg(F.collect_list(F.struct(
        F.lit(True).alias("held"), *carried)).alias("rows"))
    found = nearest(
        requests.select(F.col("request_id").alias("qid"), unit(F.col("vector")).alias("vector"),
                        *extra),
        children.select(child, unit(F.col("vector")).alias("vector"), *extra).join(
            rows, "child_id", "left").withColumnRenamed("child_id", "pid"),
        pool, group, carry=("rows",))
    if min_score is not None:
        found = found.filter(F.col("score") >= min_score)
    return found.select(F.col("pid").alias("child_id"), F.col("qid").alias("request_id"), "score",
                        "rank", F.explode("rows").alias("row")).select(
        "child_id", "request_id", "score", "rank", *(F.col(f"row.{c}").alias(c) for c in carried))


def by1_from_hits(hits: DataFrame, request_forms: DataFrame | None = None, k: int = 50,
                  evaluation: bool = False) -> DataFrame:
    """Variety candidates per request from vector hits, best first, at most 50.

    hits: request_id, by1, form_code, support, example, description, score, rank. Candidates are
    ordered by the score of four digits, ties by their best hit; with evaluation by the score
    itself (nine digits), ties by the code downwards.
    """
    k = max(1, min(int(k), 50))
    if request_forms is not None:
        forms = request_forms.select(F.col("request_id").cast("string").alias("request_id"),
                                     normalize_code(F.col("form_code")).alias("request_form"))
        hits = hits.join(forms, "request_id", "left")
    else:
        hits = hits.withColumn("request_form", F.lit(""))
    asked = F.coalesce(F.col("request_form"), F.lit(""))
    text = F.coalesce(F.nullif(blank(F.col("example")), F.lit("")), blank(F.col("description")))
    # Written by column, then cut to three hits and to sums before any shuffle.
    placed = cut_lineage(hits.filter(blank(F.col("by1")) != "").select(
        "request_id", "by1", "rank", "score", F.coalesce(F.col("support"), F.lit(1)).alias("support"),
        text.alias("text"), ((asked != "") & (F.col("form_code") == asked)).alias("fits")))
    key = ["request_id", "by1"]
    totals = placed.groupBy(*key).agg(
        F.max("score").alias("best"), F.min("rank").alias("first_hit"),
        F.sum("support").cast("bigint").alias("support"), F.max("fits").alias("form_match"))
    top3 = top_k(placed.select(*key, "rank", "score", "text"), key, [F.asc("rank")], 3, "at").groupBy(
        *key).agg(F.array_sort(F.collect_list(F.struct("at", "score", "text"))).alias("texts"))
    grouped = totals.unionByName(top3, allowMissingColumns=True).groupBy(*key).agg(
        *(F.max(c).alias(c) for c in ("best", "first_hit", "support", "form_match", "texts")))
    grouped = grouped.withColumn("mean3", F.aggregate(
        "texts.score", F.lit(0.0), lambda a, x: a + x) / F.size("texts"))
    score = 0.85 * F.col("best") + 0.15 * F.col("mean3") + F.when(
        F.col("form_match"), 0.03).otherwise(0.0)
    scored = grouped.select(
        "request_id", "by1", F.bround(score, 4).alias("score"),
        F.bround("best", 4).alias("vector_score"), "support", "form_match",
        F.col("texts.text").alias("matched_descriptions"), "first_hit",
        F.round(score, 9).alias("exact"))
    order = ([F.desc("exact"), F.desc("by1")] if evaluation
             else [F.desc("score"), F.asc("first_hit"), F.asc("by1")])
    return top_k(scored, ["request_id"], order, k).drop("first_hit", "exact")


def parse_rerank_payloads(payloads: DataFrame) -> DataFrame:
    """Scores per document from (request_id, payload JSON, document_count).

    The list may stand under results, data or scores, or be the payload itself; entries are
    numbers or objects. Entries out of range or without a finite score are dropped.
    """
    text = F.trim(F.col("payload"))
    held = F.from_json(text, "results string, data string, scores string")
    items = F.when(text.startswith("["), text).otherwise(
        F.coalesce(held["results"], held["data"], held["scores"]))
    entries = payloads.select("request_id", "document_count", F.posexplode(
        F.from_json(items, "array<string>")).alias("position", "item"))
    item = F.col("item")
    is_object = item.startswith("{")
    index = F.when(is_object, F.coalesce(
        F.get_json_object(item, "$.index"), F.get_json_object(item, "$.document_index"),
        F.col("position").cast("string"))).otherwise(F.col("position").cast("string"))
    value = F.when(is_object, F.coalesce(
        F.get_json_object(item, "$.relevance_score"), F.get_json_object(item, "$.score"))
    ).otherwise(item)
    scored = entries.select(
        "request_id", "document_count", "position",
        index.try_cast("double").try_cast("int").alias("document"),
        value.try_cast("double").alias("score"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return (scored.filter(finite & (F.col("document") >= 0)
                          & (F.col("document") < F.col("document_count")))
            .groupBy("request_id", "document").agg(
                F.max_by("score", "position").alias("score")))


def rerank_documents(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """What a reranker reads: (request_id, by1, rerank_query, document) per candidate.

    requests: request_id, query, form_code. The document names the variety and up to three of its
    matched descriptions; blank ones are left out.
    """
    asked = requests.select("request_id", F.concat_ws(
        " ", *[F.nullif(strip(blank(F.col(c))), F.lit("")) for c in ("query", "form_code")])
        .alias("rerank_query"))
    texts = F.filter(F.transform("matched_descriptions", lambda t: strip(blank(t))),
                     lambda t: t != "")
    document = strip(F.concat(F.col("by1"), F.lit(": "), F.array_join(F.slice(texts, 1, 3), " | ")))
    return candidates.select("request_id", "by1", document.alias("document")).join(
        asked, "request_id")


def fuse_rerank(candidates: DataFrame, scores: DataFrame, key: str = "by1") -> DataFrame:
    """Blend reranker scores into candidates (request_id, key, rank, score, vector_score,
    form_match, support); a request without a score for every candidate keeps its order."""
    joined = candidates.join(
        scores.select("request_id", key, F.col("score").alias("rr")), ["request_id", key], "left")
    all_of = Window.partitionBy("request_id")
    low, high = F.min("rr").over(all_of), F.max("rr").over(all_of)
    complete = F.count("rr").over(all_of) == F.count(F.lit(1)).over(all_of)
    staged = joined.withColumns({"used": complete, "low": low, "span": high - low})
    scaled = F.when(F.col("span") > 0, (F.col("rr") - F.col("low")) / F.col("span")).otherwise(0.5)
    fused = F.bround(
        0.70 * scaled + 0.20 * F.coalesce("vector_score", "score")
        + 0.05 * F.col("form_match").cast("double") + 0.05 * support_weight("support"), 4)
    staged = staged.withColumns({
        "old_rank": F.col("rank"), "reranker_used": F.col("used"),
        "reranker_score": F.when(F.col("used"), F.bround("rr", 4)),
        "score": F.when(F.col("used"), fused).otherwise(F.col("score"))})
    order = all_of.orderBy(F.when(F.col("used"), -F.col("score")).asc(), F.asc("old_rank"))
    return staged.withColumn("rank", F.row_number().over(order)).drop(
        "used", "low", "span", "rr", "old_rank")


def support_weight(support: str) -> Column:
    return F.least(F.log1p(F.greatest(F.col(support), F.lit(0)).cast("double")) / 6.0, F.lit(1.0))


def search_descriptions(requests: DataFrame, children: DataFrame, parents: DataFrame,
                        customer_specs: DataFrame | None = None, k: int = 10,
                        min_score: float | None = None) -> DataFrame:
    """Products per request: best child score, first matched texts, parent fields, customer specs.

    requests: request_id, vector, customer; children: child_id, parent_id, product_name,
    edesc_text, vector; parents: parent_id, product_name, edesc_count; customer_specs:
    product_name, customer, specs.
    """
    hits = child_hits(requests, children, 5 * k, min_score=min_score).filter(
        F.col("parent_id").isNotNull())
    placed = hits.withColumn("at", F.row_number().over(
        Window.partitionBy("request_id", "parent_id").orderBy("rank")))
    grouped = placed.groupBy("request_id", "parent_id").agg(
        F.max("score").alias("score"), F.min_by("product_name", "rank").alias("child_name"),
        F.array_sort(F.collect_list(F.when(F.col("at") <= 3, F.struct("at", "edesc_text"))))
        .alias("texts"))
    best = top_k(grouped, ["request_id"], [F.desc("score"), F.asc("parent_id")], k)
    named = best.join(parents.select("parent_id", "product_name", "edesc_count"), "parent_id",
                      "left").select(
        "request_id", "rank", "parent_id",
        F.coalesce("product_name", "child_name").alias("product_name"),
        F.coalesce("edesc_count", F.lit(0)).cast("bigint").alias("edesc_count"),
        "score", F.col("texts.edesc_text").alias("matched_texts"))
    if customer_specs is None:
        return named.withColumn("matched_specs", F.lit(None).cast("array<string>"))
    asked = requests.select(F.col("request_id").cast("string").alias("request_id"), "customer")
    rules = customer_specs.select("product_name", "customer", F.col("specs").alias("matched_specs"))
    return named.join(asked, "request_id").join(rules, ["product_name", "customer"], "left")
