"""Average-linkage clustering of description vectors inside every variety."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..plans.scale import cut_lineage, salted_lookup
from .templates import medoid_similarity, medoids, neighbor_similarity, vector_sum
from .vectors import TILE_ROWS, nearest

# Clustering thresholds.
PAIR_SIMILARITY = 0.75
MIN_ADJUSTED_SILHOUETTE = 0.18
MAX_CLUSTERS = 8
COUNT_PENALTY, SINGLETON_PENALTY = 0.05, 0.12
# Part clusters of a variety that one task cuts, and points that one task scores.
FINISH_PARTS = 16384
SLICE_ROWS = 4096


def _closest(rows: np.ndarray, means: np.ndarray, closed: np.ndarray, own: np.ndarray) -> tuple:
    """Similarity, rounded to nine digits, and place of the closest other open cluster per row.

    closed holds 0 or, for merged clusters, minus infinity; ties go to the smallest place.
    """
    similarity = rows @ means.T + closed
    similarity[np.arange(len(rows)), own] = -np.inf
    top = similarity.max(axis=1)
    row, col = np.nonzero(similarity >= (top - 2e-9)[:, None])
    best = np.round(top, 9)
    row, col = (x[np.round(similarity[row, col], 9) == best[row]] for x in (row, col))
    return best, col[np.searchsorted(row, np.arange(len(rows)))]


def _cuts(sums: np.ndarray, counts: np.ndarray, largest: int) -> dict[int, np.ndarray]:
    """Average-linkage labels for 2..largest clusters.

    The mean similarity of two clusters is the product of their vector sums over both counts, so
    means stand for clusters and no matrix of pairs is held. The pair of highest similarity, rounded
    to nine digits as in the search for neighbours, merges; ties go to the smallest first members.
    A merged cluster is no closer to a third than the closer of its halves was: a cluster whose
    neighbour merged keeps its old similarity as a bound and looks again only when that leads.
    """
    n = len(sums)
    label, name = np.arange(n), np.arange(n)
    means, size, closed = sums / counts[:, None], counts.astype(float).copy(), np.zeros(n)
    found = [_closest(means[at:at + 512], means, closed, np.arange(at, min(at + 512, n)))
             for at in range(0, n, 512)]
    best, partner = (np.concatenate(x) for x in zip(*found, strict=True))
    stale = np.zeros(n, bool)
    cuts = {}
    for remaining in range(n, 1, -1):
        if remaining <= largest:
            cuts[remaining] = np.unique(label, return_inverse=True)[1]
        a = int(np.argmax(best))
        while stale[a]:
            (best[a],), (partner[a],) = _closest(means[a:a + 1], means, closed, np.array([a]))
            stale[a] = False
            a = int(np.argmax(best))
        a, b = sorted((a, int(partner[a])))
        label[label == name[b]] = name[a]
        means[a] = (size[a] * means[a] + size[b] * means[b]) / (size[a] + size[b])
        size[a] += size[b]
        closed[b] = best[b] = -np.inf
        if remaining == 2:
            break
        row = np.round(means @ means[a] + closed, 9)
        row[a] = -np.inf
        of_pair = (partner == a) | (partner == b)
        stale |= of_pair & (row < best)
        nearer = (row > best) | (row == best) & (of_pair | (partner > a))
        nearer[b] = False
        best[nearer], partner[nearer] = row[nearer], a
        best[a], partner[a], stale[a], stale[b] = row.max(), int(row.argmax()), False, False
        if remaining - 1 < 0.7 * len(size):
            open_ = np.flatnonzero(closed == 0)
            partner = np.searchsorted(open_, partner[open_])
            means, size, closed, name, best, stale = (
                x[open_] for x in (means, size, closed, name, best, stale))
    return cuts


def point_silhouettes(vectors: np.ndarray, label: np.ndarray, sums: np.ndarray,
                      counts: np.ndarray) -> np.ndarray:
    """Cosine silhouette of points from cluster sums and counts alone."""
    distance = 1.0 - (vectors @ sums.T) / counts[None, :]
    own = counts[label]
    rows = np.arange(len(vectors))
    self_part = 1.0 - np.einsum("ij,ij->i", vectors, vectors)
    inner = (distance[rows, label] * own - self_part) / np.maximum(own - 1, 1)
    distance[rows, label] = np.inf
    outer = distance.min(axis=1)
    top = np.maximum(inner, outer)
    score = np.divide(outer - inner, top, out=np.zeros_like(top), where=top > 0)
    return np.where(own > 1, score, 0.0)


def merge_rounds(points: DataFrame, finish_parts: int = FINISH_PARTS,
                 tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """Reduce every variety to at most finish_parts part clusters, exactly.

    Average linkage is reducible: clusters that are each other's nearest neighbour merge in the
    full dendrogram whatever else happens, so all such pairs of a round merge at once. The seven
    widest pairs of a round wait, except that the closest pair of a variety always merges: the
    top seven merges of the dendrogram, which the cuts undo, are therefore never made here.

    The nearest neighbour of a part is kept from round to round. A merged cluster is no closer to
    a third part than the closer of its two halves was, so only parts that merged, or whose
    neighbour did, search again.

    Returns (members: by1, point_id, part; parts: by1, part, total, n; searches made in all).
    """
    members = cut_lineage(points.select("by1", "point_id", F.col("point_id").alias("part")))
    parts = cut_lineage(points.select("by1", F.col("point_id").alias("part"),
                                      F.col("vector").alias("total"),
                                      F.lit(1).cast("bigint").alias("n")))
    known, searches = None, 0
    while True:
        counts = parts.groupBy("by1").agg(F.count(F.lit(1)).alias("parts"))
        big = cut_lineage(counts.filter(F.col("parts") > finish_parts).select("by1"))
        if big.isEmpty():
            return members, parts, searches
        active = parts.join(big, "by1", "left_semi")
        side = active.select("by1", F.col("part").alias("a"), F.transform(
            "total", lambda x: x / F.col("n")).alias("vector"))
        asked = side if known is None else side.join(known.select("by1", "a"), ["by1", "a"],
                                                     "left_anti")
        named = F.concat_ws("\t", "by1", "a")
        found = nearest(asked.select(named.alias("qid"), "by1", "vector"),
                        side.select(named.alias("pid"), "by1", "vector"), 1, "by1", True, tile_rows, 0)
        found = cut_lineage(found.select(
            F.col("group").alias("by1"), F.substring_index("qid", "\t", -1).alias("a"),
            F.substring_index("pid", "\t", -1).alias("b"), "score"))
        searches += found.count()
        best = found if known is None else known.join(big, "by1", "left_semi").unionByName(found)
        back = best.select("by1", F.col("b").alias("a"), F.col("a").alias("b"))
        pairs = best.join(back, ["by1", "a", "b"]).filter(F.col("a") < F.col("b"))
        # Seven widest and the closest pair per variety: at most eight rows each.
        widest = _limit(pairs, [F.asc("score"), F.asc("a")], MAX_CLUSTERS - 1)
        closest = _limit(best.select(
            "by1", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
            .distinct(), [F.desc("score"), F.asc("a")], 1)
        merged = cut_lineage(
            pairs.join(widest.select("by1", "a", "b"), ["by1", "a", "b"], "left_anti")
            .select("by1", "a", "b").unionByName(closest.select("by1", "a", "b")).distinct())
        touched = merged.select("by1", F.explode(F.array("a", "b")).alias("part"))
        known = cut_lineage(
            best.join(touched.withColumnRenamed("part", "a"), ["by1", "a"], "left_anti")
            .join(touched.withColumnRenamed("part", "b"), ["by1", "b"], "left_anti")
            .select("by1", "a", "b", "score"))
        rename = merged.select("by1", F.col("b").alias("part"), F.col("a").alias("into"))
        renamed = parts.join(rename, ["by1", "part"], "left").withColumn(
            "part", F.coalesce("into", "part"))
        parts = cut_lineage(renamed.groupBy("by1", "part").agg(
            vector_sum("total").alias("total"), F.sum("n").alias("n")))
        members = cut_lineage(members.join(rename, ["by1", "part"], "left").select(
            "by1", "point_id", F.coalesce("into", "part").alias("part")))


def _limit(df: DataFrame, order: list, k: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("by1").orderBy(*order))
    return df.withColumn("_at", at).filter(F.col("_at") <= k).drop("_at")


def _cut_parts(parts: pd.DataFrame) -> pd.DataFrame:
    """Task kernel: labels of the bounded part clusters of a variety for every cut.

    The cut 0 is final: of varieties of one or two points, which have no silhouette.
    """
    parts = parts.sort_values("part", kind="stable")
    sums, counts = np.stack(parts["total"].to_numpy()), parts["n"].to_numpy().astype(float)
    points = int(counts.sum())
    if points > 2:
        cuts = _cuts(sums, counts, min(MAX_CLUSTERS, points - 1))
    elif points == 2 and len(parts) == 2 and np.clip(sums[0] @ sums[1], -1.0, 1.0) < PAIR_SIMILARITY:
        cuts = {0: np.array([0, 1])}
    else:
        cuts = {0: np.zeros(len(parts), int)}
    return pd.concat([pd.DataFrame({"by1": parts["by1"], "part": parts["part"], "k": k,
                                    "label": label}) for k, label in cuts.items()])


def _slice_silhouettes(key, points: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """Task kernel: silhouette totals of one slice of a variety for every cut."""
    out = []
    if not points.empty:
        vectors = np.stack(points["vector"].to_numpy())
        labels = np.stack(points["labels"].to_numpy())
        for at, k in enumerate(points["ks"].iloc[0]):
            cut = sums[sums["k"] == k].sort_values("label")
            score = point_silhouettes(vectors, labels[:, at], np.stack(cut["total"].to_numpy()),
                                      cut["n"].to_numpy().astype(float))
            out.append((key[0], int(k), float(score.sum()), len(score)))
    return pd.DataFrame(out, columns=["by1", "k", "score", "points"])


def label_points(points: DataFrame, finish_parts: int = FINISH_PARTS,
                 tile_rows: int = TILE_ROWS) -> DataFrame:
    """(by1, point_id, label, silhouette); points: by1, point_id, vector of unit length.

    Varieties of every size go the same way: rounds of merges down to finish_parts part clusters,
    one task that cuts these into 2 to 8 clusters, and silhouettes of all points in slices.
    """
    points = cut_lineage(points.select("by1", "point_id", "vector"))
    members, parts, _ = merge_rounds(points, max(finish_parts, MAX_CLUSTERS + 1), tile_rows)
    cuts = cut_lineage(parts.groupBy("by1").applyInPandas(
        _cut_parts, "by1 string, part string, k int, label int"))
    open_cuts = cuts.filter("k > 0")
    sums = cut_lineage(parts.join(open_cuts, ["by1", "part"]).groupBy("by1", "k", "label").agg(
        vector_sum("total").alias("total"), F.sum("n").alias("n")))
    per_part = open_cuts.groupBy("by1", "part").agg(F.array_sort(F.collect_list(
        F.struct("k", "label"))).alias("cut")).select(
        "by1", "part", F.col("cut.k").alias("ks"), F.col("cut.label").alias("labels"))
    placed = points.join(members, ["by1", "point_id"]).join(per_part, ["by1", "part"])
    scores = _sliced(placed, sums)
    sizes = sums.groupBy("by1", "k").agg(F.count_if(F.col("n") == 1).alias("singletons"))
    judged = scores.groupBy("by1", "k").agg(
        (F.sum("score") / F.sum("points")).alias("silhouette")).join(sizes, ["by1", "k"])
    judged = judged.withColumn("adjusted", F.round(
        F.col("silhouette") - COUNT_PENALTY * (F.col("k") - 2)
        - SINGLETON_PENALTY * F.col("singletons") / F.col("k"), 9))
    chosen = judged.groupBy("by1").agg(
        F.max_by(F.struct("k", "silhouette", "adjusted"),
                 F.struct("adjusted", -F.col("k"))).alias("c"))
    keep = F.col("c.adjusted") >= MIN_ADJUSTED_SILHOUETTE
    final = chosen.select("by1", F.when(keep, F.col("c.k")).alias("best_k"),
                          F.when(keep, F.col("c.silhouette")).otherwise(0.0).alias("silhouette"))
    labels = open_cuts.join(final, "by1").filter(
        F.col("k") == F.coalesce("best_k", F.lit(2))).select(
        "by1", "part", F.when(F.col("best_k").isNull(), 0).otherwise(F.col("label")).alias("label"),
        "silhouette")
    labels = labels.unionByName(cuts.filter("k = 0").select(
        "by1", "part", "label", F.lit(0.0).alias("silhouette")))
    return members.join(labels, ["by1", "part"]).select("by1", "point_id", "label", "silhouette")


def mean_silhouettes(points: DataFrame) -> DataFrame:
    """Mean cosine silhouette per variety of given labels.

    points: by1, point_id, vector of unit length, label (0, 1, ... inside each variety). Points are
    scored in slices against the label sums, so a large variety spreads over many tasks.
    """
    sums = points.groupBy("by1", "label").agg(
        vector_sum().alias("total"), F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(0))
    placed = points.select("by1", "point_id", "vector", F.array(F.lit(0)).alias("ks"),
                           F.array(F.col("label").cast("int")).alias("labels"))
    return _sliced(placed, sums).groupBy("by1").agg(
        (F.sum("score") / F.sum("points")).alias("silhouette"), F.sum("points").alias("points"))


def _sliced(placed: DataFrame, sums: DataFrame) -> DataFrame:
    """Silhouette totals of slices of about SLICE_ROWS points, each with the sums of its variety."""
    slices = sums.groupBy("by1", "k").agg(F.sum("n").alias("n")).groupBy("by1").agg(
        F.ceil(F.max("n") / SLICE_ROWS).cast("int").alias("slices"))
    dealt = salted_lookup(placed, slices, ["by1"], "point_id", how="inner").withColumn(
        "slice", F.pmod(F.xxhash64("point_id"), F.col("slices")).cast("int"))
    copies = sums.join(slices, "by1").withColumn("slice", F.explode(
        F.sequence(F.lit(0), F.col("slices") - 1))).select(
        *(F.col(c).alias(c) for c in (*sums.columns, "slice")))
    return dealt.groupBy("by1", "slice").cogroup(copies.groupBy("by1", "slice")).applyInPandas(
        _slice_silhouettes, "by1 string, k int, score double, points bigint")


def cluster_descriptions(points: DataFrame, finish_parts: int = FINISH_PARTS,
                         tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per point: cluster id, representative, medoid similarity, neighbour, outlier.

    points: the output of load_points with description, example, form_code, spec and support.
    Cluster ids run from 1 in the order of the smallest member id.
    """
    ready = points.withColumn("vector", unit(F.col("vector")))
    labels = cut_lineage(label_points(ready, finish_parts, tile_rows))
    firsts = labels.groupBy("by1", "label").agg(F.min("point_id").alias("first_id"))
    # At most MAX_CLUSTERS rows per variety.
    ids = firsts.withColumn("cluster_id", F.row_number().over(
        Window.partitionBy("by1").orderBy("first_id")))
    named = labels.join(ids.select("by1", "label", "cluster_id"), ["by1", "label"]).select(
        "by1", "point_id", "cluster_id", "silhouette")
    joined = cut_lineage(ready.join(named, ["by1", "point_id"]))
    key = ["by1", "cluster_id"]
    medoid = medoids(joined, key)
    texts = joined.select(F.col("point_id").alias("medoid_id"),
                          F.col("description").alias("representative"))
    near = neighbor_similarity(joined, "by1", tile_rows).select(
        F.col("group").alias("by1"), "point_id", "nearest_neighbor_similarity", "is_outlier")
    return (medoid_similarity(joined, medoid.join(texts, "medoid_id").select(
        *key, "medoid_id", "medoid_vector"), key)
        .join(near, ["by1", "point_id"]).join(texts, "medoid_id").drop("vector"))


def variety_summary(detail: DataFrame) -> DataFrame:
    return detail.groupBy("by1").agg(
        F.count(F.lit(1)).alias("description_count"), F.sum("support").alias("support_total"),
        F.count_distinct("cluster_id").alias("cluster_count"),
        F.bround(F.max("silhouette"), 6).alias("silhouette"),
        F.bround(F.avg("similarity_to_medoid"), 6).alias("average_cohesion"),
        F.count_if("is_outlier").alias("outlier_count")).withColumn(
        "status", F.when(F.col("description_count") == 1, "insufficient_sample")
        .otherwise("clustered"))


def cluster_summary(detail: DataFrame) -> DataFrame:
    def codes(column: str):
        return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(column), F.lit("")))), ", ")

    return detail.groupBy("by1", "cluster_id").agg(
        F.count(F.lit(1)).alias("member_count"), F.sum("support").alias("support_total"),
        F.first("representative").alias("representative"), codes("form_code").alias("form_codes"),
        codes("spec").alias("specifications"),
        F.bround(F.avg("similarity_to_medoid"), 6).alias("average_cohesion"),
        F.count_if("is_outlier").alias("outlier_count"))


def run_metadata(varieties: DataFrame, source: str) -> DataFrame:
    """One row of totals; generated_at is added by the writer."""
    return varieties.agg(
        F.lit(source).alias("source"), F.count(F.lit(1)).alias("by1_count"),
        F.sum("description_count").alias("description_count"),
        F.sum("cluster_count").alias("cluster_count"),
        F.count_if(F.col("status") == "insufficient_sample").alias("insufficient_by1_count"),
        F.sum("outlier_count").alias("outlier_count"))


def cluster_count_distribution(varieties: DataFrame) -> DataFrame:
    return varieties.groupBy("cluster_count").agg(F.count(F.lit(1)).alias("by1_count"))


def top_varieties(varieties: DataFrame, k: int = 10) -> DataFrame:
    """Varieties with most descriptions (a report)."""
    return varieties.orderBy(F.desc("description_count"), F.asc("by1")).limit(k)


def outlier_listing(detail: DataFrame) -> DataFrame:
    return detail.filter("is_outlier").select(
        "by1", "cluster_id", "point_id", "description", "representative", "form_code", "spec",
        "nearest_neighbor_similarity")
