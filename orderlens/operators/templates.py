"""Templates per variety: grouping, medoids, cohesion, outliers, profiles and retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import cluster_template_id, is_nonstandard_spec
from ..functions.sizes import infer_size
from ..functions.text import blank, normalize_code, strip
from ..functions.vectors import clip, dot, unit
from ..plans.scale import cut_lineage, ordered_rank, salted_lookup, top_k
from .cascade import KEY
from .design import render
from .vectors import TILE_ROWS, fuse_rerank, nearest, tile_pairs

OUTLIER_SIMILARITY = 0.60
PAIR_SIMILARITY = 0.75
PROFILE_SCORE = 0.60
TEMPLATE_POOL = 50
FORM_BONUS = 0.03
# Attribute fields of the description views that retrieval compares; size never counts.
VIEW_FIELDS = ["body_material", "connection", "seat_material", "closure_material", "actuation",
               "pressure", "family"]


def vector_sum(column: str = "vector") -> Column:
    """Element-wise sum of array vectors, combined before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))


def near(value: Column, best: Column) -> Column:
    """Equal up to a relative 1e-5 and an absolute 1e-8."""
    return F.abs(value - best) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(best)


def medoids(members: DataFrame, keys: list[str]) -> DataFrame:
    """Medoid per cluster: highest mean similarity, near ties by smallest id.

    members: keys, point_id, vector (unit). The mean similarity of v to its cluster is v times the
    cluster sum over the count, so no pair of members is ever formed.
    """
    sums = members.groupBy(*keys).agg(vector_sum().alias("total"), F.count(F.lit(1)).alias("n"))
    scored = salted_lookup(members.select(*keys, "point_id", "vector"), sums, keys, "point_id") \
        .withColumn("mean_similarity", F.round(dot(F.col("vector"), F.col("total")) / F.col("n"), 12))
    best = scored.groupBy(*keys).agg(F.max("mean_similarity").alias("best"))
    tied = salted_lookup(scored, best, keys, "point_id").filter(
        near(F.col("mean_similarity"), F.col("best")))
    return tied.groupBy(*keys).agg(
        F.min_by(F.struct("point_id", "vector", "mean_similarity"), "point_id").alias("m")).select(
        *keys, F.col("m.point_id").alias("medoid_id"), F.col("m.vector").alias("medoid_vector"),
        F.col("m.mean_similarity").alias("mean_similarity"))


def medoid_similarity(members: DataFrame, medoid: DataFrame, keys: list[str]) -> DataFrame:
    joined = salted_lookup(members, medoid.select(*keys, "medoid_id", "medoid_vector"), keys,
                           "point_id")
    return joined.withColumn("similarity_to_medoid", clip(dot(
        F.col("vector"), F.col("medoid_vector")))).drop("medoid_vector")


def cohesion(members: DataFrame, medoid: DataFrame, keys: list[str]) -> DataFrame:
    return medoid_similarity(members, medoid, keys).groupBy(*keys).agg(
        F.bround(F.avg("similarity_to_medoid"), 6).alias("cohesion"))


def neighbor_similarity(members: DataFrame, group: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(group, point_id, nearest_neighbor_similarity, is_outlier); a lone point scores 1.0."""
    side = members.select(F.col("point_id").cast("string").alias("qid"), "vector", group)
    best = nearest(side, side.withColumnRenamed("qid", "pid"), 1, group, True, tile_rows)
    sizes = members.groupBy(F.col(group).cast("string").alias("group")).agg(
        F.count(F.lit(1)).alias("n"))
    found = best.select("group", F.col("qid").alias("point_id"),
                        F.col("score").alias("nearest_neighbor_similarity"))
    lone = members.select(F.col(group).cast("string").alias("group"),
                          F.col("point_id").cast("string").alias("point_id")).join(
        sizes.filter(F.col("n") == 1), "group", "left_semi").withColumn(
        "nearest_neighbor_similarity", F.lit(1.0))
    return salted_lookup(found.unionByName(lone), sizes, ["group"], "point_id").select(
        "group", "point_id", "nearest_neighbor_similarity",
        ((F.col("n") >= 3) & (F.col("nearest_neighbor_similarity") < OUTLIER_SIMILARITY))
        .alias("is_outlier"))


def prepare_members(rows: DataFrame, train_before: str | None = None) -> DataFrame:
    """Template members: codes upper-cased, vectors of unit length, optional time cut.

    rows: point_id, by1, raw_description, structural, full, vector, attributes (map of evidence),
    form_code, spec, parsed_size, support, contract_date.
    """
    cut = rows if train_before is None else rows.filter(
        F.col("contract_date") < F.lit(train_before).cast("date"))
    return cut.withColumns({
        "point_id": F.col("point_id").cast("string"),
        "by1": F.upper(strip(blank(F.col("by1")))),
        "signature": F.upper(strip(blank(F.col("structural")))),
        "form_code": F.upper(strip(blank(F.col("form_code")))),
        "spec": F.upper(strip(blank(F.col("spec")))),
        "parsed_size": strip(blank(F.col("parsed_size"))),
        "support": F.coalesce(F.col("support"), F.lit(1)).cast("bigint"),
        "vector": unit(F.col("vector"))})


def assign_templates(members: DataFrame) -> DataFrame:
    """Members with template_id and cluster_id: one cluster per variety and signature; a pair of
    members splits when their similarity is below 0.75."""
    group = ["by1", "signature"]
    groups = members.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), vector_sum().alias("total"),
        F.sum(dot(F.col("vector"), F.col("vector"))).alias("squares"),
        F.min("point_id").alias("first_id"))
    pair = (dot(F.col("total"), F.col("total")) - F.col("squares")) / 2
    groups = groups.withColumn("split", (F.col("n") == 2) & (F.round(pair, 12) < PAIR_SIMILARITY))
    parts = groups.select(*group, "split", "first_id", F.explode(
        F.when(F.col("split"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("part"))
    numbered = ordered_rank(parts, ["by1"], ["signature", "part"], "cluster_id")
    numbered = numbered.withColumn("template_id", cluster_template_id(
        F.col("by1"), F.col("signature"), F.col("cluster_id")))
    per_group = numbered.groupBy(*group).agg(
        F.first("split").alias("split"), F.first("first_id").alias("first_id"),
        F.map_from_entries(F.collect_list(F.struct("part", F.struct("cluster_id", "template_id"))))
        .alias("clusters"))
    placed = salted_lookup(members, per_group, group, "point_id")
    part = F.when(F.col("split") & (F.col("point_id") != F.col("first_id")), 1).otherwise(0)
    return placed.withColumn("c", F.element_at("clusters", part)).withColumns({
        "cluster_id": F.col("c.cluster_id"), "template_id": F.col("c.template_id")}).drop(
        "c", "clusters", "split", "first_id")


def profile_counts(assigned: DataFrame) -> DataFrame:
    """Long specification profile: (template_id, by1, form_code, parsed_size, spec, n, support)."""
    return assigned.groupBy("template_id", "by1", "form_code", "parsed_size", "spec").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.greatest(F.col("support"), F.lit(0))).alias("support"))


def spec_profiles(counts: DataFrame) -> DataFrame:
    """Profile per template and form with distribution maps; keys are specification codes."""
    key = ["template_id", "by1", "form_code"]
    support = counts.groupBy(*key).agg(F.sum("support").alias("support"))
    filled = counts.filter(F.col("spec") != "")
    by_spec = filled.groupBy(*key, "spec").agg(F.sum("n").alias("n"))
    whole = by_spec.groupBy(*key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("spec", "n"))))
        .alias("spec_distribution"),
        F.array_sort(F.collect_list(F.when(is_nonstandard_spec(F.col("spec")), F.col("spec"))))
        .alias("nonstandard_specs"))
    sized = filled.filter(F.col("parsed_size") != "").groupBy(*key, "parsed_size").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("spec", "n")))).alias("specs"))
    sized = sized.groupBy(*key).agg(F.map_from_entries(F.collect_list(
        F.struct("parsed_size", "specs"))).alias("size_to_spec_distribution"))
    return support.join(whole, key, "left").join(sized, key, "left")


def template_index(assigned: DataFrame) -> DataFrame:
    """One row per template: medoid text and vector, attributes, forms, support, cohesion,
    outliers, status."""
    key = ["template_id"]
    medoid = medoids(assigned, key)
    around = cohesion(assigned, medoid, key)
    flagged = neighbor_similarity(assigned, "template_id").groupBy(
        F.col("group").alias("template_id")).agg(F.count_if("is_outlier").alias("outlier_count"))
    summary = assigned.groupBy(*key).agg(
        F.first("by1").alias("by1"), F.first("cluster_id").alias("cluster_id"),
        F.first("signature").alias("structural_signature"),
        F.array_sort(F.collect_set(F.nullif(F.col("form_code"), F.lit(""))))
        .alias("supported_form_codes"),
        F.sum("support").alias("support"), F.count(F.lit(1)).alias("member_count"))
    texts = assigned.select(F.col("point_id").alias("medoid_id"), "raw_description", "attributes")
    chosen = medoid.join(texts, "medoid_id")
    return (summary.join(chosen, key).join(around, key).join(flagged, key, "left").select(
        "template_id", "by1", "cluster_id", "structural_signature",
        F.col("medoid_id").alias("representative_point_id"),
        F.col("raw_description").alias("representative_description"),
        F.col("medoid_vector").alias("vector"),
        F.transform_values(F.map_filter("attributes", lambda k, _: k != "size"),
                           lambda _, a: a["value"]).alias("attributes"),
        "supported_form_codes", "support", "member_count", "cohesion",
        F.coalesce("outlier_count", F.lit(0)).cast("bigint").alias("outlier_count"),
        F.when(F.col("member_count") == 1, "insufficient_sample").otherwise("clustered")
        .alias("template_status")))


def template_members(assigned: DataFrame) -> DataFrame:
    return assigned.select("template_id", "point_id", "by1", "raw_description", "structural",
                           "form_code", "spec", "parsed_size", "support", "vector")


def build_templates(members: DataFrame, train_before: str | None = None) -> dict:
    """Members, templates and profiles of a template index."""
    assigned = cut_lineage(assign_templates(prepare_members(members, train_before)))
    return {"members": template_members(assigned), "templates": template_index(assigned),
            "profiles": profile_counts(assigned)}


def _codes(values: Column) -> Column:
    """Comparable attribute values as hashes in field order, 0 when absent."""
    return F.array(*[F.coalesce(F.when(
        F.upper(strip(F.try_element_at(values, F.lit(f)))) != "",
        F.xxhash64(F.upper(strip(F.try_element_at(values, F.lit(f)))))), F.lit(0).cast("bigint"))
        for f in VIEW_FIELDS])


HIT_SCHEMA = ("qid string, pid string, structural_score double, score double, match_ratio double, "
              "form_match boolean, support bigint")


def _template_tile(k: int):
    """Task kernel: scores of compatible templates of a tile, the k best per query."""

    def kernel(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in HIT_SCHEMA.split(", ")]
        if queries.empty or points.empty:
            return pd.DataFrame({n: [] for n in names}).astype({"qid": str, "pid": str})
        points = points.sort_values("pid", ascending=False, kind="stable")
        matrix, codes = (np.stack(points[c].to_numpy()) for c in ("vector", "codes"))
        support = points["support"].to_numpy()
        pids = points["pid"].to_numpy()
        weight = np.minimum(np.log1p(support) / 6.0, 1.0)
        forms = [frozenset(f) for f in points["forms"]]
        by_form = {f: np.array([f in s for s in forms]) for f in queries["form"].unique() if f}
        found = []
        for start in range(0, len(queries), 256):
            part = queries.iloc[start:start + 256]
            cosine = np.clip(np.stack(part["vector"].to_numpy()) @ matrix.T, -1.0, 1.0)
            asked = np.stack(part["codes"].to_numpy())
            same = np.zeros(cosine.shape, dtype=np.int64)
            clash = np.zeros(cosine.shape, dtype=bool)
            for f in range(asked.shape[1]):
                q, t = asked[:, f][:, None], codes[:, f][None, :]
                both = (q != 0) & (t != 0)
                same += both & (q == t)
                clash |= both & (q != t)
            ratio = same / np.maximum((asked != 0).sum(axis=1), 1)[:, None]
            fits = np.stack([by_form.get(f, np.zeros(len(pids), dtype=bool)) for f in part["form"]])
            score = np.round(np.round(0.70 * cosine, 12) + 0.20 * ratio + 0.05 * fits
                             + 0.05 * weight[None, :], 4)
            for i, qid in enumerate(part["qid"]):
                ok = np.flatnonzero(~clash[i])
                order = ok[np.lexsort((-support[ok], ~fits[i, ok], -score[i, ok]))][:k]
                found.append(pd.DataFrame({
                    "qid": qid, "pid": pids[order],
                    "structural_score": np.round(cosine[i, order], 4), "score": score[i, order],
                    "match_ratio": np.round(ratio[i, order], 4), "form_match": fits[i, order],
                    "support": support[order]}))
        return pd.concat(found, ignore_index=True)

    return kernel


def retrieve_templates(requests: DataFrame, templates: DataFrame, k: int = TEMPLATE_POOL,
                       tile_rows: int = TILE_ROWS) -> DataFrame:
    """Compatible templates of every request, best first: score, form match, support, id descending.

    requests: request_id, vector, attributes (map of strings), form_code. A template is dropped if
    one of its attributes differs from the same attribute of the request; size never counts.
    """
    k = max(1, min(int(k), 100))
    q = requests.select(
        F.lit("all").alias("group"), F.col("request_id").cast("string").alias("qid"),
        unit(F.col("vector")).alias("vector"), _codes(F.col("attributes")).alias("codes"),
        F.upper(strip(blank(F.col("form_code")))).alias("form"))
    p = templates.select(
        F.lit("all").alias("group"), F.col("template_id").alias("pid"),
        unit(F.col("vector")).alias("vector"), _codes(F.col("attributes")).alias("codes"),
        F.transform("supported_form_codes", lambda f: F.upper(strip(f))).alias("forms"),
        F.greatest(F.col("support"), F.lit(0)).cast("bigint").alias("support"))
    q_tiles, p_tiles = tile_pairs(q, p, tile_rows)
    hits = q_tiles.cogroup(p_tiles).applyInPandas(_template_tile(k), HIT_SCHEMA)
    best = top_k(hits, ["qid"], [F.desc("score"), F.desc("form_match"), F.desc("support"),
                                 F.desc("pid")], k)
    texts = templates.select(F.col("template_id").alias("pid"), "by1", "representative_description")
    return best.join(texts, "pid").withColumnsRenamed({"qid": "request_id", "pid": "template_id"})


def by1_from_templates(hits: DataFrame, k: int = 5) -> DataFrame:
    """Variety candidates from template hits: best score, form bonus, support, ids, 3 texts."""
    k = max(1, min(int(k), 20))
    placed = hits.withColumn("by1", normalize_code(F.col("by1"))).filter(F.col("by1") != "") \
        .withColumn("at", F.row_number().over(
            Window.partitionBy("request_id", "by1").orderBy("rank")))
    text = F.nullif(blank(F.col("representative_description")), F.lit(""))
    grouped = placed.groupBy("request_id", "by1").agg(
        F.max("score").alias("best"), F.max("form_match").alias("form_match"),
        F.sum(F.greatest(F.col("support"), F.lit(0))).alias("support"),
        F.array_sort(F.collect_list(F.struct("at", "template_id"))).alias("ids"),
        F.array_sort(F.collect_list(F.when((F.col("at") <= 3) & text.isNotNull(), F.struct(
            "at", text.alias("text"))))).alias("texts"))
    scored = grouped.select(
        "request_id", "by1", F.bround(F.col("best") + F.when(
            F.col("form_match"), FORM_BONUS).otherwise(0.0), 4).alias("score"),
        "support", "form_match", F.col("ids.template_id").alias("template_ids"),
        F.col("texts.text").alias("matched_descriptions"))
    return top_k(scored, ["request_id"], [F.desc("score"), F.desc("support"), F.asc("by1")], k)


def profile_hits(keys: DataFrame, hits: DataFrame, profiles: DataFrame) -> DataFrame:
    """Specification evidence of template hits, in the shape of exact cascade hits.

    keys: KEY columns and request_id. Profiles without a form or with the request's form count;
    the size-specific distribution is used where it exists, the whole one otherwise.
    """
    sized = keys.withColumn("size", infer_size(F.col("query")))
    good = hits.filter(F.col("score") >= PROFILE_SCORE).select("request_id", "template_id")
    asked = sized.join(good, "request_id").select(
        *KEY, F.coalesce("size.size", F.lit("")).alias("size_key"),
        F.col("size.rule").alias("size_rule"), "template_id")
    rows = profiles.filter(F.col("spec") != "").select(
        "template_id", normalize_code(F.col("form_code")).alias("profile_form"), "parsed_size",
        normalize_code(F.col("spec")).alias("spec"), "n")
    met = asked.join(rows, "template_id").filter(
        (F.col("profile_form") == "") | (F.col("profile_form") == F.col("form_code")))
    exact = (F.col("size_key") != "") & (F.col("parsed_size") == F.col("size_key"))
    profile = Window.partitionBy(*KEY, "template_id", "profile_form")
    used = met.withColumns({"exact": exact, "any_exact": F.max(exact).over(profile)}).filter(
        ~F.col("any_exact") | F.col("exact"))
    counts = used.groupBy(*KEY, "size_rule", "spec").agg(F.sum("n").alias("n"),
                                                        F.collect_set("template_id").alias("ids"))
    everything = Window.partitionBy(*KEY)
    ranked = counts.withColumns({
        "total": F.sum("n").over(everything), "candidates": F.count(F.lit(1)).over(everything),
        "rank": F.row_number().over(everything.orderBy(F.desc("n"), F.asc("spec")))})
    grouped = ranked.groupBy(*KEY, "size_rule", "total", "candidates").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct(
            "rank", F.col("spec").alias("value"), "n")))).alias("ranked"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("template_ids"))
    return grouped.filter(F.col("total") >= 2).select(
        *KEY, F.lit("profile").alias("level"), "total", "candidates", "ranked", "size_rule",
        "template_ids")


def conflict(explicit: Column, candidate: Column) -> Column:
    """True if an explicit field, other than size, has another value in the candidate."""
    return F.exists(F.map_entries(explicit), lambda e: (e["key"] != "size") & F.coalesce(
        F.try_element_at(candidate, e["key"]) != e["value"], F.lit(False)))


def retrieve_designs(queries: DataFrame, templates: DataFrame, k: int = 3, pool: int = 100,
                     rerank_scores: DataFrame | None = None) -> DataFrame:
    """Design templates per designed query, best first, with text rendered from merged values.

    queries: request_id, vector, product_role, valve_family, by1, form_code, attributes (map of
    evidence). templates: template_id, vector, valve_family, product_role, attributes (map of
    strings), supported_by1, form_codes, support, standardized_description.

    Hits meet the explicit fields only and are ranked without any; the attributes of both sides
    join the k best. Rows are named by a written number, as ids may repeat.
    """
    pool = max(20, min(int(pool), 100))
    asked = queries.filter((F.col("product_role") == "valve") & F.col("valve_family").isNotNull())
    asked = cut_lineage(asked.select(
        F.col("request_id").cast("string").alias("request_id"), "vector", "valve_family", "by1",
        "form_code", F.col("attributes").alias("q_attributes"),
        F.monotonically_increasing_id().alias("_query")))
    payload = cut_lineage(templates.select(
        "template_id", F.col("attributes").alias("t_attributes"), "supported_by1", "form_codes",
        "support", F.monotonically_increasing_id().alias("_template")))
    found = nearest(
        asked.select(F.col("request_id").alias("qid"), unit(F.col("vector")).alias("vector"),
                     "valve_family"),
        templates.filter(F.col("product_role") == "valve").select(
            F.col("template_id").alias("pid"), unit(F.col("vector")).alias("vector"),
            "valve_family"), pool, "valve_family")
    explicit = F.transform_values(F.map_filter("q_attributes", lambda f, a: (f != "size") & (
        a["source"] == "query") & (F.coalesce(a["value"], F.lit("")) != "")), lambda _, a: a["value"])
    sides = asked.select("request_id", "_query", F.upper(strip(blank(F.col("by1")))).alias("q_by1"),
                         F.upper(strip(blank(F.col("form_code")))).alias("q_form"),
                         explicit.alias("explicit"))
    joined = (found.select(F.col("qid").alias("request_id"), F.col("pid").alias("template_id"),
                           F.col("score").alias("vector_score"))
              .join(sides, "request_id").join(payload, "template_id"))
    fitting = joined.filter(~conflict(F.col("explicit"), F.col("t_attributes")))
    matched = F.size(F.filter(F.map_entries("explicit"), lambda e: F.coalesce(
        F.try_element_at(F.col("t_attributes"), e["key"]) == e["value"], F.lit(False))))
    by1_match = (F.col("q_by1") != "") & F.array_contains("supported_by1", F.col("q_by1"))
    form_match = (F.col("q_form") != "") & F.array_contains("form_codes", F.col("q_form"))
    scored = fitting.withColumns({
        "matched_field_count": matched,
        "field_match_ratio": F.coalesce(F.bround(F.try_divide(
            matched.cast("double"), F.size("explicit").cast("double")), 4), F.lit(0.0)),
        "by1_match": by1_match, "form_match": form_match, "score": F.col("vector_score"),
        "by1_form_match": by1_match & form_match}).drop(
        "explicit", "t_attributes", "supported_by1", "form_codes", "q_by1", "q_form")
    order = [F.desc("field_match_ratio"), F.desc("by1_form_match"), F.desc("form_match"),
             F.desc("by1_match"), F.desc("score"), F.desc("support"), F.asc("template_id")]
    window = Window.partitionBy("request_id").orderBy(*order)
    ranked = scored.withColumn("rank", F.row_number().over(window))
    if rerank_scores is not None:
        head = fuse_rerank(ranked.filter(F.col("rank") <= 20), rerank_scores, "template_id")
        ranked = head.unionByName(ranked.filter(F.col("rank") > 20), allowMissingColumns=True)
        ranked = ranked.withColumn("rank", F.row_number().over(window))
    else:
        ranked = ranked.withColumn("reranker_used", F.lit(False))
    every = F.transform_values(F.map_filter(
        "q_attributes", lambda _, a: F.coalesce(a["value"], F.lit("")) != ""), lambda _, a: a["value"])
    values = F.map_concat(F.map_filter("t_attributes", lambda f, _: ~F.map_contains_key(
        every, f)), every)
    best = ranked.filter(F.col("rank") <= max(1, min(int(k), pool)))
    return best.join(asked.select("_query", "valve_family", "q_attributes"), "_query").join(
        payload.select("_template", "t_attributes", "supported_by1", "form_codes"),
        "_template").select(
        "request_id", "rank", "template_id", render(F.col("valve_family"), values)
        .alias("standardized_description"),
        F.bround("score", 4).alias("score"), F.bround("vector_score", 4).alias("vector_score"),
        "field_match_ratio", "matched_field_count", "by1_match", "form_match", "by1_form_match",
        "support", F.coalesce("reranker_used", F.lit(False)).alias("reranker_used"),
        F.array_sort("supported_by1").alias("supported_by1"),
        F.array_sort("form_codes").alias("form_codes"))

