"""Queries over vector retrieval, clustering, templates and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import blank
from ..functions.vectors import unit
from ..operators import clustering as C
from ..operators import templates as TP
from ..operators import vectors as V
from ..plans import jobs as J
from ..plans.scale import cut_lineage, top_k
from .history_queries import _unseen
from .inputs import embeddings, past, points, stored
from .oracle_parts import part, sql
from .registry import query
from .text_queries import _VIEW_SQL

part("e", """
SELECT vec_id::VARCHAR AS id, label::VARCHAR AS label, 'V' || label AS by1, embedding::DOUBLE[] AS v, length(vec_id::VARCHAR) + label AS support,
  'Text ' || vec_id AS example, 'F' || right(vec_id::VARCHAR, 1) AS form_code FROM embeddings""")
part("pairs", """
SELECT q.id AS qid, p.id AS pid, q.label AS ql, p.label AS pl, round(list_cosine_similarity(q.v, p.v), 9) AS score FROM e q, e p""", "e")


def _sides(e, group=None):
    columns = ["vector"] + ([group] if group else [])
    ready = e.withColumn("vector", unit(F.col("vector")))
    return (ready.select(F.col("id").alias("qid"), *columns),
            ready.select(F.col("id").alias("pid"), *columns))


@query("cosine_topk", sql("""
SELECT qid, pid, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM pairs WHERE qid <> pid AND ql = pl) WHERE rank <= 5""", "pairs"))
def cosine_topk(spark, d):
    q, p = _sides(embeddings(spark, d), "label")
    return V.nearest(q, p, 5, "label", skip_self=True).select(
        "qid", "pid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("score_threshold", sql("""
SELECT qid, pid, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM pairs) WHERE rank <= 50 AND score >= 0.3""", "pairs"))
def score_threshold(spark, d):
    e = embeddings(spark, d)
    hits = V.child_hits(e.withColumnRenamed("id", "request_id"), e.withColumnRenamed(
        "id", "child_id"), 50, min_score=0.3)
    return hits.select(F.col("request_id").alias("qid"), F.col("child_id").alias("pid"),
                       F.round("score", 6).alias("score"))


part("pool", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM pairs) WHERE rank <= 300", "pairs")
part("by1c", """
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_hit, by1) AS rank FROM (
  SELECT qid, by1, min(rank) AS first_hit, round_even(0.85 * max(score) + 0.15 * avg(score) FILTER (rn <= 3) + CASE WHEN bool_or(fits) THEN 0.03 ELSE 0 END, 4) AS score,
    round_even(max(score), 4) AS vector_score, sum(support)::BIGINT AS support, bool_or(fits) AS form_match, string_agg(example, '|' ORDER BY rn) FILTER (rn <= 3) AS texts
  FROM (SELECT h.*, c.by1, c.support, c.example, c.form_code = q.form_code AS fits, row_number() OVER (PARTITION BY qid, c.by1 ORDER BY rank) AS rn
    FROM pool h JOIN e c ON c.id = h.pid JOIN e q ON q.id = h.qid) GROUP BY qid, by1)""", "pool", "e")


def _by1_candidates(spark, d):
    p = points(spark, d)
    asked = p.select(F.col("point_id").alias("request_id"), "vector", "form_code")
    hits = V.child_hits(asked, p.withColumnRenamed("point_id", "child_id"))
    return V.by1_from_hits(hits, asked, 50)


@query("hits_by_label", sql("SELECT qid AS request_id, by1, score, vector_score, support, form_match, texts, rank FROM by1c WHERE rank <= 50", "by1c"))
def hits_by_label(spark, d):
    return _by1_candidates(spark, d).select(
        "request_id", "by1", "score", "vector_score", "support", "form_match",
        F.array_join("matched_descriptions", "|").alias("texts"),
        F.col("rank").cast("bigint").alias("rank"))


@query("rerank_fusion", sql("""
SELECT request_id, by1, score, reranker_used, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN reranker_used THEN -score END, old_rank) AS rank FROM (
  SELECT qid AS request_id, by1, rank AS old_rank, full_ AS reranker_used, CASE WHEN full_ THEN round_even(0.70 * CASE WHEN hi > lo THEN (rr - lo) / (hi - lo) ELSE 0.5 END + 0.20 * vector_score
    + 0.05 * form_match::INT + 0.05 * least(ln(1 + support) / 6, 1), 4) ELSE score END AS score FROM (
    SELECT *, min(rr) OVER w AS lo, max(rr) OVER w AS hi, count(rr) OVER w = count(*) OVER w AS full_ FROM (
      SELECT *, CASE WHEN qid::INT % 5 = 0 AND by1 = 'V3' THEN NULL ELSE ((qid::INT * 7 + right(by1, 1)::INT * 13) % 101) / 100 END AS rr FROM by1c WHERE rank <= 50) WINDOW w AS (PARTITION BY qid)))""", "by1c"))
def rerank_fusion(spark, d):
    c = cut_lineage(_by1_candidates(spark, d))
    rr = ((F.col("request_id").cast("int") * 7 + F.right("by1", F.lit(1)).cast("int") * 13) % 101) / 100
    scores = c.select("request_id", "by1", rr.alias("score")).filter(
        ~((F.col("request_id").cast("int") % 5 == 0) & (F.col("by1") == "V3")))
    return V.fuse_rerank(c, scores).select("request_id", "by1", "score", "reranker_used",
                                           F.col("rank").cast("bigint").alias("rank"))


@query("rerank_payload", """
SELECT event_id AS request_id, document, score FROM (
  SELECT event_id, event_type, value, unnest(CASE event_type WHEN 'click' THEN [1, 0] WHEN 'view' THEN [0, 1] WHEN 'purchase' THEN [0, 2] WHEN 'signup' THEN [2] ELSE [0] END) AS document FROM events),
  LATERAL (SELECT CASE WHEN event_type = 'click' AND document = 0 THEN 0.25 WHEN event_type = 'purchase' AND document = 2 THEN 0.5 ELSE value END AS score)
WHERE event_type <> 'error'""")
def rerank_payload(spark, d):
    from ..sources.orders import read_table
    v = F.col("value").cast("string")
    shapes = {
        "click": ('{"results":[{"index":1,"relevance_score":', '},{"index":0,"score":0.25},{"index":9,"score":1}]}'),
        "view": ("[", ", {\"score\":%s}]"), "purchase": ('{"data":[{"score":', '},{"index":5,"score":1},{"document_index":2,"score":0.5}]}'),
        "signup": ('{"scores":[{"index":"2","relevance_score":', "}]}")}
    payload = F.lit("not json")
    for kind, (head, tail) in shapes.items():
        text = F.concat(F.lit(head), v, F.replace(F.lit(tail), F.lit("%s"), v))
        payload = F.when(F.col("event_type") == kind, text).otherwise(payload)
    asked = read_table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), payload.alias("payload"),
        F.lit(3).alias("document_count"))
    return V.parse_rerank_payloads(asked)


@query("parent_search", sql("""
WITH t AS (SELECT qid, pl, max(score) AS score, string_agg(txt, '|' ORDER BY rn) FILTER (rn <= 3) AS texts FROM (
    SELECT qid, pl, score, 'Text ' || pid AS txt, row_number() OVER (PARTITION BY qid, pl ORDER BY rank) AS rn FROM pool WHERE rank <= 25) GROUP BY qid, pl),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pl) AS rank FROM t),
  s AS (SELECT by1, 'C' || (id::INT % 3) AS customer, string_agg(DISTINCT form_code, '|' ORDER BY form_code) AS specs FROM e GROUP BY ALL),
  n AS (SELECT label, count(*) AS n FROM e WHERE label <> '7' GROUP BY label)
SELECT r.qid AS request_id, r.rank, 'P' || pl AS parent_id, 'V' || pl AS product_name, coalesce(n.n, 0) AS edesc_count, round(score, 6) AS score, texts, coalesce(s.specs, '') AS specs
FROM r LEFT JOIN n ON n.label = r.pl LEFT JOIN s ON s.by1 = 'V' || pl AND s.customer = 'C' || (r.qid::INT % 3) WHERE r.rank <= 5""".replace("WITH t AS", "SELECT * FROM (WITH t AS") + ")", "pool", "e"))
def parent_search(spark, d):
    e = points(spark, d)
    customer = F.concat(F.lit("C"), F.col("point_id").cast("int") % 3)
    label = F.substring("by1", 2, 9)
    asked = e.select(F.col("point_id").alias("request_id"), "vector", customer.alias("customer"))
    children = e.select(F.col("point_id").alias("child_id"), F.concat(F.lit("P"), label)
                        .alias("parent_id"), F.col("by1").alias("product_name"),
                        F.col("example").alias("edesc_text"), "vector")
    parents = children.filter(F.col("parent_id") != "P7").groupBy("parent_id", "product_name").agg(
        F.count(F.lit(1)).alias("edesc_count"))
    specs = e.groupBy(F.col("by1").alias("product_name"), customer.alias("customer")).agg(
        F.array_sort(F.collect_set("form_code")).alias("specs"))
    found = V.search_descriptions(asked, children, parents, specs, 5)
    return found.select("request_id", F.col("rank").cast("bigint").alias("rank"), "parent_id",
                        "product_name", "edesc_count", F.round("score", 6).alias("score"),
                        F.array_join("matched_texts", "|").alias("texts"),
                        blank(F.array_join("matched_specs", "|")).alias("specs"))


@query("medoids", sql("""
SELECT label, min(qid) AS medoid_id, round(any_value(best), 6) AS best FROM (SELECT *, max(m) OVER (PARTITION BY label) AS best FROM (
  SELECT ql AS label, qid, avg(score) AS m FROM pairs WHERE ql = pl GROUP BY ALL)) WHERE abs(m - best) <= 1e-8 + 1e-5 * abs(best) GROUP BY label""", "pairs"))
def medoids(spark, d):
    m = embeddings(spark, d).select("label", F.col("id").alias("point_id"), unit(F.col("vector")).alias("vector"))
    return TP.medoids(m, ["label"]).select("label", "medoid_id", F.round("mean_similarity", 6).alias("best"))


@query("cohesion", sql("""
SELECT ql AS label, round(avg(score), 6) AS cohesion FROM pairs JOIN (SELECT label, min(qid) AS mid FROM (SELECT *, max(m) OVER (PARTITION BY label) AS best FROM (
  SELECT ql AS label, qid, avg(score) AS m FROM pairs WHERE ql = pl GROUP BY ALL)) WHERE abs(m - best) <= 1e-8 + 1e-5 * abs(best) GROUP BY label) ON label = ql AND mid = pid GROUP BY ql""", "pairs"))
def cohesion(spark, d):
    m = embeddings(spark, d).select("label", F.col("id").alias("point_id"), unit(F.col("vector")).alias("vector"))
    return TP.cohesion(m, TP.medoids(m, ["label"]), ["label"])


@query("outliers", sql("""
SELECT ql AS label, qid AS point_id, round(max(score), 6) AS nearest, count(*) >= 2 AND max(score) < 0.6 AS is_outlier FROM pairs WHERE ql = pl AND qid <> pid GROUP BY ALL""", "pairs"))
def outliers(spark, d):
    m = embeddings(spark, d).select("label", F.col("id").alias("point_id"), unit(F.col("vector")).alias("vector"))
    return TP.neighbor_similarity(m, "label").select(
        F.col("group").alias("label"), "point_id",
        F.round("nearest_neighbor_similarity", 6).alias("nearest"), "is_outlier")


@query("silhouette", sql("""
SELECT 'all' AS "group", round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS points FROM (
  SELECT qid, max(CASE WHEN ql = pl THEN n END) AS n, max(CASE WHEN ql = pl THEN s / (n - 1) END) AS a, min(CASE WHEN ql <> pl THEN s / n END) AS b FROM (
    SELECT qid, ql, pl, sum(1 - score) AS s, count(*) AS n FROM pairs GROUP BY qid, ql, pl) GROUP BY qid)""", "pairs"))
def silhouette(spark, d):
    e = embeddings(spark, d).select(F.lit("all").alias("by1"), F.col("id").alias("point_id"),
                                    unit(F.col("vector")).alias("vector"),
                                    F.col("label").cast("int").alias("label"))
    return C.mean_silhouettes(e).select(F.col("by1").alias("group"), F.round("silhouette", 6)
                                        .alias("silhouette"), "points")


@query("load_points", sql("SELECT id AS point_id, by1, support::BIGINT AS support, round(list_sum(v), 6) AS total FROM e", "e"))
def load_points(spark, d):
    return points(spark, d).select("point_id", "by1", "support", F.round(F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# Average linkage: every step merges the closest pair of clusters of each variety.
part("g", "SELECT a.by1, a.id AS i, b.id AS j, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.by1 = b.by1 AND a.id <> b.id", "e")
part("steps", """
SELECT by1, 0 AS step, id AS pid, id AS lab FROM e UNION ALL
SELECT r.by1, r.step + 1, r.pid, CASE WHEN r.lab = m.b THEN m.a ELSE r.lab END FROM steps r JOIN (
  SELECT by1, a, b FROM (
    SELECT x.by1, x.lab AS a, y.lab AS b, round(avg(g.s), 9) AS sim FROM steps x JOIN g ON g.by1 = x.by1 AND g.i = x.pid
    JOIN steps y ON y.by1 = g.by1 AND y.pid = g.j WHERE x.lab < y.lab GROUP BY x.by1, x.lab, y.lab)
  QUALIFY row_number() OVER (PARTITION BY by1 ORDER BY sim DESC, a, b) = 1) m ON m.by1 = r.by1""", "e", "g")
part("cuts", """
SELECT s.*, c.k, c.n FROM steps s JOIN (SELECT by1, step, count(DISTINCT lab) AS k, count(*) AS n FROM steps GROUP BY ALL) c USING (by1, step)
WHERE k BETWEEN 2 AND 8 AND (k < n OR n = 2)""", "steps")
part("sil", """
SELECT by1, k, n, avg(score) AS silhouette FROM (
  SELECT by1, k, n, pid, CASE WHEN max(inner_d) IS NULL THEN 0 WHEN greatest(max(inner_d), min(outer_d)) > 0
    THEN (min(outer_d) - max(inner_d)) / greatest(max(inner_d), min(outer_d)) ELSE 0 END AS score FROM (
    SELECT x.by1, x.k, x.n, x.pid, CASE WHEN x.lab = y.lab THEN avg(1 - g.s) END AS inner_d, CASE WHEN x.lab <> y.lab THEN avg(1 - g.s) END AS outer_d
    FROM cuts x JOIN g ON g.by1 = x.by1 AND g.i = x.pid JOIN cuts y ON y.by1 = x.by1 AND y.k = x.k AND y.pid = g.j GROUP BY x.by1, x.k, x.n, x.pid, x.lab, y.lab)
  GROUP BY by1, k, n, pid) GROUP BY by1, k, n""", "cuts", "g")
part("chosen", """
SELECT by1, CASE WHEN n > 2 AND adjusted >= 0.18 THEN k END AS k, CASE WHEN n > 2 AND adjusted >= 0.18 THEN silhouette ELSE 0 END AS silhouette FROM (
  SELECT sil.*, silhouette - 0.05 * (k - 2) - 0.12 * alone / k AS adjusted FROM sil JOIN (
    SELECT by1, k, count(*) FILTER (m = 1) AS alone FROM (SELECT by1, k, lab, count(*) AS m FROM cuts GROUP BY ALL) GROUP BY by1, k) USING (by1, k))
QUALIFY row_number() OVER (PARTITION BY by1 ORDER BY adjusted DESC, k) = 1""", "sil", "cuts")
part("labelled", """
SELECT e.by1, e.id AS pid, coalesce(h.silhouette, 0.0)::DOUBLE AS silhouette, dense_rank() OVER (PARTITION BY e.by1 ORDER BY coalesce(c.lab, p.lab, '')) AS cluster_id
FROM e LEFT JOIN chosen h ON h.by1 = e.by1 LEFT JOIN cuts c ON c.by1 = e.by1 AND c.k = h.k AND c.pid = e.id
LEFT JOIN (SELECT cuts.by1, cuts.pid, cuts.lab FROM cuts JOIN g ON g.by1 = cuts.by1 AND g.i = cuts.pid WHERE cuts.n = 2 AND g.s < 0.75) p ON p.by1 = e.by1 AND p.pid = e.id""",
     "e", "chosen", "cuts", "g")
part("middle", """
SELECT by1, cluster_id, min(pid) AS medoid_id FROM (
  SELECT *, max(mean) OVER (PARTITION BY by1, cluster_id) AS best FROM (
    SELECT x.by1, x.cluster_id, x.pid, round((1 + coalesce(sum(g.s) FILTER (y.pid IS NOT NULL), 0)) / (1 + count(y.pid)), 12) AS mean
    FROM labelled x LEFT JOIN g ON g.by1 = x.by1 AND g.i = x.pid LEFT JOIN labelled y ON y.by1 = x.by1 AND y.cluster_id = x.cluster_id AND y.pid = g.j GROUP BY x.by1, x.cluster_id, x.pid))
WHERE abs(mean - best) <= 1e-8 + 1e-5 * abs(best) GROUP BY by1, cluster_id""", "labelled", "g")
part("detail", """
SELECT l.pid AS point_id, l.by1, l.cluster_id, l.silhouette, m.medoid_id, 'text ' || m.medoid_id AS representative, e.support, e.form_code, 'D' || right(e.id, 1) AS spec,
  CASE WHEN l.pid = m.medoid_id THEN 1.0 ELSE t.s END::DOUBLE AS similarity, coalesce(n.near, 1.0)::DOUBLE AS near, coalesce(n.others, 0) >= 2 AND n.near < 0.6 AS is_outlier
FROM labelled l JOIN e ON e.id = l.pid JOIN middle m ON m.by1 = l.by1 AND m.cluster_id = l.cluster_id LEFT JOIN g t ON t.by1 = l.by1 AND t.i = l.pid AND t.j = m.medoid_id
LEFT JOIN (SELECT i, round(max(s), 9) AS near, count(*) AS others FROM g GROUP BY i) n ON n.i = l.pid""", "labelled", "middle", "g", "e")
part("varieties", """
SELECT by1, count(*) AS description_count, sum(support)::BIGINT AS support_total, count(DISTINCT cluster_id) AS cluster_count, round_even(max(silhouette), 6) AS silhouette,
  round_even(avg(similarity), 6) AS average_cohesion, count(*) FILTER (is_outlier) AS outlier_count, CASE WHEN count(*) = 1 THEN 'insufficient_sample' ELSE 'clustered' END AS status FROM detail GROUP BY by1""", "detail")


def _detail(spark, d):
    return cut_lineage(C.cluster_descriptions(points(spark, d)))


@query("cluster_descriptions", sql("""
SELECT point_id, by1, cluster_id, round(silhouette, 6) AS silhouette, medoid_id, representative, round(similarity, 6) AS similarity_to_medoid, round(near, 6) AS nearest_neighbor_similarity, is_outlier FROM detail""", "detail"))
def cluster_descriptions(spark, d):
    return C.cluster_descriptions(points(spark, d)).select(
        "point_id", "by1", F.col("cluster_id").cast("bigint").alias("cluster_id"),
        F.round("silhouette", 6).alias("silhouette"), "medoid_id", "representative",
        F.round("similarity_to_medoid", 6).alias("similarity_to_medoid"),
        F.round("nearest_neighbor_similarity", 6).alias("nearest_neighbor_similarity"), "is_outlier")


@query("cluster_summary", sql("""
SELECT by1, cluster_id, count(*) AS member_count, sum(support)::BIGINT AS support_total, any_value(representative) AS representative, array_to_string(list_sort(list(DISTINCT form_code)), ', ') AS form_codes,
  array_to_string(list_sort(list(DISTINCT spec)), ', ') AS specifications, round_even(avg(similarity), 6) AS average_cohesion, count(*) FILTER (is_outlier) AS outlier_count FROM detail GROUP BY by1, cluster_id""", "detail"))
def cluster_summary(spark, d):
    return C.cluster_summary(_detail(spark, d)).withColumn(
        "cluster_id", F.col("cluster_id").cast("bigint"))


@query("variety_summary", sql("SELECT * FROM varieties", "varieties"))
def variety_summary(spark, d):
    return C.variety_summary(_detail(spark, d))


@query("cluster_report", sql("""
SELECT unnest(['by1_count', 'description_count', 'cluster_count', 'insufficient_by1_count', 'outlier_count']) AS measure,
  unnest([count(*), sum(description_count), sum(cluster_count), count(*) FILTER (status = 'insufficient_sample'), sum(outlier_count)])::BIGINT AS value FROM varieties
UNION ALL SELECT 'varieties_with_' || cluster_count, count(*) FROM varieties GROUP BY cluster_count
UNION ALL (SELECT 'top_' || by1, description_count FROM varieties ORDER BY description_count DESC, by1 LIMIT 10)
UNION ALL SELECT 'listed_outliers', count(*) FROM detail WHERE is_outlier""", "varieties", "detail"))
def cluster_report(spark, d):
    detail = _detail(spark, d)
    varieties = cut_lineage(C.variety_summary(detail))
    meta = C.run_metadata(varieties, "embeddings").select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("value")) for c in (
            "by1_count", "description_count", "cluster_count", "insufficient_by1_count",
            "outlier_count")])).alias("m")).select("m.*")
    spread = C.cluster_count_distribution(varieties).select(
        F.concat(F.lit("varieties_with_"), "cluster_count").alias("measure"),
        F.col("by1_count").alias("value"))
    top = C.top_varieties(varieties).select(
        F.concat(F.lit("top_"), "by1").alias("measure"), F.col("description_count").alias("value"))
    listed = C.outlier_listing(detail).groupBy().agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("listed_outliers").alias("measure"), "value")
    return meta.unionByName(spread).unionByName(top).unionByName(listed)


# Templates over order history. Members are (description, form, variety, specification) groups.
part("mem", """
SELECT raw_description AS raw, form_code, by1, spec, count(*) AS support, sha1(concat_ws('|', by1, form_code, spec, raw_description)) AS pid FROM hist GROUP BY ALL""", "hist")
part("tmem", """
SELECT m.*, 'tpl-' || upper(left(sha1(m.by1 || '|' || sig || '|' || cid), 12)) AS tid, coalesce(z.size, '') AS size FROM (
  SELECT m.*, upper(s.semantic_text) AS sig, dense_rank() OVER (PARTITION BY m.by1 ORDER BY upper(s.semantic_text)) AS cid FROM mem m JOIN segs s ON s.raw = m.raw) m JOIN sized z ON z.raw = m.raw""",
     "mem", "segs", "sized")
part("tpl", """
SELECT tid, any_value(by1) AS by1, any_value(cid) AS cid, any_value(sig) AS sig, min(pid) AS rep, min_by(raw, pid) AS rep_raw, sum(support)::BIGINT AS support, count(*) AS members,
  list_sort(list(DISTINCT form_code) FILTER (form_code <> '')) AS forms FROM tmem GROUP BY tid""", "tmem")


def _members(spark, d):
    return cut_lineage(J.template_member_rows(past(stored(spark, d))))


@query("template_clusters", sql("SELECT pid AS point_id, by1, sig AS signature, cid AS cluster_id, tid AS template_id FROM tmem", "tmem"))
def template_clusters(spark, d):
    return TP.assign_templates(TP.prepare_members(_members(spark, d))).select(
        "point_id", "by1", "signature", F.col("cluster_id").cast("bigint").alias("cluster_id"),
        "template_id")


@query("template_summary", sql("""
SELECT tid AS template_id, by1, cid AS cluster_id, sig AS structural_signature, rep AS representative_point_id, rep_raw AS representative_description, support, members AS member_count,
  array_to_string(forms, '|') AS forms, 1.0::DOUBLE AS cohesion, 0 AS outlier_count, CASE WHEN members = 1 THEN 'insufficient_sample' ELSE 'clustered' END AS template_status FROM tpl""", "tpl"))
def template_summary(spark, d):
    t = TP.build_templates(_members(spark, d))["templates"]
    return t.select("template_id", "by1", "cluster_id", "structural_signature",
                    "representative_point_id", "representative_description", "support",
                    "member_count", F.array_join("supported_form_codes", "|").alias("forms"),
                    "cohesion", "outlier_count", "template_status")


@query("spec_profiles", sql("""
SELECT tid AS template_id, form_code, spec, kind, n FROM (SELECT tid, form_code, spec, 'all' AS kind, count(*) AS n FROM tmem GROUP BY ALL
  UNION ALL SELECT tid, form_code, spec, size, count(*) FROM tmem WHERE size <> '' GROUP BY ALL UNION ALL SELECT tid, form_code, '', 'support', sum(support)::BIGINT FROM tmem GROUP BY ALL)""", "tmem"))
def spec_profiles(spark, d):
    assigned = TP.assign_templates(TP.prepare_members(_members(spark, d)))
    p = cut_lineage(TP.spec_profiles(TP.profile_counts(assigned)))
    whole = p.select("template_id", "form_code", F.explode("spec_distribution").alias("spec", "n"),
                     F.lit("all").alias("kind"))
    sized = p.select("template_id", "form_code", F.explode("size_to_spec_distribution")
                     .alias("kind", "m")).select("template_id", "form_code", F.explode("m").alias(
                         "spec", "n"), "kind")
    total = p.select("template_id", "form_code", F.lit("").alias("spec"),
                     F.col("support").alias("n"), F.lit("support").alias("kind"))
    return whole.unionByName(sized).unionByName(total)


part("allviews", _VIEW_SQL, "segs")
part("rq", "SELECT DISTINCT raw_description AS raw, h.description, form_code FROM hold h WHERE h.description NOT IN (SELECT description FROM descs)", "hold", "descs")
part("slots", r"""
SELECT txt, slot, count(*)::DOUBLE AS c FROM (SELECT txt, ('0x' || left(md5(token), 6))::INT % 64 AS slot FROM (
  SELECT txt, unnest(list_distinct(string_split(trim(regexp_replace(replace(upper(txt), 'BUNA-N', 'NBR'), '[^\p{L}\p{N}]+', ' ', 'g')), ' '))) AS token FROM (SELECT DISTINCT semantic_text AS txt FROM segs))) GROUP BY ALL""", "segs")
part("cosine", """
SELECT a, b, round(s / (na * nb), 12) AS cos FROM (SELECT x.txt AS a, y.txt AS b, sum(x.c * y.c) AS s FROM (SELECT * FROM slots WHERE txt IN (SELECT s.semantic_text FROM segs s JOIN rq ON rq.raw = s.raw)) x JOIN slots y USING (slot) GROUP BY ALL)
 JOIN (SELECT txt AS a, sqrt(sum(c * c)) AS na FROM slots GROUP BY txt) USING (a) JOIN (SELECT txt AS b, sqrt(sum(c * c)) AS nb FROM slots GROUP BY txt) USING (b)""", "slots", "segs", "rq")
part("qf", "SELECT rq.raw, form_code, field, value FROM rq JOIN allviews v ON v.description = rq.raw WHERE field <> 'size'", "rq", "allviews")
part("tf", "SELECT tid, field, value FROM tpl JOIN allviews v ON v.description = tpl.rep_raw WHERE field <> 'size'", "tpl", "allviews")
part("thits", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw, form_code ORDER BY score DESC, fits DESC, support DESC, tid DESC) AS rank FROM (
  SELECT r.raw, r.form_code, t.tid, t.by1, t.rep_raw, t.support, list_contains(t.forms, r.form_code) AS fits,
    round_even(0.70 * coalesce(c.cos, 0) + 0.20 * (coalesce(m.same, 0) / r.nf) + 0.05 * list_contains(t.forms, r.form_code)::INT + 0.05 * least(ln(1 + t.support) / 6, 1), 4) AS score, coalesce(m.same, 0) / r.nf AS ratio
  FROM (SELECT raw, form_code, count(*) AS nf FROM qf GROUP BY ALL) r JOIN segs s ON s.raw = r.raw CROSS JOIN tpl t JOIN segs u ON u.raw = t.rep_raw
   LEFT JOIN cosine c ON c.a = s.semantic_text AND c.b = u.semantic_text
   LEFT JOIN (SELECT q.raw, q.form_code, tf.tid, count(*) FILTER (q.value = tf.value) AS same, count(*) FILTER (q.value <> tf.value) AS clash FROM qf q JOIN tf USING (field) GROUP BY ALL) m ON m.raw = r.raw AND m.form_code = r.form_code AND m.tid = t.tid
  WHERE coalesce(m.clash, 0) = 0)) WHERE rank <= 50""", "qf", "tf", "tpl", "cosine", "segs")


def _template_hits(spark, d):
    rows = stored(spark, d)
    built = TP.build_templates(cut_lineage(J.template_member_rows(past(rows))))
    asked = cut_lineage(J.request_views(_unseen(rows)))
    hits = cut_lineage(TP.retrieve_templates(asked, cut_lineage(built["templates"])))
    return asked, hits, built


@query("template_retrieve", sql("SELECT raw AS query, form_code, tid AS template_id, score, fits AS form_match, round_even(ratio, 4) AS match_ratio, support, rank FROM thits", "thits"))
def template_retrieve(spark, d):
    asked, hits, _ = _template_hits(spark, d)
    return hits.join(asked.select("request_id", "query", "form_code"), "request_id").select(
        "query", "form_code", "template_id", "score", "form_match", "match_ratio", "support",
        F.col("rank").cast("bigint").alias("rank"))


@query("template_by1", sql("""
SELECT query, form_code, by1, score, support, form_match, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, form_code ORDER BY score DESC, support DESC, by1) AS rank FROM (
  SELECT raw AS query, form_code, by1, round_even(max(score) + CASE WHEN bool_or(fits) THEN 0.03 ELSE 0 END, 4) AS score, sum(support)::BIGINT AS support, bool_or(fits) AS form_match FROM thits GROUP BY raw, form_code, by1)) WHERE rank <= 5""", "thits"))
def template_by1(spark, d):
    asked, hits, _ = _template_hits(spark, d)
    return TP.by1_from_templates(hits).join(asked.select("request_id", "query", "form_code"),
                                            "request_id").select(
        "query", "form_code", "by1", "score", "support", "form_match",
        F.col("rank").cast("bigint").alias("rank"))


@query("profile_inference", sql("""
SELECT query, form_code, spec AS value, n, total, rank FROM (SELECT *, sum(n) OVER (PARTITION BY query, form_code)::BIGINT AS total, row_number() OVER (PARTITION BY query, form_code ORDER BY n DESC, spec) AS rank FROM (
  SELECT query, form_code, spec, count(*) AS n FROM (SELECT h.raw AS query, h.form_code, m.spec, m.size = z.size AS hit, bool_or(coalesce(m.size = z.size, false)) OVER (PARTITION BY h.raw, h.form_code, h.tid, m.form_code) AS any_hit
    FROM thits h JOIN tmem m ON m.tid = h.tid AND m.form_code IN ('', h.form_code) JOIN sized z ON z.raw = h.raw WHERE h.score >= 0.6) WHERE NOT any_hit OR hit GROUP BY ALL)) WHERE total >= 2 AND rank <= 10""", "thits", "tmem", "sized"))
def profile_inference(spark, d):
    asked, hits, built = _template_hits(spark, d)
    found = TP.profile_hits(asked, hits, built["profiles"])
    return found.select("query", "form_code", "total", F.explode("ranked").alias("r")).select(
        "query", "form_code", "total", "r.value", "r.n", F.col("r.rank").cast("bigint").alias("rank"))


_ = top_k
