"""Queries over evidence tables, mined rules, cascades, fuzzy inference and composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import blank
from ..operators import cascade as K
from ..operators import design as DS
from ..operators import evidence as EV
from ..operators import fuzzy as Z
from ..operators import history as H
from ..operators import rules as R
from ..operators.rules import mature_attribute_rules
from ..plans import jobs as J
from ..plans.scale import cut_lineage, in_slices
from ..sources.orders import TRAIN_BEFORE, VALIDATION_BEFORE, order_history, window_tag
from .inputs import (as_lookup, history, keys, later, needed, new_folder, past, prepared, requests,
                     stored)
from .oracle_parts import PARTS, first_hits, label, part, sql
from .registry import query

DATES = "strftime(min(date), '%Y-%m-%d') AS date_min, strftime(max(date), '%Y-%m-%d') AS date_max"


def iso(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query("recommendation_records", sql(f"""
SELECT r.description, form_code, by1, spec, count, example, date_min, date_max, spec_prefix, spec_size, s.semantic_text AS semantic_description FROM (
  SELECT description, form_code, by1, spec, count(*) AS count, min_by(raw_description, (date, row_id)) AS example, {DATES},
    any_value(spec_prefix) AS spec_prefix, any_value(spec_size) AS spec_size FROM hist GROUP BY description, form_code, by1, spec) r
JOIN segs s ON s.raw = r.example""", "hist", "segs"))
def recommendation_records(spark, d):
    return H.recommendation_records(history(spark, d)).withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("date_min", "date_max")})


_COUNTERS = " UNION ALL ".join(
    f"SELECT description, form_code, by1, spec, '{n}' AS counter, {c} AS value, count(*) AS count FROM hist WHERE {c} <> '' GROUP BY ALL"
    for n, c in H.COUNTERS.items())


@query("record_counters", sql(_COUNTERS, "hist"))
def record_counters(spark, d):
    return H.record_counters(history(spark, d))


@query("spec_records", sql("""
SELECT description, by1 AS form_code, spec, count(*) AS count, min_by(raw_description, (date, row_id)) AS example FROM hist GROUP BY description, by1, spec""",
    "hist"))
def spec_records(spark, d):
    return H.spec_records(history(spark, d))


@query("spec_record_customers", sql("""
SELECT description, by1 AS form_code, spec, customer_key, count(*) AS count FROM hist GROUP BY ALL""", "hist"))
def spec_record_customers(spark, d):
    return H.spec_record_customers(history(spark, d))


@query("index_profile", sql(f"""
SELECT count(*) AS input_rows, count(*) AS indexed_rows, {DATES}, count(DISTINCT description) AS descriptions, count(DISTINCT by1) AS by1s,
  count(DISTINCT spec) AS specifications, count(DISTINCT form_code) AS form_codes FROM hist""", "hist"))
def index_profile(spark, d):
    return H.source_profile(history(spark, d)).withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("date_min", "date_max")})


@query("history_windows", sql(f"""
SELECT CASE WHEN date < DATE '{TRAIN_BEFORE}' THEN 'train' WHEN date < DATE '{VALIDATION_BEFORE}' THEN 'validation' ELSE 'holdout' END AS "window",
  count(*) AS rows, count(*) FILTER (form_code <> '') AS with_form FROM prep GROUP BY 1""", "prep"))
def history_windows(spark, d):
    tag = window_tag(F.col("date"), TRAIN_BEFORE, VALIDATION_BEFORE)
    return prepared(spark, d).groupBy(tag.alias("window")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("form_code") != "").alias("with_form"))


# Columns of the order rows: those of requests, with rules, with the specification index. Keys of
# every evidence level, for its slices.
ASKED = ["date", "raw_description", "description", "form_code", "by1", "spec", "customer_key"]
RULED = [*ASKED, "parsed_spec"]
LEGACY = [*RULED, "row_id", "document_key"]
PARTED = ["description", "value"]

_EV = "SELECT level, description, form_code, customer_key, value, n::BIGINT AS n FROM ev_{}"


@query("evidence_by1", sql(_EV.format("by1"), "ev_by1"))
def evidence_by1(spark, d):
    return in_slices(H.evidence_levels(past(needed(spark, d, *ASKED)), "by1"), PARTED)


@query("evidence_spec", sql(_EV.format("spec"), "ev_spec"))
def evidence_spec(spark, d):
    return in_slices(H.evidence_levels(past(needed(spark, d, *ASKED)), "spec"), PARTED)


@query("evidence_legacy", sql(_EV.format("legacy"), "ev_legacy"))
def evidence_legacy(spark, d):
    return in_slices(H.legacy_evidence_levels(past(needed(spark, d, *LEGACY))), PARTED)


def _tag(spark, d, form):
    """Counted rule rows, parsed once however often a query reads them."""
    return cut_lineage(R.rule_rows(prepared(spark, d), form))


def _form_rules(rows):
    return R.prefix_rules(cut_lineage(R.rule_rows(rows, "form_code")), literal_spec=True)


@query("prefix_purity", sql(
    'SELECT form, win AS "window", prefix, support::BIGINT AS support, round(purity, 9) AS purity FROM pur_tag_form', "pur_tag_form"))
def prefix_purity(spark, d):
    return R.prefix_purity(_tag(spark, d, "form_code")).withColumn("purity", F.round("purity", 9))


@query("prefix_gate", sql(
    "SELECT form, prefix, train_support::BIGINT AS train_support, validation_support::BIGINT AS validation_support FROM gate_tag_form", "gate_tag_form"))
def prefix_gate(spark, d):
    return R.prefix_gate(R.prefix_purity(_tag(spark, d, "form_code")))


_RULES = ("SELECT form, prefix, train_support::BIGINT AS train_support, validation_support::BIGINT AS validation_support, "
          "train_combined_support, validation_combined_support FROM rules_{}")


@query("prefix_rules", sql(_RULES.format("tag_form"), "rules_tag_form"))
def prefix_rules(spark, d):
    return R.prefix_rules(_tag(spark, d, "form_code"), literal_spec=True)


@query("spec_rules", sql(_RULES.format("tag_by1"), "rules_tag_by1"))
def spec_rules(spark, d):
    return J.build_spec_rules(prepared(spark, d))["rules"]


@query("rule_holdout", sql("""
SELECT count(*) AS holdout_rows, count(*) FILTER (p IS NOT NULL) AS prefix_covered, count(*) FILTER (p = spec_prefix) AS prefix_correct,
  count(*) FILTER (p IS NOT NULL AND size IS NOT NULL) AS combined_covered, count(*) FILTER (p || size = spec_prefix || spec_size) AS combined_correct,
  round_even(count(*) FILTER (p IS NOT NULL) / count(*), 4) AS prefix_coverage,
  coalesce(round_even(count(*) FILTER (p = spec_prefix) / nullif(count(*) FILTER (p IS NOT NULL), 0), 4), 0) AS prefix_accuracy,
  round_even(count(*) FILTER (p IS NOT NULL AND size IS NOT NULL) / count(*), 4) AS combined_coverage,
  coalesce(round_even(count(*) FILTER (p || size = spec_prefix || spec_size) / nullif(count(*) FILTER (p IS NOT NULL AND size IS NOT NULL), 0), 4), 0) AS combined_accuracy
FROM (SELECT t.*, r.prefix AS p, s.size FROM tag_form t LEFT JOIN rules_tag_form r ON r.form = t.form JOIN sized s ON s.raw = t.raw WHERE win = 'holdout')""",
    "tag_form", "rules_tag_form", "sized"))
def rule_holdout(spark, d):
    tagged = _tag(spark, d, "form_code")
    return R.rule_holdout(tagged, R.prefix_rules(tagged, literal_spec=True))


part("arules", f"""
SELECT * FROM (SELECT by1, form_code, field, any_value(v) FILTER (win = 't') AS value, max(s) FILTER (win = 't') AS train_support, max(s) FILTER (win = 'v') AS validation_support,
    max(p) FILTER (win = 't') AS tp, max(p) FILTER (win = 'v') AS vp, any_value(v) FILTER (win = 'v') AS vv FROM (
  SELECT by1, form_code, field, win, min_by(value, (-n, value)) AS v, sum(n) AS s, max(n) / sum(n) AS p FROM (
    SELECT p.by1, f.form_code, a.field, CASE WHEN date <= DATE '1998-12-31' THEN 't' ELSE 'v' END AS win, a.value, count(*) AS n
    FROM prep p JOIN dattr a ON a.raw = p.raw_description AND a.by1 = p.by1, LATERAL (SELECT DISTINCT unnest(['', p.form_code]) AS form_code) f
    WHERE date <= DATE '2000-06-30' GROUP BY ALL) GROUP BY ALL) GROUP BY by1, form_code, field)
WHERE train_support >= 20 AND validation_support >= 5 AND value = vv AND vp = 1
  AND tp >= CASE WHEN field IN ('body_material', 'seat_material', 'closure_material', 'pressure', 'standard_certification', 'size') THEN 1.0 ELSE 0.99 END""",
     "prep", "dattr")


@query("attribute_rules", sql("""
SELECT by1, form_code, field, value, 0.99::DOUBLE AS confidence, train_support::BIGINT AS train_support, validation_support::BIGINT AS validation_support,
  round_even(tp, 6) AS train_purity, round_even(vp, 6) AS validation_purity, true AS active FROM arules""", "arules"))
def attribute_rules(spark, d):
    rows = cut_lineage(prepared(spark, d).groupBy(*DS.DESIGN_KEY, "date").agg(
        F.count(F.lit(1)).alias("n")))
    seen = DS.only_valves(cut_lineage(DS.observe(rows.select(*DS.DESIGN_KEY).distinct())))
    return mature_attribute_rules(rows.join(seen.select(*DS.DESIGN_KEY, "attributes"),
                                            DS.DESIGN_KEY), "1998-12-31", "2000-06-30")


_NAME = "CASE level WHEN 'description_form' THEN 'description_form_code' WHEN 'rule' THEN 'mature_form_rule' ELSE level END"


@query("exact_by1", sql(f"""
SELECT query, form_code, {_NAME} AS match_level, rank, value, round_even(n / total, 4) AS score, n::BIGINT AS support FROM by1_hit WHERE rank <= 5""",
    "by1_hit"))
def exact_by1(spark, d):
    rows = needed(spark, d, *ASKED)
    index = as_lookup(EV.evidence_index(past(rows), "by1"), EV.KEYS)
    answers = in_slices(K.by1_answers(keys(later(rows)), index), ["description"])
    return answers.select("query", "form_code", F.col("by1_match_level").alias("match_level"),
                          F.explode("by1_candidates").alias("c")).select(
        "query", "form_code", "match_level", F.col("c.rank").cast("bigint").alias("rank"),
        "c.value", "c.score", "c.support")


part("creq", "SELECT DISTINCT raw_description AS query, description, form_code, customer_key FROM hold", "hold")
part("rule_rank", """
SELECT 'rule' AS level, q.query, q.form_code, 1 AS rank, r.prefix || s.size AS value, r.train_support + r.validation_support AS n, s.rule, s.raw
FROM (SELECT DISTINCT query, form_code FROM creq) q JOIN rules_tag_form r ON r.form = q.form_code JOIN sized s ON s.raw = q.query AND s.size IS NOT NULL""",
     "creq", "rules_tag_form", "sized")
_K4 = "query, form_code, customer_key"
part("spec_hit", first_hits("creq", "(SELECT rank, value, n, total, level, description, form_code, customer_key, '' AS rq FROM rk_spec "
     "UNION ALL SELECT rank, value, n, n, 'rule', q.description, rr.form_code, '', rr.query FROM rule_rank rr JOIN (SELECT DISTINCT query, description FROM creq) q ON q.query = rr.query)", [
    ("description_form_customer", "e.form_code = q.form_code AND e.customer_key = q.customer_key"),
    ("description_form", "e.form_code = q.form_code"),
    ("rule", "e.form_code = q.form_code AND e.rq = q.query"),
    ("description_customer", "e.customer_key = q.customer_key"), ("description", "true")], _K4),
     "creq", "rk_spec", "rule_rank")


@query("exact_spec", sql(f"""
SELECT query, form_code, customer_key, match_level, rank, value, score, support, confidence, CASE WHEN confidence <> 'low' THEN top ELSE '' END AS inferred_spec FROM (
  SELECT query, form_code, customer_key, {_NAME} AS match_level, rank, value, CASE WHEN level = 'rule' THEN 0.995 ELSE round_even(n / total, 4) END AS score, n::BIGINT AS support,
    first_value(value) OVER w AS top,
    CASE WHEN level = 'rule' THEN 'high' ELSE {label('first_value(round_even(n / total, 4)) OVER w', 'first_value(n) OVER w')} END AS confidence
  FROM spec_hit WHERE rank <= 10 WINDOW w AS (PARTITION BY query, form_code, customer_key ORDER BY rank))""", "spec_hit"))
def exact_spec(spark, d):
    rows = needed(spark, d, *RULED)
    index = as_lookup(EV.evidence_index(past(rows), "spec"), EV.KEYS)
    answers = in_slices(K.spec_answers(keys(later(rows), customer=True), index,
                                       _form_rules(rows)), ["description"])
    return answers.select(
        "query", "form_code", "customer_key", F.col("spec_match_level").alias("match_level"),
        F.col("spec_confidence").alias("confidence"), blank(F.col("inferred_spec"))
        .alias("inferred_spec"), F.explode("spec_alternatives").alias("c")).select(
        "query", "form_code", "customer_key", "match_level", "confidence", "inferred_spec",
        F.col("c.rank").cast("bigint").alias("rank"), "c.value", "c.score", "c.support")


part("lrule_rank", """
SELECT q.query, q.description, q.form_code, r.prefix || s.size AS value, r.train_support + r.validation_support AS n, s.rule
FROM (SELECT DISTINCT query, description, form_code FROM lreq) q JOIN rules_tag_by1 r ON r.form = q.form_code JOIN sized s ON s.raw = q.query AND s.size IS NOT NULL""",
     "lreq", "rules_tag_by1", "sized")
part("legacy_hit", first_hits("lreq", "(SELECT rank, value, n, total, level, description, form_code, customer_key, '' AS rq FROM rk_legacy "
     "UNION ALL SELECT 1, value, n, n, 'rule', description, form_code, '', query FROM lrule_rank)", [
    ("description_form_customer", "e.form_code = q.form_code AND e.customer_key = q.customer_key"),
    ("rule", "e.form_code = q.form_code AND e.rq = q.query"),
    ("description_form", "e.form_code = q.form_code"),
    ("description_customer", "e.customer_key = q.customer_key"), ("description", "true")], _K4),
     "lreq", "rk_legacy", "lrule_rank")
_LNAME = "CASE level WHEN 'description_form_customer' THEN 'description_customer_form' WHEN 'rule' THEN 'mature_rule' ELSE level END"
_REL = "CASE level WHEN 'description_form_customer' THEN 0.984 WHEN 'description_form' THEN 0.868 WHEN 'description_customer' THEN 0.940 ELSE 0.952 END"
_LSCORE = f"round_even(first_value(round_even(n / total, 4)) OVER w * {_REL}::DOUBLE, 4)"
part("legacy_out", f"""
SELECT query, form_code, customer_key, match_level, rank, value, score, support, confidence_score, confidence, CASE WHEN confidence <> 'low' THEN top ELSE '' END AS inferred_spec FROM (
 SELECT *, CASE WHEN level = 'rule' THEN 'high' ELSE {label('confidence_score', 'top_n')} END AS confidence FROM (
  SELECT query, form_code, customer_key, level, {_LNAME} AS match_level, rank, value, CASE WHEN level = 'rule' THEN 0.995 ELSE round_even(n / total, 4) END AS score, n::BIGINT AS support,
    first_value(value) OVER w AS top, first_value(n) OVER w AS top_n, CASE WHEN level = 'rule' THEN 0.995 ELSE {_LSCORE} END AS confidence_score
  FROM legacy_hit WINDOW w AS (PARTITION BY query, form_code, customer_key ORDER BY rank)))""", "legacy_hit")


def _legacy_rows(answers):
    return answers.select(
        "query", "form_code", "customer_key", "match_level", "confidence", "confidence_score",
        blank(F.col("inferred_spec")).alias("inferred_spec"),
        F.explode("alternatives").alias("c")).select(
        "query", "form_code", "customer_key", "match_level", "confidence", "confidence_score",
        "inferred_spec", F.col("c.rank").cast("bigint").alias("rank"), "c.value", "c.score",
        "c.support")


@query("legacy_spec", sql("SELECT * FROM legacy_out WHERE rank <= 50", "legacy_out"))
def legacy_spec(spark, d):
    rows = needed(spark, d, *LEGACY)
    rules = R.prefix_rules(cut_lineage(R.rule_rows(rows, "by1")))
    asked = keys(later(rows), "by1", customer=True)
    index = as_lookup(EV.legacy_evidence_index(past(rows)), EV.KEYS)
    return _legacy_rows(in_slices(K.legacy_answers(asked, index, rules), ["description"]))


@query("written_index", sql(" UNION ALL ".join(
    f"SELECT '{kind}' AS kind, level, description, form_code, customer_key, rank, value, n::BIGINT AS n, total::BIGINT AS total, count(*) OVER k AS candidates "
    f"FROM rk_{kind} WHERE form_code <> '' OR level IN ('description', 'description_customer') WINDOW k AS (PARTITION BY level, description, form_code, customer_key)"
    for kind in ("by1", "spec", "legacy")), "rk_by1", "rk_spec", "rk_legacy"))
def written_index(spark, d):
    """Both indexes stored and read again, their evidence as long rows."""
    rows = stored(spark, d)
    path = new_folder(spark, "index")
    J.write_index(J.build_recommendation_index(rows, VALIDATION_BEFORE), f"{path}/recommendation")
    J.write_index(J.build_spec_index(rows, VALIDATION_BEFORE), f"{path}/specification")
    read = {**J.read_index(spark, f"{path}/recommendation", ["by1_evidence", "spec_evidence"]),
            **J.read_index(spark, f"{path}/specification", ["evidence"])}
    out = None
    for kind, name in (("by1", "by1_evidence"), ("spec", "spec_evidence"), ("legacy", "evidence")):
        part = EV.evidence_rows(read[name]).select(
            F.lit(kind).alias("kind"), "*").withColumn("rank", F.col("rank").cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


# Fuzzy inference.
part("descs", "SELECT DISTINCT description FROM hist", "hist")
part("idf", """
SELECT token, count(*) AS df, ln(((SELECT count(*) FROM descs) + 1) / (count(*) + 1)) + 1 AS idf FROM (
  SELECT DISTINCT description, unnest(string_split(description, ' ')) AS token FROM descs) GROUP BY token""", "descs")
part("fq", "SELECT DISTINCT description FROM hold WHERE description NOT IN (SELECT description FROM descs)", "hold", "descs")
part("qtok", """SELECT DISTINCT q.description AS qd, t.token, coalesce(idf, ln((SELECT count(*) FROM descs) + 1) + 1) AS w FROM (
  SELECT description, unnest(string_split(description, ' ')) AS token FROM fq) t JOIN fq q USING (description) LEFT JOIN idf USING (token)""", "fq", "idf", "descs")
part("ctok", """SELECT DISTINCT description AS cd, token, idf AS w FROM (
  SELECT description, unnest(string_split(description, ' ')) AS token FROM descs) JOIN idf USING (token)""", "descs", "idf")
part("jac", """
SELECT * FROM (SELECT qd, cd, round(s / (qw + cw - s), 9) AS similarity, row_number() OVER (PARTITION BY qd ORDER BY round(s / (qw + cw - s), 9) DESC, cd DESC) AS rank FROM (
  SELECT qd, cd, sum(q.w) AS s FROM qtok q JOIN ctok c USING (token) GROUP BY qd, cd) JOIN (SELECT qd, sum(w) AS qw FROM qtok GROUP BY qd) USING (qd) JOIN (SELECT cd, sum(w) AS cw FROM ctok GROUP BY cd) USING (cd)
  WHERE round(s / (qw + cw - s), 9) >= 0.2) WHERE rank <= 100""", "qtok", "ctok")


@query("idf", sql("SELECT token, df, round(idf, 9) AS idf FROM idf", "idf"))
def idf(spark, d):
    return Z.token_idf(history(spark, d)).select("token", "df", F.round("idf", 9).alias("idf"))


def _unseen(rows, form="form_code", customer=False):
    known = past(rows).select("description").distinct()
    return keys(later(rows), form, customer).join(known, "description", "left_anti")


@query("weighted_jaccard", sql("SELECT qd AS query, cd AS candidate, round(similarity, 6) AS similarity, rank FROM jac", "jac"))
def weighted_jaccard(spark, d):
    rows = stored(spark, d)
    records = cut_lineage(past(rows).select("description").distinct())
    best = Z.best_descriptions(_unseen(rows), records, cut_lineage(Z.token_idf(records)))
    return best.select(F.col("qid").alias("query"), F.col("cid").alias("candidate"),
                       F.round("similarity", 6).alias("similarity"),
                       F.col("rank").cast("bigint").alias("rank"))


part("fuzz", f"""
SELECT *, CASE WHEN confidence <> 'low' THEN top_spec ELSE '' END AS inferred_spec FROM (SELECT *, {label('confidence_score', 'top_count')} AS confidence FROM (
SELECT *, round_even(greatest(least(tsim + CASE WHEN tfit THEN 0.1 WHEN NOT tfit THEN -0.2 ELSE 0 END + CASE WHEN tform THEN 0.05 ELSE 0 END + CASE WHEN tcust THEN 0.05 ELSE 0 END
    + CASE WHEN (top - second) / top < 0.05 THEN -0.15 ELSE 0 END, 1.0), 0.0), 4) AS confidence_score FROM (
 SELECT *, max(rs) OVER w AS top, coalesce(nth_value(rs, 2) OVER wf, 0) AS second, first_value(spec) OVER wf AS top_spec, first_value(count) OVER wf AS top_count, first_value(similarity) OVER wf AS tsim,
   first_value(fit) OVER wf AS tfit, first_value(form_match) OVER wf AS tform, first_value(cust) OVER wf AS tcust, row_number() OVER (PARTITION BY query, form_code, customer_key ORDER BY rs DESC, spec) AS rank FROM (
  SELECT query, form_code, customer_key, spec, max_by(struct_pack(rs, similarity, count, fit, cust, form_match), (rs, similarity, count, cd, rform)) AS b, unnest(max_by(struct_pack(rs, similarity, count, fit, cust, form_match), (rs, similarity, count, cd, rform))) FROM (
   SELECT q.*, r.spec, r.count, j.similarity, j.cd, r.form_code AS rform, fit, cust, r.form_code = q.form_code AS form_match,
     round(j.similarity * CASE WHEN fit THEN 1.30 WHEN NOT fit THEN 0.45 ELSE 1.0 END * (1.0 + CASE WHEN r.form_code = q.form_code THEN 0.12 ELSE 0 END + CASE WHEN cust THEN 0.08 ELSE 0 END) * (1.0 + least(ln(1 + r.count) * 0.03, 0.12)), 9) AS rs
   FROM lreq q JOIN jac j ON j.qd = q.description JOIN (SELECT description, by1 AS form_code, spec, count(*) AS count, list(DISTINCT customer_key) AS cs FROM hist GROUP BY ALL) r ON r.description = j.cd,
    LATERAL (SELECT CASE WHEN sz = '' THEN NULL ELSE sz = regexp_extract(r.spec, '([0-9]+)$', 1) END AS fit, list_contains(r.cs, q.customer_key) AS cust FROM (SELECT regexp_extract(q.query, '(?:DN)?([0-9]+)(?:MM)?(?:, LOCKABLE)?$', 1) AS sz0, CASE WHEN regexp_matches(q.query, '\\bDN[0-9]|[0-9]MM') THEN regexp_extract(replace(q.query, ', LOCKABLE', ''), '([0-9]+)(MM)?$', 1) ELSE '' END AS sz)) l)
  GROUP BY query, form_code, customer_key, spec)
 WINDOW w AS (PARTITION BY query, form_code, customer_key), wf AS (PARTITION BY query, form_code, customer_key ORDER BY rs DESC, spec ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))))""",
     "lreq", "jac", "hist")
part("fuzz_out", """
SELECT query, form_code, customer_key, 'fuzzy_description' AS match_level, rank, spec AS value, round_even(rs / top, 4) AS score, count AS support, confidence_score, confidence, inferred_spec FROM fuzz WHERE rank <= 50""", "fuzz")


@query("fuzzy_rank", sql("SELECT * FROM fuzz_out", "fuzz_out"))
def fuzzy_rank(spark, d):
    rows = stored(spark, d)
    asked = cut_lineage(_unseen(rows, "by1", customer=True).select(*K.KEY))
    return _legacy_rows(Z.fuzzy_answers(asked, cut_lineage(H.spec_records(past(rows))),
                                        H.spec_record_customers(past(rows))))


@query("infer_spec", sql("""
SELECT h.row_id AS request_id, o.match_level, o.confidence, o.confidence_score, o.inferred_spec FROM hold h JOIN (
  SELECT * FROM legacy_out WHERE rank = 1 UNION ALL SELECT query, form_code, customer_key, match_level, rank, value, score, support, confidence_score, confidence, inferred_spec FROM fuzz_out WHERE rank = 1
    AND (query, form_code, customer_key) NOT IN (SELECT (query, form_code, customer_key) FROM legacy_out)) o
ON o.query = h.raw_description AND o.form_code = h.by1 AND o.customer_key = h.customer_key""", "hold", "legacy_out", "fuzz_out"))
def infer_spec(spark, d):
    rows = stored(spark, d)
    named = order_history(spark, d).select("row_id", "customer")
    asked = cut_lineage(later(rows).join(named, "row_id").select(
        F.col("row_id").alias("request_id"), F.col("raw_description").alias("query"), "customer",
        F.col("by1").alias("form_code")))
    answers = J.infer_specification(asked, J.build_spec_index(rows, VALIDATION_BEFORE),
                                    J.build_spec_rules(rows)["rules"])
    return answers.select("request_id", "match_level", "confidence", "confidence_score",
                          blank(F.col("inferred_spec")).alias("inferred_spec"))


@query("recommend_exact", sql(f"""
SELECT h.row_id AS request_id, coalesce(b.lv, 'none') AS by1_match_level, coalesce(b.v, '') AS by1_first, coalesce(b.support, 0)::BIGINT AS by1_support FROM hold h LEFT JOIN (
  SELECT query, form_code, any_value({_NAME}) AS lv, min_by(value, rank) AS v, max(total) AS support FROM by1_hit GROUP BY ALL) b ON b.query = h.raw_description AND b.form_code = h.form_code""",
    "hold", "by1_hit"))
def recommend_exact(spark, d):
    rows = stored(spark, d)
    index = J.build_recommendation_index(rows, VALIDATION_BEFORE)
    r = J.recommend(requests(rows), index)
    return in_slices(r.select(
        "request_id", "by1_match_level", blank(F.col("by1_candidates")[0]["value"])
        .alias("by1_first"), "by1_support"), ["request_id"], most=4)


_ = PARTS
