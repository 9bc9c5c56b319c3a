"""Queries over asset builds, samples, products, published tables, evaluation and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.codes import NAMESPACE_DNS
from ..functions.standardize import with_segments
from ..functions.vectors import hashed_vector
from ..operators import cascade as K
from ..operators import design as DS
from ..operators import evaluate as E
from ..operators import evidence as EV
from ..operators import history as H
from ..operators import products as P
from ..operators import publish as U
from ..operators import sampling as S
from ..operators import templates as TP
from ..operators import vectors as V
from ..plans import jobs as J
from ..plans.scale import cut_lineage, in_slices, shared_folder, write_parts
from ..sources.orders import VALIDATION_BEFORE, order_history, read_table
from ..streaming import jobs as ST
from . import vector_queries  # noqa: F401  (its SQL parts are used here)
from .history_queries import ASKED
from .inputs import keys, later, needed, new_folder, past, requests, stored
from .oracle_parts import finish_sql, norm, part, sql
from .registry import ORACLES, query
from .text_queries import _uuid5

TRAIN_UNTIL, VALIDATION_UNTIL = "1998-12-31", "2000-06-30"
FIELDS = ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}"
                   for f in DS.ATTRIBUTE_FIELDS)

part("dkey", "SELECT DISTINCT raw_description AS raw, by1, form_code FROM prep", "prep")
part("fattr", """
SELECT k.raw, k.by1, k.form_code, a.field, a.value, 0 AS inferred FROM dkey k JOIN dattr a ON a.raw = k.raw AND a.by1 = k.by1
UNION ALL SELECT k.raw, k.by1, k.form_code, r.field, r.value, 1 FROM dkey k JOIN dfam f ON f.raw = k.raw AND f.by1 = k.by1 AND f.role = 'valve'
  JOIN arules r ON r.by1 = k.by1 AND r.form_code IN ('', k.form_code)
  WHERE NOT EXISTS (FROM dattr a WHERE a.raw = k.raw AND a.by1 = k.by1 AND a.field = r.field)
    AND NOT (r.form_code = '' AND k.form_code <> '' AND EXISTS (FROM arules s WHERE s.by1 = k.by1 AND s.form_code = k.form_code AND s.field = r.field))""",
     "dkey", "dattr", "dfam", "arules")
part("fwide", f"""
SELECT raw, by1, form_code, {FIELDS}, string_agg(field || '=' || value, '|' ORDER BY field) FILTER (field <> 'size') AS sig,
  coalesce(string_agg(field, ',' ORDER BY field) FILTER (inferred = 1), '') AS inferred_fields, count(*) FILTER (inferred = 1) AS ni FROM fattr GROUP BY ALL""", "fattr")
part("dfinal", finish_sql("(SELECT k.raw, k.by1, k.form_code, f.role, f.fam, coalesce(w.ni, 0) AS ni, coalesce(w.inferred_fields, '') AS inferred_fields, w.* EXCLUDE (raw, by1, form_code, ni, inferred_fields) FROM dkey k JOIN dfam f ON f.raw = k.raw AND f.by1 = k.by1 LEFT JOIN fwide w ON w.raw = k.raw AND w.by1 = k.by1 AND w.form_code = k.form_code)", "ni"), "dkey", "dfam", "fwide")
part("dorders", "SELECT p.row_id, p.date, p.raw_description, p.code_status, d.* EXCLUDE (raw, by1, form_code), p.by1, p.form_code FROM prep p JOIN dfinal d ON d.raw = p.raw_description AND d.by1 = p.by1 AND d.form_code = p.form_code", "prep", "dfinal")


# Columns of the order rows that designs read, and those of the designed orders that samples do.
DESIGNED = ["row_id", "date", "code_status", *DS.DESIGN_KEY]
SAMPLED = ["row_id", "status", "valve_family", "product_role"]
REVIEWED = [*SAMPLED, *DS.DESIGN_KEY, "template_id", "attributes", "inferred_fields",
            "standardized_description", "confidence"]
ROLLED = ["row_id", "date", *DS.DESIGN_KEY, "valve_family", "template_id", "attributes",
          "standardized_description"]
RETRIEVED = ["row_id", "date", *DS.DESIGN_KEY, "valve_family", "template_id", "values",
             "standardized_description"]


def _assets(spark, d):
    return DS.build_assets(needed(spark, d, *DESIGNED), TRAIN_UNTIL, VALIDATION_UNTIL)


def _orders(spark, d, columns, use=lambda orders: orders):
    """Some columns of the designed orders, cut slice by slice; use is done on the way."""
    return cut_lineage(use(_assets(spark, d)["orders"]).select(*columns), ["row_id"], most=4)


@query("designed_orders", sql("""
SELECT row_id, coalesce(fam, '') AS valve_family, role AS product_role, coalesce(template_id, '') AS template_id, coalesce(standardized_description, '') AS standardized_description, inferred_fields,
  score AS confidence_score, concat_ws(';', nullif(warnings, ''), CASE WHEN code_status <> 'ok' THEN 'product_code_' || code_status END) AS warnings, status FROM dorders""", "dorders"))
def designed_orders(spark, d):
    return _assets(spark, d)["orders"].select(
        "row_id", T.blank(F.col("valve_family")).alias("valve_family"), "product_role",
        T.blank(F.col("template_id")).alias("template_id"),
        T.blank(F.col("standardized_description")).alias("standardized_description"),
        "inferred_fields", "confidence_score", "warnings", "status")


@query("design_templates", sql("""
SELECT t.*, e.examples, r.standardized_description FROM (SELECT template_id, any_value(fam) AS valve_family, string_agg(DISTINCT by1, '|' ORDER BY by1) AS supported_by1, coalesce(string_agg(DISTINCT form_code, '|' ORDER BY form_code) FILTER (form_code <> ''), '') AS form_codes,
  count(*) AS support, strftime(min(date), '%Y-%m-%d') AS date_min, strftime(max(date), '%Y-%m-%d') AS date_max FROM dorders WHERE template_id IS NOT NULL GROUP BY 1) t
JOIN (SELECT template_id, string_agg(raw_description, '|' ORDER BY date, row_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY date, row_id) AS n FROM dorders WHERE template_id IS NOT NULL) WHERE n <= 3 GROUP BY 1) e USING (template_id)
JOIN (SELECT template_id, min_by(standardized_description, (date, row_id)) AS standardized_description FROM dorders WHERE template_id IS NOT NULL GROUP BY 1) r USING (template_id)""", "dorders"))
def design_templates(spark, d):
    t = DS.template_rollup(_orders(spark, d, ROLLED))
    return t.select("template_id", "valve_family", F.array_join("supported_by1", "|").alias(
        "supported_by1"), F.array_join("form_codes", "|").alias("form_codes"), "support",
        *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("date_min", "date_max")],
        F.array_join("examples", "|").alias("examples"), "standardized_description")


@query("template_semantics", sql("""
SELECT template_id, any_value(fam) || ' | ' || any_value(replace(replace(sig, '=', ': '), '|', ' | ')) AS semantic_text FROM dorders WHERE template_id IS NOT NULL GROUP BY 1""", "dorders"))
def template_semantics(spark, d):
    return DS.template_rollup(_orders(spark, d, ROLLED)).select("template_id", "semantic_text")


@query("templates_per_family", sql("SELECT fam AS valve_family, count(DISTINCT template_id) AS templates FROM dorders WHERE template_id IS NOT NULL GROUP BY 1", "dorders"))
def templates_per_family(spark, d):
    return DS.templates_per_family(DS.template_rollup(_orders(spark, d, ROLLED)))


@query("build_counts", sql("""
SELECT dimension, value, count(*) AS rows FROM (SELECT unnest([{'dimension': 'rows', 'value': 'all'}, {'dimension': 'family', 'value': coalesce(fam, 'other')}, {'dimension': 'role', 'value': role}, {'dimension': 'status', 'value': status}], recursive := true) FROM dorders) GROUP BY ALL""", "dorders"))
def build_counts(spark, d):
    return DS.build_counts(_assets(spark, d)["orders"])


@query("pending_review", sql("SELECT raw_description AS description, count(*) AS support FROM dorders WHERE status = 'partial' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500", "dorders"))
def pending_review(spark, d):
    return DS.pending_review(_assets(spark, d)["orders"])


part("sample", "SELECT * FROM (SELECT *, coalesce(fam, role) AS stratum, row_number() OVER (PARTITION BY coalesce(fam, role) ORDER BY md5(row_id || '|104729'), row_id) AS sr FROM dorders) WHERE sr <= 500", "dorders")
part("gold", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY CASE WHEN stratum <> 'other' AND status <> 'partial' THEN 1 ELSE 0 END, row_id) AS gr FROM sample) WHERE gr <= CASE WHEN stratum IN ('butterfly', 'check', 'gate') THEN 150 ELSE 75 END", "sample")


@query("stratified_sample", sql("SELECT row_id, stratum, sr AS sample_rank FROM sample", "sample"))
def stratified_sample(spark, d):
    return S.stratified_sample(_orders(spark, d, SAMPLED)).select(
        "row_id", "stratum", F.col("sample_rank").cast("bigint").alias("sample_rank"))


@query("gold_selection", sql("SELECT row_id, stratum AS bucket, gr AS gold_rank FROM gold", "gold"))
def gold_selection(spark, d):
    return S.select_gold(S.stratified_sample(_orders(spark, d, SAMPLED))).select(
        "row_id", "bucket", F.col("gold_rank").cast("bigint").alias("gold_rank"))


def _review(spark, d):
    """Reviewed gold rows: approvals and corrections follow from the row id."""
    gold = cut_lineage(S.gold_review_rows(S.select_gold(S.stratified_sample(
        _orders(spark, d, REVIEWED)))))
    last = F.right("row_id", F.lit(1))
    return gold.withColumns({
        "approved": F.when(last.isin("1", "2"), "通过").when(last == "3", "no").when(
            last == "4", "").otherwise("Yes"),
        "corrected_family": F.when(last == "5", "gate").otherwise(""),
        "corrected_pressure": F.when(last == "6", "PN25").otherwise(""),
        "corrected_closure_material": F.when(last == "7", "CARBON STEEL").otherwise(""),
        "corrected_template_id": F.when(last == "8", "GAT-1").otherwise(""),
        "alternative_template_ids": F.when(last == "8", "X, GAT-1").otherwise("")})


_CRIT = ["body_material", "seat_material", "closure_material", "pressure", "standard_certification", "size"]
_FIX = {"pressure": "CASE WHEN c = '6' THEN 'PN25' ELSE coalesce(pressure, '') END",
        "closure_material": "CASE WHEN c = '7' THEN 'CARBON STEEL' ELSE coalesce(closure_material, '') END"}
_SAID = ", ".join(f"{{'f': '{f}', 'said': coalesce({f}, ''), 'truth': {_FIX.get(f, f'coalesce({f}, {chr(39)*2})')}}}" for f in DS.ATTRIBUTE_FIELDS)
_CL = ", ".join(f"'{f}'" for f in _CRIT)


@query("eval_gold", sql(f"""
SELECT reviewed_rows, round_even(a / reviewed_rows, 4) AS description_approval_rate, round_even(fr / reviewed_rows, 4) AS family_accuracy, round_even(pr / pt, 4) AS target_valve_precision,
  critical_field_evidence, round_even(cr / critical_field_evidence, 4) AS critical_field_accuracy, autofill_evidence, coalesce(round_even(ar / nullif(autofill_evidence, 0), 4), 0) AS autofill_accuracy,
  template_evidence, round_even(t1 / template_evidence, 4) AS template_top1, round_even(t3 / template_evidence, 4) AS template_top3, reviewed_rows >= 600 AS gate_review_complete, round_even(a / reviewed_rows, 4) >= 0.98 AS gate_description_approval_rate FROM (
  SELECT count(*) AS reviewed_rows, count(*) FILTER (c <> '3') AS a, count(*) FILTER (c <> '5' OR fam = 'gate') AS fr, count(*) FILTER (role = 'valve') AS pt, count(*) FILTER (role = 'valve') AS pr,
    sum(len(list_filter(fs, lambda x: x.f IN ({_CL}) AND (x.said <> '' OR x.truth <> '')))) AS critical_field_evidence, sum(len(list_filter(fs, lambda x: x.f IN ({_CL}) AND (x.said <> '' OR x.truth <> '') AND x.said = x.truth))) AS cr,
    sum(len(list_filter(fs, lambda x: list_contains(inf, x.f)))) AS autofill_evidence, sum(len(list_filter(fs, lambda x: list_contains(inf, x.f) AND x.said = x.truth))) AS ar,
    count(*) FILTER (template_id IS NOT NULL OR c = '8') AS template_evidence, count(*) FILTER (template_id IS NOT NULL AND c <> '8') AS t1, count(*) FILTER (template_id IS NOT NULL OR c = '8') AS t3
  FROM (SELECT *, right(row_id, 1) AS c, string_split(inferred_fields, ',') AS inf, [{_SAID}] AS fs FROM (SELECT *, right(row_id, 1) AS c FROM gold)) WHERE c <> '4')""", "gold"))
def eval_gold(spark, d):
    return E.gold_metrics(_review(spark, d)).select(
        "reviewed_rows", "description_approval_rate", "family_accuracy", "target_valve_precision",
        "critical_field_evidence", "critical_field_accuracy", "autofill_evidence",
        "autofill_accuracy", "template_evidence", "template_top1", "template_top3",
        "gate_review_complete", "gate_description_approval_rate")


_GATES = {"critical_field_accuracy": 0.99, "autofill_accuracy": 0.99,
          "description_approval_rate": 0.98, "template_top1": 0.95, "template_top3": 0.99}


@query("eval_gold_gates", sql(f"""
SELECT r.role_accuracy, r.target_valve_precision, reviewed_rows >= 600 AS gate_review_complete, r.target_valve_precision >= 0.995 AS gate_target_valve_precision,
  {', '.join(f'g.{n} >= {v} AS gate_{n}' for n, v in _GATES.items())}
FROM ({ORACLES["eval_gold"][ORACLES["eval_gold"].index("SELECT reviewed_rows"):]}) g,
  (SELECT round_even(count(*) FILTER (c <> '9' OR role = 'accessory') / count(*), 4) AS role_accuracy,
     round_even(count(*) FILTER (role = 'valve' AND c <> '9') / count(*) FILTER (role = 'valve'), 4) AS target_valve_precision
   FROM (SELECT *, right(row_id, 1) AS c FROM gold) WHERE c <> '4') r""", "gold"))
def eval_gold_gates(spark, d):
    """All gates and the role accuracy; rows whose id ends in 9 are corrected to accessories."""
    review = _review(spark, d).withColumn("corrected_role", F.when(
        F.right("row_id", F.lit(1)) == "9", "accessory").otherwise(""))
    metrics = E.gold_metrics(review)
    gates = [c for c in metrics.columns if c.startswith("gate_")]
    return metrics.select("role_accuracy", "target_valve_precision", *gates)


@query("review_answers", """
SELECT conv_id, turn, CASE WHEN a IN ('yes', '是', 'y') THEN 'yes' WHEN a IN ('no', '不通过', 'off') AND a <> 'off' THEN 'no' ELSE 'open' END AS answer, CASE WHEN role = 'user' THEN role ELSE 'corrected' END AS truth FROM (
  SELECT conv_id, turn, role, (['yes', '是', 'no', '不通过', 'off', ''])[(conv_id + turn) % 6 + 1] AS a FROM conversations)""")
def review_answers(spark, d):
    words = F.array(*map(F.lit, ["Yes", " 是 ", "NO", "不通过", "off", ""]))
    c = read_table(spark, d, "conversations")
    a = T.approval(F.get(words, ((F.col("conv_id") + F.col("turn")) % 6).cast("int")))
    fixed = F.when(F.col("role") == "user", "").otherwise(" corrected ")
    return c.select("conv_id", "turn", F.when(a, "yes").when(~a, "no").otherwise("open").alias(
        "answer"), T.corrected_or(fixed, F.col("role")).alias("truth"))


# Recommendation holdout: exact history and rules, without customers.
part("rec_spec", """
SELECT query, form_code, CASE WHEN conf <> 'low' THEN v END AS inferred_spec, lv, conf FROM (
  SELECT query, form_code, v, lv, CASE WHEN lv = 'rule' THEN 'high' WHEN round_even(n / total, 4) >= 0.85 AND n >= 2 THEN 'high' WHEN round_even(n / total, 4) >= 0.60 THEN 'medium' ELSE 'low' END AS conf FROM (
    SELECT r.query, r.form_code, coalesce(f.value, u.value, x.value) AS v, CASE WHEN f.value IS NOT NULL THEN 'description_form_code' WHEN u.value IS NOT NULL THEN 'rule' WHEN x.value IS NOT NULL THEN 'description' END AS lv,
      coalesce(f.n, u.n, x.n) AS n, coalesce(f.total, u.n, x.total) AS total
    FROM req r LEFT JOIN rk_spec f ON f.level = 'description_form' AND f.description = r.description AND f.form_code = r.form_code AND f.rank = 1
      LEFT JOIN rule_rank u ON u.query = r.query AND u.form_code = r.form_code LEFT JOIN rk_spec x ON x.level = 'description' AND x.description = r.description AND x.rank = 1) WHERE lv IS NOT NULL)""",
     "req", "rk_spec", "rule_rank")
part("judged", """
SELECT h.row_id, h.date, h.order_no, h.raw_code, h.raw_description, h.form_code, h.by1, h.spec, b.lv AS by1_level, coalesce(b.cands, []) AS cands, s.inferred_spec, s.lv AS spec_level, s.conf,
  row_number() OVER (PARTITION BY h.date, h.raw_code, h.raw_description ORDER BY row_id) = 1 AS first_
FROM hold h LEFT JOIN (SELECT query, form_code, any_value(level) AS lv, list(value ORDER BY rank) AS cands FROM by1_hit WHERE rank <= 5 GROUP BY ALL) b ON b.query = h.raw_description AND b.form_code = h.form_code
 LEFT JOIN rec_spec s ON s.query = h.raw_description AND s.form_code = h.form_code""", "hold", "by1_hit", "rec_spec")


def _recommended(spark, d, *columns):
    rows = stored(spark, d)
    index = J.build_recommendation_index(rows, VALIDATION_BEFORE)
    answers = J.recommend(requests(rows), index).withColumnRenamed("request_id", "row_id").drop(
        "form_code", "query", "description", "customer_key", "customer", "status")
    return cut_lineage(later(rows).join(answers, "row_id").select(*columns), ["row_id"], most=4)


def _metrics_sql(scope: str, condition: str) -> str:
    return f"""
SELECT '{scope}' AS scope, rows, by1_answered, by1_correct, spec_answered, spec_correct, round_even(by1_answered / rows, 4) AS by1_coverage, round_even(by1_correct / rows, 4) AS by1_overall_accuracy, coalesce(round_even(by1_correct / nullif(by1_answered, 0), 4), 0) AS by1_answered_accuracy,
  round_even(spec_answered / rows, 4) AS spec_coverage, round_even(spec_correct / rows, 4) AS spec_overall_accuracy, coalesce(round_even(spec_correct / nullif(spec_answered, 0), 4), 0) AS spec_answered_accuracy FROM (
  SELECT count(*) AS rows, count(*) FILTER (len(cands) > 0) AS by1_answered, count(*) FILTER (list_contains(cands, by1)) AS by1_correct, count(*) FILTER (inferred_spec IS NOT NULL) AS spec_answered, count(*) FILTER (inferred_spec = spec) AS spec_correct FROM judged WHERE {condition})"""


@query("eval_recommendation", sql(_metrics_sql("row_level", "true") + " UNION ALL " + _metrics_sql("deduplicated", "first_"), "judged"))
def eval_recommendation(spark, d):
    flagged = E.recommendation_flags(_recommended(
        spark, d, "row_id", "date", "raw_code", "raw_description", "by1", "spec", "by1_candidates",
        "inferred_spec")).drop("by1", "spec", "by1_candidates", "inferred_spec")
    unique = E.keep_first(flagged, ["date", "raw_code", "raw_description"])
    return E.recommendation_metrics(flagged, "row_level").unionByName(
        E.recommendation_metrics(unique, "deduplicated"))


@query("eval_levels", sql("""
SELECT target, level, count(*) AS rows FROM (SELECT 'by1' AS target, CASE by1_level WHEN 'description_form' THEN 'description_form_code' ELSE coalesce(by1_level, 'none') END AS level FROM judged
  UNION ALL SELECT 'spec', CASE spec_level WHEN 'rule' THEN 'mature_form_rule' ELSE coalesce(spec_level, 'none') END FROM judged) GROUP BY ALL""", "judged"))
def eval_levels(spark, d):
    return E.level_histogram(_recommended(spark, d, "by1_match_level", "spec_match_level"))


@query("eval_predictions", sql("""
SELECT count(*) FILTER (date < DATE '2000-10-01') AS training_rows, e AS evaluation_rows, count(*) FILTER (date >= DATE '2000-10-01' AND date < DATE '2001-02-01') AS validation_rows, count(*) FILTER (date >= DATE '2001-02-01') AS holdout_rows,
  e AS with_form_code, 0 AS without_form_code, round_even(count(*) FILTER (ev AND cands[1] = by1) / e, 4) AS by1_top1, round_even(count(*) FILTER (ev AND list_contains(cands, by1)) / e, 4) AS by1_top5, round_even(count(*) FILTER (ev AND len(cands) > 0) / e, 4) AS by1_coverage,
  round_even(count(*) FILTER (ev AND inferred_spec = spec) / e, 4) AS spec_top1, round_even(count(*) FILTER (ev AND inferred_spec = spec) / count(*) FILTER (ev AND inferred_spec IS NOT NULL), 4) AS spec_answered_accuracy,
  round_even(count(*) FILTER (ev AND inferred_spec = spec AND list_contains(cands, by1)) / e, 4) AS joint_accuracy, round_even(count(*) FILTER (ev AND conf = 'high' AND inferred_spec = spec AND list_contains(cands, by1)) / count(*) FILTER (ev AND conf = 'high'), 4) AS high_confidence_accuracy
FROM (SELECT *, date >= DATE '2000-10-01' AS ev, (SELECT count(*) FROM judged WHERE date >= DATE '2000-10-01') AS e FROM judged) GROUP BY e""", "judged"))
def eval_predictions(spark, d):
    judged = _recommended(spark, d, "date", "by1", "spec", "form_code", "by1_candidates",
                          "inferred_spec", "spec_confidence").withColumnRenamed(
        "date", "contract_date")
    return E.prediction_metrics(judged, "2000-10-01", "2001-02-01")


# Vector recall: holdout texts against history children on hashed vectors.
part("childs", """
SELECT s.semantic_text AS txt, r.by1, r.form_code, r.description, r.spec, r.n FROM (SELECT description, form_code, by1, spec, count(*) AS n, min_by(raw_description, (date, row_id)) AS ex FROM hist GROUP BY ALL) r JOIN segs s ON s.raw = r.ex""", "hist", "segs")
part("vq", "SELECT DISTINCT s.semantic_text AS txt, h.form_code FROM hold h JOIN segs s ON s.raw = h.raw_description", "hold", "segs")
part("vcos", """
SELECT a, b, round(s / (na * nb), 9) AS score FROM (SELECT x.txt AS a, y.txt AS b, sum(x.c * y.c) AS s FROM (SELECT * FROM slots WHERE txt IN (SELECT txt FROM vq)) x JOIN (SELECT * FROM slots WHERE txt IN (SELECT txt FROM childs)) y USING (slot) GROUP BY ALL)
 JOIN (SELECT txt AS a, sqrt(sum(c * c)) AS na FROM slots GROUP BY txt) USING (a) JOIN (SELECT txt AS b, sqrt(sum(c * c)) AS nb FROM slots GROUP BY txt) USING (b)""", "slots", "vq", "childs")
_CID = _uuid5("6ba7b8119dad11d180b400c04fd430c8", "concat_ws('|', by1, form_code, spec, description)")
part("vhits", f"""
SELECT * FROM (SELECT a, by1, form_code, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, cid) AS rank FROM (SELECT *, {_CID} AS cid FROM childs) c JOIN vcos v ON v.b = c.txt) WHERE rank <= 300""", "childs", "vcos")
part("vrank", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txt, form_code ORDER BY score DESC, by1 DESC) AS rank FROM (
  SELECT q.txt, q.form_code, h.by1, round(0.85 * max(score) + 0.15 * avg(score) FILTER (rn <= 3) + CASE WHEN bool_or(h.form_code = q.form_code) THEN 0.03 ELSE 0 END, 9) AS score
  FROM vq q JOIN (SELECT *, row_number() OVER (PARTITION BY a, by1 ORDER BY rank) AS rn FROM vhits) h ON h.a = q.txt GROUP BY q.txt, q.form_code, h.by1)) WHERE rank <= 50""", "vq", "vhits")


part("missed", "SELECT h.* FROM hold h ANTI JOIN by1_hit b ON b.query = h.raw_description AND b.form_code = h.form_code", "hold", "by1_hit")


def _recall_sql(rows):
    return sql(f"""
SELECT scope, count(*) AS rows, count(*) FILTER (rank <= 5) AS top5, count(rank) AS top50, round_even(count(*) FILTER (rank <= 5) / count(*), 4) AS vector_top5_accuracy, round_even(count(rank) / count(*), 4) AS candidate_recall_at_50 FROM (
  SELECT v.rank, unnest(list_filter(['all_rows', CASE WHEN h.one = 1 THEN 'deduplicated' END, CASE WHEN h.by1 IN (SELECT by1 FROM hist) THEN 'known_label_rows' ELSE 'unknown_label_rows' END], lambda x: x IS NOT NULL)) AS scope
  FROM (SELECT *, row_number() OVER (PARTITION BY order_no, raw_code, raw_description ORDER BY row_id) AS one FROM {rows}) h JOIN segs s ON s.raw = h.raw_description LEFT JOIN vrank v ON v.txt = s.semantic_text AND v.form_code = h.form_code AND v.by1 = h.by1) GROUP BY scope""",
               rows, "hist", "segs", "vrank")


def _cases(rows, misses: bool = False):
    """Holdout rows with a semantic text; misses: only those that exact history cannot answer."""
    cases = later(rows).select("row_id", "order_no", "raw_code", *ASKED)
    if misses:
        found = K.by1_answers(keys(cases), EV.evidence_index(past(rows), "by1")).filter(
            F.size("by1_candidates") > 0).select(F.col("query").alias("raw_description"), "form_code")
        cases = cut_lineage(cases.join(cut_lineage(found.distinct()), [
            "raw_description", "form_code"], "left_anti"), ["row_id"], most=4)
    # Cut before the filter: pushed down, it would parse every text once more.
    semantic = cut_lineage(with_segments(cut_lineage(cases.select("raw_description").distinct()),
                                         "raw_description").select("raw_description", "semantic_text"))
    return cut_lineage(cases.join(semantic, "raw_description").filter(
        F.col("semantic_text") != "").select("row_id", "order_no", "raw_code", "raw_description",
                                             "semantic_text", "form_code", "by1"), ["row_id"], most=4)


def _vector_recall(spark, d, misses: bool = False):
    rows = stored(spark, d)
    children = cut_lineage(J.embedded_children(H.recommendation_records(past(rows))))
    cases = _cases(rows, misses)
    texts = V.with_vectors(cases.select("semantic_text").distinct(), "semantic_text", hashed_vector)
    hits = cut_lineage(V.child_hits(texts.withColumn("request_id", F.col("semantic_text")), children))
    pairs = cases.select("semantic_text", "form_code").distinct().withColumn(
        "pair_id", F.concat_ws("\t", "semantic_text", "form_code"))
    per_pair = hits.withColumnRenamed("request_id", "semantic_text").join(
        pairs.select("semantic_text", "pair_id"), "semantic_text").withColumnRenamed(
        "pair_id", "request_id")
    ranked = V.by1_from_hits(per_pair, pairs.select(F.col("pair_id").alias("request_id"),
                                                    "form_code"), 50, evaluation=True)
    rankings = ranked.join(pairs.withColumnRenamed("pair_id", "request_id"), "request_id")
    return E.vector_recall(cases, rankings, past(rows).select("by1"))


@query("eval_vector_recall", _recall_sql("hold"))
def eval_vector_recall(spark, d):
    return _vector_recall(spark, d)


@query("eval_vector_recall_misses", _recall_sql("missed"))
def eval_vector_recall_misses(spark, d):
    return _vector_recall(spark, d, misses=True)


@query("eval_vector_inputs", sql("""
SELECT count(*) FILTER (by1 IN (SELECT by1 FROM hist)) AS known, count(*) FILTER (by1 NOT IN (SELECT by1 FROM hist)) AS unknown, count(DISTINCT s.semantic_text) AS unique_semantic,
  count(DISTINCT (s.semantic_text, h.form_code)) AS unique_semantic_form_pairs FROM missed h JOIN segs s ON s.raw = h.raw_description WHERE s.semantic_text <> ''""", "missed", "segs", "hist"))
def eval_vector_inputs(spark, d):
    rows = stored(spark, d)
    return E.recall_inputs(_cases(rows, misses=True), past(rows).select("by1"))


# Template retrieval: training templates, weighted holdout cases designed without their variety.
part("rt_train", "SELECT * FROM dorders WHERE role = 'valve' AND date <= DATE '2000-06-30'", "dorders")
part("rt_tpl", f"""
SELECT template_id, any_value(fam) AS fam, any_value(sig) AS sig, min_by(struct_pack({', '.join(f'{f}' for f in DS.ATTRIBUTE_FIELDS)}), (date, row_id)) AS a, count(*) AS support, list(DISTINCT form_code) FILTER (form_code <> '') AS forms FROM rt_train GROUP BY 1""", "rt_train")
part("rt_case", "SELECT raw_description AS query, by1, form_code, template_id, count(*) AS w FROM dorders WHERE role = 'valve' AND date >= DATE '2000-07-01' GROUP BY ALL", "dorders")
_NT = norm("txt")
part("rt_txt", """
SELECT DISTINCT 'q' AS kind, query AS txt FROM rt_case UNION SELECT 't', fam || ' ' || replace(replace(sig, '=', ' '), '|', ' ') FROM rt_tpl""", "rt_case", "rt_tpl")
part("rt_slot", f"""
SELECT kind, txt, slot, count(*)::DOUBLE AS c FROM (SELECT kind, txt, ('0x' || left(md5(token), 6))::INT % 64 AS slot FROM (
  SELECT kind, txt, unnest(list_distinct(string_split({_NT}, ' '))) AS token FROM rt_txt)) GROUP BY ALL""", "rt_txt")
part("rt_norm", "SELECT kind, txt, sqrt(sum(c * c)) AS n FROM rt_slot GROUP BY ALL", "rt_slot")
part("rt_cos", """
SELECT q, t, round(s / (a.n * b.n), 9) AS score FROM (SELECT x.txt AS q, y.txt AS t, sum(x.c * y.c) AS s FROM rt_slot x JOIN rt_slot y ON x.slot = y.slot AND x.kind = 'q' AND y.kind = 't' GROUP BY ALL)
JOIN rt_norm a ON a.kind = 'q' AND a.txt = q JOIN rt_norm b ON b.kind = 't' AND b.txt = t""", "rt_slot", "rt_norm")
_CLASH = " OR ".join(f"(w.{f} IS NOT NULL AND t.a.{f} IS NOT NULL AND w.{f} <> t.a.{f})" for f in DS.ATTRIBUTE_FIELDS if f != "size")
_SAME = " + ".join(f"coalesce((w.{f} = t.a.{f})::INT, 0)" for f in DS.ATTRIBUTE_FIELDS if f != "size")
_ASKED = " + ".join(f"(w.{f} IS NOT NULL)::INT" for f in DS.ATTRIBUTE_FIELDS if f != "size")
part("rt_hit", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, form_code ORDER BY ratio DESC, fits DESC, score DESC, support DESC, template_id) AS rank FROM (
  SELECT p.query, p.form_code, t.template_id, t.support, p.score, coalesce(list_contains(t.forms, p.form_code) AND p.form_code <> '', false) AS fits, round_even(coalesce(({_SAME}) / nullif({_ASKED}, 0), 0), 4) AS ratio
  FROM (SELECT k.query, k.form_code, t.template_id, coalesce(c.score, 0) AS score, row_number() OVER (PARTITION BY k.query, k.form_code ORDER BY coalesce(c.score, 0) DESC, t.template_id) AS vr
    FROM (SELECT DISTINCT query, form_code FROM rt_case) k JOIN (SELECT DISTINCT raw, fam FROM dfam WHERE role = 'valve') f ON f.raw = k.query JOIN rt_tpl t ON t.fam = f.fam
    LEFT JOIN rt_cos c ON c.q = k.query AND c.t = t.fam || ' ' || replace(replace(t.sig, '=', ' '), '|', ' ')) p
  JOIN rt_tpl t USING (template_id) JOIN (SELECT DISTINCT ON (raw) * EXCLUDE (by1) FROM dwide) w ON w.raw = p.query WHERE p.vr <= 100 AND NOT ({_CLASH}))) WHERE rank <= 20""",
     "rt_case", "rt_tpl", "rt_cos", "dwide", "dfam")


def _retrieval(spark, d):
    rows = _orders(spark, d, RETRIEVED, E.retrieval_rows)
    train = rows.filter(F.col("date") <= F.lit("2000-06-30").cast("date"))
    test = rows.filter(F.col("date") >= F.lit("2000-07-01").cast("date"))
    templates = cut_lineage(V.with_vectors(E.retrieval_templates(train), "semantic_text", hashed_vector))
    cases = cut_lineage(E.weighted_cases(test).withColumn(
        "request_id", F.sha1(F.concat_ws("|", "query", "form_code").cast("binary"))))
    asked = cases.select("request_id", F.col("query").alias("raw_description"), F.lit("").alias(
        "by1"), "form_code").distinct()
    designs = DS.design(asked)
    designs = cut_lineage(V.with_vectors(designs, "raw_description", hashed_vector))
    return cases, templates, cut_lineage(TP.retrieve_designs(designs, templates, 20))


@query("retrieve_designs", sql("SELECT query, form_code, template_id, rank, round_even(score, 4) AS score, ratio AS field_match_ratio, fits AS form_match, support FROM rt_hit", "rt_hit"))
def retrieve_designs(spark, d):
    cases, _, hits = _retrieval(spark, d)
    return hits.join(cases.select("request_id", "query", "form_code").distinct(), "request_id").select(
        "query", "form_code", "template_id", F.col("rank").cast("bigint").alias("rank"), "score",
        "field_match_ratio", "form_match", "support")


@query("eval_retrieval", sql("""
SELECT level, "group", sum(w)::BIGINT AS cases, coalesce(sum(w) FILTER (rank <= 20), 0)::BIGINT AS recall_at_20_hits, coalesce(sum(w) FILTER (rank <= 3), 0)::BIGINT AS accuracy_at_3_hits,
  round(coalesce(sum(w) FILTER (rank <= 20), 0) / sum(w), 9) AS recall_at_20, round(coalesce(sum(w) FILTER (rank <= 3), 0) / sum(w), 9) AS accuracy_at_3 FROM (
  SELECT level, w, rank, unnest(['all', CASE WHEN seen THEN 'seen_template' ELSE 'unseen_template' END]) AS "group" FROM (
    SELECT unnest(['row_level', 'deduplicated']) AS level, unnest([k.w, 1]) AS w, h.rank, k.template_id IN (SELECT template_id FROM rt_tpl) AS seen FROM rt_case k LEFT JOIN rt_hit h ON h.query = k.query AND h.form_code = k.form_code AND h.template_id = k.template_id)) GROUP BY level, "group" """, "rt_case", "rt_hit", "rt_tpl"))
def eval_retrieval(spark, d):
    cases, templates, hits = _retrieval(spark, d)
    return E.retrieval_metrics(E.retrieval_results(cases, hits, templates)).withColumns(
        {c: F.round(c, 9) for c in ("recall_at_20", "accuracy_at_3")})


# Products.
part("ptext", "SELECT DISTINCT h.by1, s.semantic_text AS text FROM hist h JOIN segs s ON s.raw = h.raw_description WHERE h.by1 NOT LIKE '%1X'", "hist", "segs")
part("newcode", "SELECT DISTINCT by1 FROM hold UNION SELECT DISTINCT replace(by1, 'X', '0X') FROM hold UNION SELECT 'w' || by1 FROM hold WHERE by1 LIKE 'Q1%'", "hold")
part("pmatch", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY by1 ORDER BY score DESC, match) AS rank FROM (SELECT n.by1, e.by1 AS match,
  len(list_filter(range(1, least(length(n.by1), length(e.by1)) + 1), lambda i: left(upper(n.by1), i) = left(upper(e.by1), i)))::DOUBLE / greatest(length(n.by1), length(e.by1)) AS score, greatest(length(n.by1), length(e.by1)) AS longer
  FROM newcode n JOIN (SELECT DISTINCT by1 FROM ptext) e ON n.by1 <> e.by1) WHERE score > 0) WHERE rank <= 5""", "newcode", "ptext")


SOLD = ["date", "raw_description", "by1", "spec", "form_code"]


def _product_texts(rows):
    t = past(rows).select("raw_description", "by1").filter(~F.col("by1").like("%1X")).distinct()
    semantic = with_segments(t.select("raw_description").distinct(), "raw_description")
    texts = t.join(semantic.select("raw_description", F.col("semantic_text").alias("text")),
                   "raw_description").select("by1", "text").distinct()
    return cut_lineage(texts.withColumn("position", F.lit(0).cast("bigint")))


def _new_codes(rows):
    codes = later(rows).select("by1").distinct()
    return codes.union(codes.select(F.replace("by1", F.lit("X"), F.lit("0X")))).union(
        codes.filter(F.col("by1").like("Q1%")).select(F.concat(F.lit("w"), "by1"))).distinct()


@query("prefix_similarity", sql("SELECT by1, match, round(score, 9) AS score, rank, (score * longer)::BIGINT AS prefix_match_len FROM pmatch", "pmatch"))
def prefix_similarity(spark, d):
    rows = needed(spark, d, *SOLD)
    return P.rank_prefix_matches(_new_codes(rows), _product_texts(rows)).select(
        "by1", "match", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"),
        F.col("prefix_match_len").cast("bigint").alias("prefix_match_len"))


@query("batch_import", sql(f"""
SELECT n.by1, success, source_by1, source_score, edesc_count, CASE WHEN success THEN 'Imported ' || n.by1 || ' from ' || source_by1 WHEN known THEN 'by1=' || n.by1 || ' already exists' ELSE 'No prefix candidates found for ' || n.by1 END AS message,
  CASE WHEN success THEN {_uuid5(NAMESPACE_DNS, 'n.by1')} ELSE '' END AS parent_id FROM (
  SELECT n.by1, n.by1 IN (SELECT by1 FROM ptext) AS known, n.by1 NOT IN (SELECT by1 FROM ptext) AND m.match IS NOT NULL AS success, CASE WHEN n.by1 NOT IN (SELECT by1 FROM ptext) THEN coalesce(m.match, '') ELSE '' END AS source_by1,
    CASE WHEN n.by1 NOT IN (SELECT by1 FROM ptext) THEN coalesce(round_even(m.score, 4), 0) ELSE 0 END AS source_score, CASE WHEN n.by1 NOT IN (SELECT by1 FROM ptext) THEN coalesce(m.n, 0) ELSE 0 END AS edesc_count
  FROM newcode n LEFT JOIN (SELECT by1, max_by(match, (n, -rank)) AS match, max_by(score, (n, -rank)) AS score, max(n) AS n FROM pmatch JOIN (SELECT by1 AS match, count(*) AS n FROM ptext GROUP BY 1) USING (match) GROUP BY by1) m USING (by1)) n""", "newcode", "pmatch", "ptext"))
def batch_import(spark, d):
    rows = needed(spark, d, *SOLD)
    report, _ = P.batch_import(_new_codes(rows), _product_texts(rows))
    return report.select("by1", "success", T.blank(F.col("source_by1")).alias("source_by1"),
                         F.coalesce("source_score", F.lit(0.0)).alias("source_score"),
                         F.coalesce("edesc_count", F.lit(0)).alias("edesc_count"), "message",
                         T.blank(F.col("parent_id")).alias("parent_id"))


part("aseq", "SELECT row_number() OVER (ORDER BY row_id) AS seq, h.by1, s.standardized AS text FROM hold h JOIN segs s ON s.raw = h.raw_description", "hold", "segs")
part("astart", "SELECT DISTINCT h.by1, s.standardized AS text FROM hist h JOIN segs s ON s.raw = h.raw_description WHERE h.by1 NOT LIKE '%1X'", "hist", "segs")
part("appended", """
SELECT seq, by1, text AS standardized, success, CASE WHEN NOT success THEN 'duplicate' WHEN old = 0 THEN 'created' ELSE 'appended' END AS action, old AS old_edesc_count, old + success::INT AS new_edesc_count FROM (
  SELECT *, coalesce(n, 0) + coalesce(sum(success::INT) OVER (PARTITION BY by1 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS old FROM (
    SELECT a.*, c.n, (by1, text) NOT IN (SELECT (by1, text) FROM astart) AND row_number() OVER (PARTITION BY by1, text ORDER BY seq) = 1 AS success FROM aseq a LEFT JOIN (SELECT by1, count(*) AS n FROM astart GROUP BY 1) c USING (by1)))""", "aseq", "astart")
_APP = ["seq", "by1", "standardized", "success", "action", "old_edesc_count", "new_edesc_count"]


def _appends(spark, d):
    from ..plans.scale import ordered_rank
    rows = needed(spark, d, "row_id", *SOLD)
    new = ordered_rank(later(rows).select("row_id", "by1", F.col("raw_description").alias(
        "description"), F.lit(1).alias("one")), ["one"], ["row_id", "by1", "description"], "seq").select(
        "seq", "by1", "description")
    t = past(rows).filter(~F.col("by1").like("%1X")).select("raw_description", "by1").distinct()
    text = with_segments(t.select("raw_description").distinct(), "raw_description")
    start = t.join(text.select("raw_description", F.col("standardized").alias("text")),
                   "raw_description").select("by1", F.lit(0).cast("bigint").alias("position"),
                                             "text").distinct()
    return cut_lineage(new), cut_lineage(start)


@query("append_descriptions", sql("SELECT * FROM appended", "appended"))
def append_descriptions(spark, d):
    report, _ = P.append_descriptions(*_appends(spark, d))
    return report.select(*_APP)


@query("stream_appends", sql("SELECT * FROM appended", "appended"))
def stream_appends(spark, d):
    new, start = _appends(spark, d)
    base = f"{shared_folder(spark)}/append-{uuid.uuid4().hex}"
    cuts = new.approxQuantile("seq", [1 / 3, 2 / 3], 0.01) or [0.0, 0.0]
    for part in (F.col("seq") <= cuts[0], (F.col("seq") > cuts[0]) & (F.col("seq") <= cuts[1]),
                 F.col("seq") > cuts[1]):
        new.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = (spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{base}/in"))
    ST.append_stream(stream, start, f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/store/reports").select(*_APP)


@query("stream_scores", ORACLES["recommend_exact"])
def stream_scores(spark, d):
    rows = stored(spark, d)
    built = J.build_recommendation_index(rows, VALIDATION_BEFORE)
    used = ["by1_evidence", "spec_evidence", "form_rules"]
    base = new_folder(spark, "score")
    J.write_index({name: built[name] for name in used}, f"{base}/index")
    scorer = ST.recommendation_scorer(J.read_index(spark, f"{base}/index", used))
    return _streamed(spark, requests(rows).repartition(2), scorer, base).select(
        "request_id", "by1_match_level", T.blank(F.col("by1_candidates")[0]["value"])
        .alias("by1_first"), "by1_support")


def _streamed(spark, asked, scorer, base):
    """Requests of a folder scored as a stream, one file a batch."""
    write_parts([asked], f"{base}/in")
    stream = (spark.readStream.schema(spark.read.parquet(f"{base}/in").schema)
              .option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    ST.score_requests(stream, scorer, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_specs", ORACLES["infer_spec"])
def stream_specs(spark, d):
    """Specification requests as a stream of three batches over a stored index."""
    rows = stored(spark, d)
    named = order_history(spark, d).select("row_id", "customer")
    asked = later(rows).join(named, "row_id").select(
        F.col("row_id").alias("request_id"), F.col("raw_description").alias("query"), "customer",
        F.col("by1").alias("form_code"))
    base = new_folder(spark, "specs")
    used = ["records", "customers", "evidence"]
    J.write_index(J.build_spec_index(rows, VALIDATION_BEFORE), f"{base}/index")
    scorer = ST.specification_scorer(J.read_index(spark, f"{base}/index", used),
                                     cut_lineage(J.build_spec_rules(rows)["rules"]))
    return _streamed(spark, asked.repartition(3), scorer, base).select(
        "request_id", "match_level", "confidence", "confidence_score",
        T.blank(F.col("inferred_spec")).alias("inferred_spec"))


# Published tables.
part("recs", """
SELECT r.*, s.semantic_text AS semantic FROM (SELECT description, form_code, by1, spec, count(*) AS n, min_by(raw_description, (date, row_id)) AS ex, min(date) AS d0, max(date) AS d1,
  list_sort(list(DISTINCT material)) AS mats, list_sort(list(DISTINCT surface) FILTER (surface <> '')) AS surfs FROM hist GROUP BY description, form_code, by1, spec) r JOIN segs s ON s.raw = r.ex""", "hist", "segs")


def _index(spark, d):
    rows = past(needed(spark, d, "row_id", "date", "raw_description", "parsed_spec", *H.RECORD_KEY,
                       *H.COUNTERS.values()))
    return cut_lineage(H.recommendation_records(rows), H.RECORD_KEY), H.record_counters(rows)


@query("parent_table", sql(f"""
SELECT {_uuid5(NAMESPACE_DNS, "'recommendation:' || by1")} AS parent_id, by1, description_count, support, forms, specs, mats FROM (
  SELECT by1, count(*) AS description_count, sum(n)::BIGINT AS support, coalesce(string_agg(DISTINCT form_code, '|' ORDER BY form_code) FILTER (form_code <> ''), '') AS forms, string_agg(DISTINCT spec, '|' ORDER BY spec) AS specs, array_to_string(list_sort(list_distinct(flatten(list(mats)))), '|') AS mats FROM recs GROUP BY by1)""", "recs"))
def parent_table(spark, d):
    records, counters = _index(spark, d)
    return U.parent_table(records, cut_lineage(counters, H.RECORD_KEY)).select(
        "parent_id", "by1", "description_count", "support",
        F.array_join("form_codes", "|").alias("forms"),
        F.array_join("specifications", "|").alias("specs"), F.array_join("materials", "|").alias("mats"))


@query("child_table", sql(f"""
SELECT {_CID} AS child_id, by1, semantic AS semantic_description, ex AS example, n AS support, array_to_string(mats, '|') AS mats, coalesce(array_to_string(surfs, '|'), '') AS surfs, strftime(d0, '%Y-%m-%d') AS date_min FROM recs""", "recs"))
def child_table(spark, d):
    records, counters = _index(spark, d)
    return U.child_table(records, cut_lineage(counters, H.RECORD_KEY)).select(
        "child_id", "by1", "semantic_description", "example", "support",
        F.array_join("materials", "|").alias("mats"), F.array_join("surfaces", "|").alias("surfs"),
        F.date_format("date_min", "yyyy-MM-dd").alias("date_min"))


@query("child_customers", sql(f"SELECT {_CID} AS child_id, customer_key AS customer_hash FROM (SELECT DISTINCT by1, form_code, spec, description, customer_key FROM hist)", "hist"))
def child_customers(spark, d):
    # Read once, so the counters need no table of their own.
    return in_slices(U.child_customers(*_index(spark, d)), ["customer_hash"])


@query("published_counts", sql("SELECT 'parents' AS \"table\", count(DISTINCT by1) AS points FROM recs UNION ALL SELECT 'children', count(*) FROM recs", "recs"))
def published_counts(spark, d):
    root = f"{shared_folder(spark)}/publish-{uuid.uuid4().hex}"
    records, counters = _index(spark, d)
    counters = cut_lineage(counters, H.RECORD_KEY)
    for name, table in (("parents", U.parent_table(records, counters)),
                        ("children", U.child_table(records, counters))):
        U.publish(table, root, name, "Build 1.0", f"{name}_current")
    return U.table_counts(**{n: U.read_alias(spark, root, f"{n}_current")
                             for n in ("parents", "children")})


# Full recommendation: exact, template, profile branches.
@query("recommend", sql("""
SELECT h.row_id AS request_id, coalesce(b.lv, CASE WHEN t.v IS NOT NULL THEN 'template_retrieval' ELSE 'none' END) AS by1_match_level, coalesce(b.v, t.v, '') AS by1_first,
  coalesce(CASE s.lv WHEN 'rule' THEN 'mature_form_rule' ELSE s.lv END, p.lv, 'none') AS spec_match_level, CASE WHEN s.lv IS NOT NULL THEN coalesce(s.inferred_spec, '') ELSE coalesce(p.v, '') END AS inferred_spec
FROM hold h LEFT JOIN (SELECT query, form_code, any_value(CASE level WHEN 'description_form' THEN 'description_form_code' ELSE level END) AS lv, min_by(value, rank) AS v FROM by1_hit GROUP BY ALL) b ON b.query = h.raw_description AND b.form_code = h.form_code
LEFT JOIN (SELECT raw, form_code, min_by(by1, (-score, -support, by1)) AS v FROM (SELECT raw, form_code, by1, round_even(max(score) + CASE WHEN bool_or(fits) THEN 0.03 ELSE 0 END, 4) AS score, sum(support)::BIGINT AS support FROM thits GROUP BY ALL) GROUP BY ALL) t ON t.raw = h.raw_description AND t.form_code = h.form_code
LEFT JOIN rec_spec s ON s.query = h.raw_description AND s.form_code = h.form_code
LEFT JOIN (SELECT query, form_code, CASE WHEN has_size THEN 'template_form_size' ELSE 'template_profile' END AS lv, CASE WHEN round_even(n / total, 4) >= 0.6 THEN spec END AS v FROM (
  SELECT *, sum(n) OVER (PARTITION BY query, form_code) AS total, row_number() OVER (PARTITION BY query, form_code ORDER BY n DESC, spec) AS rank FROM (
   SELECT query, form_code, spec, count(*) AS n, bool_or(has_size) AS has_size FROM (SELECT h.raw AS query, h.form_code, m.spec, m.size = z.size AS hit, z.size IS NOT NULL AS has_size, bool_or(coalesce(m.size = z.size, false)) OVER (PARTITION BY h.raw, h.form_code, h.tid, m.form_code) AS any_hit
    FROM thits h JOIN tmem m ON m.tid = h.tid AND m.form_code IN ('', h.form_code) JOIN sized z ON z.raw = h.raw WHERE h.score >= 0.6) WHERE NOT any_hit OR hit GROUP BY query, form_code, spec)) WHERE rank = 1 AND total >= 2) p ON p.query = h.raw_description AND p.form_code = h.form_code""",
    "hold", "by1_hit", "thits", "rec_spec", "tmem", "sized"))
def recommend(spark, d):
    rows = stored(spark, d)
    index = J.build_recommendation_index(rows, VALIDATION_BEFORE)
    built = TP.build_templates(cut_lineage(J.template_member_rows(past(rows))))
    r = J.recommend(requests(rows), index, {**built, "templates": cut_lineage(built["templates"])})
    return in_slices(r.select(
        "request_id", "by1_match_level", T.blank(F.col("by1_candidates")[0]["value"])
        .alias("by1_first"), "spec_match_level",
        T.blank(F.col("inferred_spec")).alias("inferred_spec")), ["request_id"], most=4)


_ = (keys, order_history)
