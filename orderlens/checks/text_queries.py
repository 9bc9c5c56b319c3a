"""Queries over text, code and size functions, the standardiser and the description design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import sizes as SZ
from ..functions import standardize as ST
from ..functions import text as T
from ..operators import design as DS
from ..operators import dictionary as DI
from ..sources.orders import code_quarantine, code_status_counts, order_history, read_table
from .inputs import needed, prepared, texts
from .oracle_parts import code, contains, mapping, norm, quote, re, sql
from .registry import query


@query("normalize_text", f"SELECT doc_id, md5({norm('text')}) AS normalized_md5, length({norm('text')}) AS length FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "documents").select(
        "doc_id", T.normalize_text(F.col("text")).alias("n"))
    return n.select("doc_id", F.md5(F.col("n").cast("binary")).alias("normalized_md5"),
                    F.length("n").cast("bigint").alias("length"))


@query("normalize_code", sql(
    f"SELECT row_id, {code('description')} AS code FROM order_history", "order_history"))
def normalize_code(spark, d):
    return order_history(spark, d).select("row_id", T.normalize_code(F.col("description"))
                                          .alias("code"))


@query("customer_fingerprint",
       f"SELECT c_custkey, sha256({norm('c_name')}) AS fingerprint FROM customer")
def customer_fingerprint(spark, d):
    return read_table(spark, d, "customer").select(
        "c_custkey", T.fingerprint(F.col("c_name")).alias("fingerprint"))


@query("tokens", f"""
SELECT token, count(*) AS documents FROM (
  SELECT unnest(list_distinct(list_filter(string_split({norm('text')}, ' '), lambda x: x <> ''))) AS token FROM documents) GROUP BY token""")
def tokens(spark, d):
    t = read_table(spark, d, "documents").select(F.explode(T.token_set(
        T.normalize_text(F.col("text")))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


@query("split_context", sql(r"""
SELECT row_id, CASE WHEN joined THEN trim(coalesce(p[2], '')) ELSE trim(q) END AS query,
  CASE WHEN given <> '' THEN given WHEN joined THEN trim(coalesce(p[1], '')) ELSE '' END AS customer,
  CASE WHEN joined THEN trim(coalesce(p[3], '')) ELSE '' END AS form_code
FROM (SELECT *, contains(upper(q), '[SEP]') AS joined, string_split_regex(trim(q), '\s*\[[Ss][Ee][Pp]\]\s*') AS p FROM (
  SELECT row_id, CASE WHEN material IN ('Q10', 'Q11') THEN concat(customer, ' [sep]  ', description, '[SEP] ', by1) WHEN material = 'Q12' THEN concat('[SEP]', description) ELSE concat(' ', description) END AS q,
    CASE WHEN material IN ('Q10', 'Q14') THEN 'Explicit Customer' ELSE '' END AS given FROM order_history))""",
    "order_history"))
def split_context(spark, d):
    m = F.col("material")
    q = (F.when(m.isin("Q10", "Q11"), F.concat("customer", F.lit(" [sep]  "), "description",
                                               F.lit("[SEP] "), "by1"))
         .when(m == "Q12", F.concat(F.lit("[SEP]"), "description"))
         .otherwise(F.concat(F.lit(" "), "description")))
    given = F.when(m.isin("Q10", "Q14"), "Explicit Customer").otherwise("")
    parsed = order_history(spark, d).select("row_id", T.split_context(q, given, F.lit(None))
                                            .alias("c"))
    return parsed.select("row_id", "c.query", "c.customer", "c.form_code")


@query("parse_product_codes", sql("""
SELECT row_id, raw AS raw_code, CASE WHEN found THEN head ELSE '' END AS code_by1, CASE WHEN found THEN prefix ELSE '' END AS business_prefix,
  CASE WHEN found THEN parts[pos] ELSE '' END AS specification, CASE WHEN found AND cut > 0 THEN form ELSE '' END AS form_code,
  CASE WHEN found AND cut > 0 THEN w_mat ELSE '' END AS material, CASE WHEN found AND cut > 0 THEN surface ELSE '' END AS surface, status
FROM pc""", "pc"))
def parse_product_codes(spark, d):
    return order_history(spark, d).select("row_id", C.parse_product_code(
        *map(F.col, ("product_code", "by1", "spec", "material"))).alias("p")).select("row_id", "p.*")


@query("code_quarantine", sql(
    "SELECT row_id, raw_code, code_status FROM prep WHERE code_status <> 'ok'", "prep"))
def quarantine(spark, d):
    return code_quarantine(prepared(spark, d))


@query("code_status", sql("SELECT code_status, count(*) AS rows FROM prep GROUP BY 1", "prep"))
def status_counts(spark, d):
    return code_status_counts(prepared(spark, d))


@query("parse_spec", sql(r"""
SELECT DISTINCT spec, regexp_extract(spec, '^([A-Z]+)', 1) AS prefix, regexp_extract(spec, '(\d+)$', 1) AS size,
  NOT regexp_matches(spec, '^\pL\d+$') AS nonstandard FROM (SELECT spec FROM order_history UNION ALL SELECT concat(form_code, 'S1') FROM prep WHERE form_code <> '' AND false)""",
    "prep"))
def parse_spec(spark, d):
    s = order_history(spark, d).select("spec").distinct()
    return s.select("spec", C.parse_spec(F.col("spec")).alias("p"), C.is_nonstandard_spec(
        F.col("spec")).alias("nonstandard")).select("spec", "p.prefix", "p.size", "nonstandard")


@query("size_candidates", sql(r"""
SELECT DISTINCT raw AS description, unnest(list_concat(regexp_extract_all(raw, '\bDN\s*(\d+)\b', 1), regexp_extract_all(raw, '\b(\d+)\s*MM\b', 1))) AS candidate FROM texts""",
    "texts"))
def size_candidates(spark, d):
    return texts(spark, d).select("description", F.explode(
        SZ.size_candidates(F.col("description"))).alias("candidate"))


@query("infer_size", sql(
    "SELECT raw AS description, coalesce(size, '') AS size, coalesce(rule, '') AS rule, "
    f"coalesce({mapping(SZ.SIZE_RULE_RELIABILITY, 'rule')}, '0')::DOUBLE AS reliability FROM sized",
    "sized"))
def infer_size(spark, d):
    s = texts(spark, d).select("description", SZ.infer_size(F.col("description")).alias("s"))
    return s.select("description", T.blank(F.col("s.size")).alias("size"),
                    T.blank(F.col("s.rule")).alias("rule"),
                    F.coalesce("s.reliability", F.lit(0.0)).alias("reliability"))


@query("preprocess", sql("SELECT raw AS description, t AS clean_text FROM clean", "clean"))
def preprocess(spark, d):
    return texts(spark, d).select("description", ST.preprocess(F.col("description"))
                                  .alias("clean_text"))


_FLAGS = {"has_lug": ["LUG"], "has_wafer": ["WAFER", "WAF ", "WAF."], "has_al_handle":
          ["AL HANDLE", "ALUMINUM"], "has_cs_lever": ["CS LEVER"], "has_normal_close":
          ["NORMAL CLOSE"], "has_new_turbine": ["NEW TURBINE"], "has_jis": ["JIS", "JSI"],
          "has_awwa": ["AWWA"], "has_70g": ["70G"]}
_FEATURES = ["connection", "valve_structure", "seat_material", "seat_name", "actuation",
             "disc_material", "has_signal", "has_signal_weak", "is_lockable", "is_long_neck",
             "is_higher_lever"]


@query("features", sql(
    "SELECT raw AS description, " + ", ".join(_FEATURES) + ", "
    + ", ".join(f"{contains(*w)} AS {n}" for n, w in _FLAGS.items())
    + ", contains(replace(t, ' ', ''), '300PSI') AS has_300psi, "
      r"coalesce(try_cast(regexp_extract(t, 'DN(\d+)', 1) AS BIGINT), -1) AS size_dn FROM feat",
    "feat"))
def features(spark, d):
    f = ST.with_features(texts(spark, d), "description")
    names = [*_FEATURES, *_FLAGS, "has_300psi"]
    return f.select("description", *[F.col(f"features.{n}").alias(n) for n in names],
                    F.coalesce("features.size_dn", F.lit(-1)).alias("size_dn"))


@query("segments", sql(
    "SELECT raw AS description, body, seat, disc, act AS actuation, size, pressure, extra FROM segs",
    "segs"))
def segments(spark, d):
    return ST.with_segments(texts(spark, d), "description").select("description", *ST.SEGMENTS)


@query("size_text", sql("SELECT raw AS description, size FROM segs", "segs"))
def size_text(spark, d):
    return texts(spark, d).select("description", SZ.nominal_size(F.upper("description"))
                                  .alias("size"))


@query("pressure", sql(r"""
SELECT raw AS description, pressure, coalesce('PN' || nullif(regexp_extract(u, '\bPN\s*(\d+)\b', 1), ''), nullif(regexp_extract(u, '\b(\d+)\s*PSI\b', 1), '') || ' PSI', '') AS design_pressure FROM segs""",
    "segs"))
def pressure(spark, d):
    u = F.upper("description")
    return texts(spark, d).select("description", SZ.pressure(u).alias("pressure"),
                                  T.blank(SZ.design_pressure(u)).alias("design_pressure"))


@query("standardize", sql("SELECT raw AS description, standardized FROM segs", "segs"))
def standardize(spark, d):
    return ST.with_segments(texts(spark, d), "description").select("description", "standardized")


@query("semantic_text", sql("SELECT raw AS description, semantic_text FROM segs", "segs"))
def semantic_text(spark, d):
    return ST.with_segments(texts(spark, d), "description").select("description", "semantic_text")


_VIEW_SQL = f"""
SELECT description, field, upper(value) AS value, evidence FROM (
SELECT raw AS description, 'body_material' AS field, v AS value, v AS evidence FROM (SELECT *, CASE WHEN contains(t, 'DUCTILE IRON') THEN 'DI' WHEN contains(t, 'CAST IRON') THEN 'CI' WHEN contains(t, 'CARBON STEEL') THEN 'CS' WHEN contains(t, 'SS316') THEN 'SS316' WHEN contains(t, 'SS304') THEN 'SS304' END AS v FROM segs)
UNION ALL SELECT raw, 'connection', replace(connection, '_', ' '), replace(connection, '_', ' ') FROM segs
UNION ALL SELECT raw, 'seat_material', seat_name, seat FROM segs
UNION ALL SELECT raw, 'closure_material', disc_material, disc FROM segs
UNION ALL SELECT raw, 'actuation', actuation, act FROM segs
UNION ALL SELECT raw, 'pressure', pressure, pressure FROM segs
UNION ALL SELECT raw, 'size', size, size FROM segs
UNION ALL SELECT raw, 'family', f, f FROM (SELECT *, CASE WHEN {re(r'\b(?:BFV|BUTTERFLY)\b')} THEN 'butterfly' WHEN {re(r'\b(?:CHECK|NRV)\b')} THEN 'check' WHEN {re(r'\b(?:GATE|GV)\b')} THEN 'gate' END AS f FROM segs))
WHERE coalesce(value, '') <> '' AND upper(value) NOT IN ('UNKNOWN', 'NONE', 'NAN')"""


@query("views", sql(_VIEW_SQL, "segs"))
def views(spark, d):
    v = ST.with_views(texts(spark, d), "description")
    return v.select("description", F.explode(F.map_entries("attributes")).alias("e")).select(
        "description", F.col("e.key").alias("field"), F.col("e.value.value").alias("value"),
        F.col("e.value.evidence").alias("evidence"))


_M = f"[{C.BODY_MATERIAL_CODES}]"
_TYPES = "|".join([*C.TYPE_TWO, *C.TYPE_ONE])


@query("model_decode", sql(f"""
SELECT model, coalesce({mapping({**C.TYPE_ONE, **C.TYPE_TWO}, 'kind')}, '') AS type,
  coalesce(CASE WHEN driven THEN {mapping(C.ACTUATION, 'left(core, 1)')} WHEN regexp_matches(core, '^[0-9][0-9]') AND kind NOT IN ('A', 'R', 'Y', 'S') THEN '手动驱动' END, '') AS drive_mode,
  coalesce({mapping(C.CONNECTION, 'left(rest, 1)')}, '') AS connect_mode,
  coalesce(CASE WHEN kind IN ('Z', 'XZ') THEN {mapping(C.STRUCTURE['Z'], 'sd')} WHEN kind IN ('D', 'XD') THEN {mapping(C.STRUCTURE['D'], 'sd')} WHEN kind IN ('H', 'DH') THEN {mapping(C.STRUCTURE['H'], 'sd')} END, '') AS form,
  coalesce({mapping(C.SEAL, 'right(std, 1)')}, '') AS material, kind || std AS standard_product, 'ok' AS status
FROM (SELECT *, regexp_extract(rest, '^.([0-9])', 1) AS sd FROM (SELECT *, CASE WHEN driven THEN substr(core, 2) ELSE core END AS rest FROM (
  SELECT *, left(std, length(std) - 1) AS core, kind NOT IN ('A', 'R', 'Y', 'S') AND regexp_matches(left(std, length(std) - 1), '^[0-9][0-9][0-9]') AS driven FROM (
    SELECT model, kind, coalesce(nullif(regexp_extract(body, '^(.*?[0-9]{_M})', 1), ''), regexp_extract(body, '^(.*{_M})', 1)) AS std FROM (
      SELECT model, kind, substr(base, length(kind) + 1) AS body FROM (
        SELECT model, base, regexp_extract(base, '^({_TYPES})', 1) AS kind FROM (
          SELECT model, CASE WHEN regexp_matches(model, '^({_TYPES})') THEN model ELSE substr(model, 2) END AS base FROM (
            SELECT DISTINCT concat(by1, substr(material, 3)) AS model FROM order_history UNION SELECT DISTINCT concat('B', by1) FROM order_history))))))))""",
    "order_history"))
def model_decode(spark, d):
    h = order_history(spark, d)
    models = h.select(F.concat("by1", F.substring("material", 3, 9)).alias("model")).union(
        h.select(F.concat(F.lit("B"), "by1"))).distinct()
    p = models.select("model", C.decode_model(F.col("model")).alias("p"))
    return p.select("model", *[T.blank(F.col(f"p.{a}")).alias(b) for a, b in (
        ("type", "type"), ("driveMode", "drive_mode"), ("connectMode", "connect_mode"),
        ("form", "form"), ("material", "material"), ("standardizedProduct", "standard_product"),
        ("status", "status"))])


def _uuid5(ns: str, name: str) -> str:
    h = f"sha1(unhex('{ns}') || encode({name}))"
    return (f"(SELECT left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || "
            f"lower(printf('%x', ((('0x' || substr(h, 17, 2))::INT & 63) | 128))) || substr(h, 19, 2) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))")


@query("stable_ids", sql(f"""
SELECT by1, form_code, spec, description, {_uuid5(C.NAMESPACE_DNS, "'recommendation:' || by1")} AS parent_id,
  {_uuid5(C.NAMESPACE_DNS, "by1 || '_' || left(description, 50)")} AS text_parent_id,
  {_uuid5(C.NAMESPACE_URL, "concat_ws('|', by1, form_code, spec, description)")} AS record_id,
  {_uuid5(C.NAMESPACE_DNS, "description || '_chunk_3'")} AS child_id,
  'tpl-' || upper(left(sha1(by1 || '|' || description || '|7'), 12)) AS template_id,
  {_uuid5(C.NAMESPACE_URL, "'edesc-template:' || by1")} AS point_id
FROM (SELECT DISTINCT by1, form_code, spec, description FROM prep)""", "prep"))
def stable_ids(spark, d):
    r = prepared(spark, d).select("by1", "form_code", "spec", "description").distinct()
    by1, text = F.col("by1"), F.col("description")
    return r.select(
        "*", C.parent_id(F.concat(F.lit("recommendation:"), by1)).alias("parent_id"),
        C.parent_id(by1, text).alias("text_parent_id"),
        C.record_id(by1, F.col("form_code"), F.col("spec"), text).alias("record_id"),
        C.child_id(text, F.lit(3)).alias("child_id"),
        C.cluster_template_id(by1, text, F.lit(7)).alias("template_id"),
        C.template_point_id(by1).alias("point_id"))


def _design_keys(spark, d):
    return order_history(spark, d).select(
        F.col("description").alias("raw_description"), "by1", F.lit("").alias("form_code")).distinct()


@query("design_role_family", sql(
    "SELECT raw AS description, by1, role, coalesce(fam, '') AS family FROM dfam", "dfam"))
def design_role_family(spark, d):
    return DS.observe(_design_keys(spark, d)).select(
        F.col("raw_description").alias("description"), "by1", F.col("product_role").alias("role"),
        T.blank(F.col("valve_family")).alias("family"))


@query("term_match", sql("SELECT raw AS description, by1, field, value, term FROM matched", "matched"))
def term_match(spark, d):
    o = DS.observe(_design_keys(spark, d)).select(
        F.col("raw_description").alias("description"), "by1", F.explode(
            F.map_entries("attributes")).alias("e"))
    return o.filter(~F.col("e.key").isin("pressure", "size", "special_requirements")).select(
        "description", "by1", F.col("e.key").alias("field"), F.col("e.value.value").alias("value"),
        F.col("e.value.evidence").alias("term"))


@query("term_match_large", sql(
    "SELECT DISTINCT raw AS description, field, value, term FROM matched", "matched"))
def term_match_large(spark, d):
    keys = DS.observe(_design_keys(spark, d)).filter(F.col("product_role") == "valve").select(
        F.col("raw_description").alias("description"), DS.design_text(
            F.col("raw_description")).alias("text"), F.col("valve_family").alias("family")).distinct()
    terms = DI.clean_terms(DI.default_terms(spark))
    return DI.match_terms(keys, terms, ["description"], "text", "family").select(
        "description", "field", "value", "term").distinct()


@query("dictionary_usage", sql("""
SELECT t.field, t.value AS canonical_value, t.scope AS family_scope, count(DISTINCT m.raw) AS descriptions
FROM terms t LEFT JOIN matched m ON m.field = t.field AND m.value = t.value GROUP BY ALL""",
    "terms", "matched"))
def dictionary_usage(spark, d):
    terms = DI.clean_terms(DI.default_terms(spark))
    used = term_match(spark, d).select("field", F.col("value").alias("canonical_value"),
                                       "description").distinct()
    return DI.canonical_values(terms).join(used, ["field", "canonical_value"], "left").groupBy(
        "field", "canonical_value", "family_scope").agg(
        F.count("description").alias("descriptions"))


@query("dictionary_bundle", sql("""
SELECT sheet, count(*) AS cells, min(row_no) AS first_row, max(row_no) AS last_row FROM (
  SELECT 'quarantine' AS sheet, unnest([1, 2]) AS c, rn AS row_no FROM (SELECT row_number() OVER (ORDER BY row_id) - 1 AS rn FROM prep WHERE code_status <> 'ok')) GROUP BY sheet""",
    "prep"))
def dictionary_bundle(spark, d):
    from ..plans.scale import ordered_rank
    # Written first: dealing by range reads its rows twice, and the filter would parse them again.
    rows = needed(spark, d, "row_id", "raw_code", "code_status")
    bad = code_quarantine(rows).withColumn("one", F.lit(1))
    sheet = ordered_rank(bad, ["one"], ["row_id"], "nth").select(
        "raw_code", "code_status", (F.col("nth") - 1).alias("position"))
    rows, _ = DI.compile_bundle({"quarantine": sheet}, "v1")
    return rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("cells"),
                                     F.min("row_no").alias("first_row"),
                                     F.max("row_no").alias("last_row"))


@query("design_render", sql(
    "SELECT raw AS description, by1, status, coalesce(template_id, '') AS template_id, coalesce(standardized_description, '') AS standardized_description FROM dplain",
    "dplain"))
def design_render(spark, d):
    return DS.design(_design_keys(spark, d)).select(
        F.col("raw_description").alias("description"), "by1", "status",
        T.blank(F.col("template_id")).alias("template_id"),
        T.blank(F.col("standardized_description")).alias("standardized_description"))


@query("design_status", sql("""
SELECT raw AS description, by1, status, score AS confidence_score, CASE WHEN score >= 0.95 THEN 'high' WHEN score >= 0.75 THEN 'medium' ELSE 'low' END AS confidence, warnings FROM dplain""",
    "dplain"))
def design_status(spark, d):
    return DS.design(_design_keys(spark, d)).select(
        F.col("raw_description").alias("description"), "by1", "status", "confidence_score",
        "confidence", F.array_join("warnings", ";").alias("warnings"))


@query("safe_dates", sql("""
SELECT row_id, strftime(contract_date, '%Y-%m-%d') AS from_date, strftime(contract_date, '%Y-%m-%d') AS from_text, CASE WHEN material = 'Q10' THEN '' ELSE strftime(contract_date, '%Y-%m-%d') END AS from_mixed FROM order_history""",
    "order_history"))
def safe_dates(spark, d):
    date = F.col("contract_date")
    mixed = F.when(F.col("material") == "Q10", "no date").otherwise(date.cast("string"))
    return order_history(spark, d).select(
        "row_id", T.iso_prefix(T.safe_date(date)).alias("from_date"),
        T.iso_prefix(T.safe_date(F.concat(date.cast("string"), F.lit("T10:00:00"))))
        .alias("from_text"), T.iso_prefix(T.safe_date(mixed)).alias("from_mixed"))


_ = quote
