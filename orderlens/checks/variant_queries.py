"""Queries over the rarer wordings and codes of the order lines: every branch of sizes, pressures,
codes, models, roles, features and mature rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import sizes as SZ
from ..functions import standardize as ST
from ..functions import text as T
from ..operators import cascade as K
from ..operators import design as DS
from ..operators import evidence as EV
from ..operators import rules as R
from ..plans import jobs as J
from ..plans.scale import cut_lineage, in_slices
from ..sources.orders import (ORDER_HISTORY_SQL, ORDER_VARIANTS_SQL, code_quarantine,
                              code_status_counts, load_orders, order_variants, prepare_orders,
                              read_table)
from . import history_queries as HQ
from .inputs import as_lookup, keys, later, needed, past
from .oracle_parts import PARTS, mapping, part, re, sql
from .registry import ORACLES, query

_NUM = r'(\d+\s*[- ]\s*\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)'
_DEC = "DECIMAL(18,8)"


def _inch(text: str) -> str:
    """Decimal inches of ``2 1/2``, ``2-1/2``, ``3/4`` or ``4.5``."""
    flat = rf"trim(regexp_replace({text}, '\s*-\s*', ' '))"
    return (rf"CASE WHEN contains({text}, '/') THEN coalesce(try_cast(nullif(regexp_extract({flat}, '^(\d+) ', 1), '') AS {_DEC}), 0)"
            rf" + regexp_extract({flat}, '(\d+)/', 1)::{_DEC} / regexp_extract({flat}, '/(\d+)', 1)::{_DEC} ELSE {text}::{_DEC} END")


def _numbers(pattern: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all(raw, '{pattern}', 1), lambda x: x::{_DEC}), "
            "lambda x: x > 0 AND x <= 2000)")


_PRODUCT = " ".join(f"WHEN contains(upper(raw), '{name}') AND inch = {i} THEN '{od}'"
                    for name, table in SZ.GROOVED_PRODUCT_OD.items() for i, od in table.items())
_HAS_PRODUCT = " OR ".join(f"contains(upper(raw), '{name}')" for name in SZ.GROOVED_PRODUCT_OD)
_BY_INCH = " ".join(f"WHEN inch = {i} THEN '{od}'" for i, od in SZ.GROOVED_INCH_TO_OD.items())
_OD_OF = mapping(SZ.GROOVED_DN_TO_OD, "x")
part("vsized", rf"""
SELECT raw, nullif(rule, '') AS rule, CASE rule WHEN '' THEN NULL WHEN 'grooved_explicit_mm' THEN mm[-1]::VARCHAR
   WHEN 'grooved_dn_to_od' THEN CASE WHEN suitable THEN list_max(list_transform(dn_od, lambda x: x::INT))::VARCHAR ELSE dn_od[-1] END
   WHEN 'suitable_range_max' THEN coalesce(list_max(mm), list_max(dn))::VARCHAR
   WHEN 'explicit_mm' THEN mm[-1]::VARCHAR WHEN 'dn_size' THEN dn[-1]::VARCHAR ELSE od END AS size
FROM (SELECT *, CASE
    WHEN grooved AND od IS NOT NULL AND abs(mm[-1] - od::INT) <= 3 THEN 'grooved_explicit_mm'
    WHEN grooved AND od IS NOT NULL AND copper THEN 'grooved_cts_inch_to_od'
    WHEN grooved AND od IS NOT NULL AND ({_HAS_PRODUCT}) THEN 'grooved_product_inch_to_od'
    WHEN grooved AND od IS NOT NULL THEN 'grooved_inch_to_od'
    WHEN grooved AND len(mm) = 0 AND len(dn_od) > 0 THEN 'grooved_dn_to_od' WHEN grooved THEN ''
    WHEN suitable AND len(mm) + len(dn) > 0 THEN 'suitable_range_max'
    WHEN len(mm) > 0 THEN 'explicit_mm' WHEN len(dn) > 0 THEN 'dn_size' ELSE '' END AS rule
  FROM (SELECT *, list_filter(list_transform(dn, lambda x: {_OD_OF}), lambda x: x IS NOT NULL) AS dn_od,
      CASE WHEN copper THEN round((inch + 0.125) * 25.4)::INT::VARCHAR {_PRODUCT} {_BY_INCH} END AS od
    FROM (SELECT raw, list_transform({_numbers(r'(?i)\bDN\s*(\d+(?:\.\d+)?)\b')}, lambda x: x::INT) AS dn,
        list_transform({_numbers(r'(?i)\b(\d+(?:\.\d+)?)\s*MM\b')}, lambda x: round(x, 0)::INT) AS mm,
        regexp_matches(raw, '(?i)\b(GROOVED|GROOVE|GRVD|GRV)\b|\bBVG-') AS grooved,
        regexp_matches(raw, '(?i)\bSUIT(ABLE)?\s+FOR\b') AS suitable,
        regexp_matches(raw, '(?i)\b(CTS|COP|COPPER)\b') AS copper,
        coalesce(list_transform(regexp_extract_all(raw, '(?:^|[^\d/]){_NUM}\s*["”″]', 1), lambda y: {_inch('y')})[-1],
          list_transform(regexp_extract_all(raw, '(?i)\b(\d+(?:\.\d+)?)\s+(?:COP|COPPER)\b', 1), lambda y: y::{_DEC})[-1]) AS inch
      FROM texts)))""", "texts")


def variant(statement: str, labelled: bool = False) -> str:
    """A statement over the plain view moved to the variants; labelled: rows with a text only."""
    moved = statement.replace(ORDER_HISTORY_SQL, ORDER_VARIANTS_SQL).replace(
        f"sized AS ({PARTS['sized'][1]})", f"sized AS ({PARTS['vsized'][1]})")
    return moved.replace("FROM prep WHERE ", "FROM prep WHERE description <> '' AND ") if labelled else moved


def _texts(spark, d):
    return order_variants(spark, d).select("description").distinct()


def _prepared(spark, d):
    return prepare_orders(load_orders(order_variants(spark, d)))


@query("variant_sizes", variant(ORACLES["infer_size"]))
def variant_sizes(spark, d):
    s = _texts(spark, d).select("description", SZ.infer_size(F.col("description")).alias("s"))
    return s.select("description", T.blank(F.col("s.size")).alias("size"),
                    T.blank(F.col("s.rule")).alias("rule"),
                    F.coalesce("s.reliability", F.lit(0.0)).alias("reliability"))


def _inch_text(inch: str) -> str:
    whole, rest = f"floor({inch})::BIGINT", f"({inch} - floor({inch}))"
    near = " ".join(f"WHEN abs({rest} - {x}) < 0.01 THEN '{t}'" for x, t in (
        (0.25, "1/4"), (0.5, "1/2"), (0.75, "3/4"), (0.333, "1/3"), (0.667, "2/3")))
    return (f"CASE WHEN {rest} = 0 THEN {whole}::VARCHAR WHEN (CASE {near} END) IS NOT NULL "
            f"THEN concat_ws(' ', CASE WHEN {whole} > 0 THEN {whole}::VARCHAR END, CASE {near} END) "
            f"ELSE printf('%.1f', {inch}) END")


def _plain_inch(text: str) -> str:
    """Inches as the standardiser reads them: ``1 1/2``, ``3/4`` or ``4``."""
    return (rf"CASE WHEN contains({text}, '/') THEN coalesce(try_cast(nullif(regexp_extract({text}, '^(\d+)\s+', 1), '') AS DOUBLE), 0)"
            rf" + regexp_extract({text}, '(\d+)/', 1)::DOUBLE / regexp_extract({text}, '/(\d+)', 1)::DOUBLE ELSE {text}::DOUBLE END")


_N = r"(\d+(?:\s+\d+/\d+)?)"
_TO_DN = " ".join(f"WHEN {i} THEN '{dn}'" for i, dn in SZ.INCH_TO_DN.items())
_TO_INCH = " ".join(f"WHEN '{dn}' THEN {i}" for i, dn in SZ.INCH_TO_DN.items())
_MM_DN = " ".join(f"WHEN {mm} THEN '{dn}'" for mm, dn in SZ.MM_TO_DN.items())


@query("variant_size_text", variant(sql(rf"""
SELECT description, concat_ws('/', {_inch_text('size_inch')} || '"', 'DN' || size_dn) AS size,
  coalesce(nullif(regexp_extract(u, '(\d+)\s*PSI', 1), '') || 'PSI', 'PN' || nullif(regexp_extract(u, '\bPN(\d+)\b', 1), ''), nullif(regexp_extract(u, '(\d+)\s*BAR', 1), '') || 'BAR', '') AS pressure,
  coalesce('PN' || nullif(regexp_extract(u, '\bPN\s*(\d+)\b', 1), ''), nullif(regexp_extract(u, '\b(\d+(?:\.\d+)?)\s*PSI\b', 1), '') || ' PSI', nullif(regexp_extract(u, '\b(\d+(?:\.\d+)?)\s*BAR\b', 1), '') || ' BAR', '') AS design_pressure
FROM (SELECT *, CASE WHEN paired IS NOT NULL THEN {_plain_inch('pair_inch')} WHEN inch IS NOT NULL THEN {_plain_inch('inch')}
      WHEN dn IS NOT NULL THEN CASE dn {_TO_INCH} END WHEN lead IS NOT NULL THEN {_plain_inch('lead')} END AS size_inch,
    CASE WHEN paired IS NOT NULL THEN paired WHEN inch IS NOT NULL THEN CASE {_plain_inch('inch')} {_TO_DN} END
      WHEN dn IS NOT NULL THEN dn WHEN lead IS NOT NULL THEN CASE {_plain_inch('lead')} {_TO_DN} END END AS size_dn
  FROM (SELECT *, coalesce(nullif(pair_dn, '0'), CASE floor(pair_mm)::INT {_MM_DN} ELSE floor(pair_mm)::INT::VARCHAR END) AS paired
    FROM (SELECT raw AS description, upper(raw) AS u,
        replace(regexp_extract(upper(raw), '{_N}\s*"\s*/\s*(?:DN(\d+)|(\d+(?:\.\d+)?)\s*MM)', 1), ' ', '') AS pair_inch,
        nullif(regexp_extract(upper(raw), '{_N}\s*"\s*/\s*(?:DN(\d+)|(\d+(?:\.\d+)?)\s*MM)', 2), '') AS pair_dn,
        nullif(regexp_extract(upper(raw), '{_N}\s*"\s*/\s*(?:DN(\d+)|(\d+(?:\.\d+)?)\s*MM)', 3), '')::DOUBLE AS pair_mm,
        nullif(regexp_extract(upper(raw), '{_N}\s*"', 1), '') AS inch, nullif(regexp_extract(upper(raw), 'DN(\d+)', 1), '') AS dn,
        nullif(regexp_extract(upper(raw), '^{_N}\s', 1), '') AS lead FROM texts)))""", "texts")))
def variant_size_text(spark, d):
    u = F.upper("description")
    return _texts(spark, d).select(
        "description", SZ.nominal_size(u).alias("size"), SZ.pressure(u).alias("pressure"),
        T.blank(SZ.design_pressure(u)).alias("design_pressure"))


@query("variant_codes", variant(ORACLES["parse_product_codes"]))
def variant_codes(spark, d):
    return order_variants(spark, d).select("row_id", C.parse_product_code(
        *map(F.col, ("product_code", "by1", "spec", "material"))).alias("p")).select("row_id", "p.*")


@query("variant_code_status", variant(ORACLES["code_status"]))
def variant_code_status(spark, d):
    return code_status_counts(_prepared(spark, d))


@query("variant_quarantine", variant(ORACLES["code_quarantine"]))
def variant_quarantine(spark, d):
    return code_quarantine(_prepared(spark, d))


@query("variant_specs", variant(sql(r"""
SELECT DISTINCT spec, coalesce(nullif(regexp_extract(spec, '^([A-Z]+)[0-9]+$', 1), ''), '') AS prefix,
  coalesce(nullif(regexp_extract(spec, '^[A-Z]+([0-9]+)$', 1), ''), '') AS size, NOT regexp_matches(spec, '^\pL\d+$') AS nonstandard
FROM order_history""", "order_history")))
def variant_specs(spark, d):
    s = order_variants(spark, d).select("spec").distinct()
    return s.select("spec", C.parse_spec(F.col("spec")).alias("p"), C.is_nonstandard_spec(
        F.col("spec")).alias("nonstandard")).select(
        "spec", T.blank(F.col("p.prefix")).alias("prefix"), T.blank(F.col("p.size")).alias("size"),
        "nonstandard")


# Models of all types, with and without drive, without type, without material, and blank.
_KINDS = [*C.TYPE_TWO, *C.TYPE_ONE, "K", "BZ", "wd"]
_MODEL_SQL = ("SELECT DISTINCT CASE WHEN l_linenumber = 7 AND p_partkey % 9 = 0 THEN '' ELSE concat("
              f"CASE p_partkey % {len(_KINDS)} " + " ".join(
                  f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) +
              " END, CASE WHEN l_linenumber = 6 THEN '-' ELSE '' END, "
              "CASE l_linenumber WHEN 1 THEN '4' ELSE CAST(100 + (p_partkey * 7 + p_size * 3) % 900 AS VARCHAR(4)) END, "
              "CASE l_linenumber WHEN 5 THEN '' ELSE substr('JXFSNHB', CAST(p_size % 7 AS INT) + 1, 1) END, "
              "CASE l_linenumber WHEN 3 THEN '-16' ELSE '' END) END AS model "
              "FROM lineitem JOIN part ON l_partkey = p_partkey")
_M = f"[{C.BODY_MATERIAL_CODES}]"
_TYPES = "|".join([*C.TYPE_TWO, *C.TYPE_ONE])
_BARE = "'" + "', '".join(C.NO_ACTUATION_TYPES) + "'"


@query("variant_models", f"""
SELECT model, status, CASE WHEN ok THEN coalesce({mapping({**C.TYPE_ONE, **C.TYPE_TWO}, 'kind')}, '') ELSE '' END AS type,
  CASE WHEN NOT ok THEN '' ELSE coalesce(CASE WHEN driven THEN {mapping(C.ACTUATION, 'left(core, 1)')} WHEN regexp_matches(core, '^[0-9][0-9]') AND kind NOT IN ({_BARE}) THEN '手动驱动' END, '') END AS drive_mode,
  CASE WHEN NOT ok THEN '' ELSE coalesce({mapping(C.CONNECTION, 'left(rest, 1)')}, '') END AS connect_mode,
  CASE WHEN NOT ok THEN '' ELSE coalesce(CASE WHEN kind IN ('Z', 'XZ') THEN {mapping(C.STRUCTURE['Z'], 'sd')} WHEN kind IN ('D', 'XD') THEN {mapping(C.STRUCTURE['D'], 'sd')} WHEN kind IN ('H', 'DH') THEN {mapping(C.STRUCTURE['H'], 'sd')} END, '') END AS form,
  CASE WHEN ok THEN coalesce({mapping(C.SEAL, 'right(std, 1)')}, '') ELSE '' END AS material,
  CASE WHEN ok THEN kind || std ELSE '' END AS standard_product
FROM (SELECT *, status = 'ok' AS ok, regexp_extract(rest, '^.([0-9])', 1) AS sd FROM (
 SELECT *, CASE WHEN driven THEN substr(core, 2) ELSE core END AS rest,
   CASE WHEN model = '' THEN 'empty' WHEN kind = '' THEN 'unknown_type' WHEN std = '' THEN 'material_not_found' ELSE 'ok' END AS status FROM (
  SELECT *, left(std, greatest(length(std) - 1, 0)) AS core, kind NOT IN ({_BARE}) AND regexp_matches(left(std, greatest(length(std) - 1, 0)), '^[0-9][0-9][0-9]') AS driven FROM (
   SELECT model, kind, coalesce(nullif(regexp_extract(body, '^(.*?[0-9]{_M})', 1), ''), regexp_extract(body, '^(.*{_M})', 1)) AS std FROM (
    SELECT model, kind, substr(base, length(kind) + 1) AS body FROM (
     SELECT model, base, regexp_extract(base, '^({_TYPES})', 1) AS kind FROM (
      SELECT model, CASE WHEN regexp_matches(clean, '^({_TYPES})') THEN clean ELSE substr(clean, 2) END AS base FROM (
       SELECT model, regexp_replace(upper(model), '[^A-Z0-9]+', '', 'g') AS clean FROM ({_MODEL_SQL})))))))))""")
def variant_models(spark, d):
    models = spark.sql(
        _MODEL_SQL.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"),
        lineitem=read_table(spark, d, "lineitem"), part=read_table(spark, d, "part"))
    p = models.select("model", C.decode_model(F.col("model")).alias("p"))
    return p.select("model", *[T.blank(F.col(f"p.{a}")).alias(b) for a, b in (
        ("type", "type"), ("driveMode", "drive_mode"), ("connectMode", "connect_mode"),
        ("form", "form"), ("material", "material"), ("standardizedProduct", "standard_product"),
        ("status", "status"))])


_FLAGS = ["connection", "valve_structure", "seat_material", "seat_name", "actuation",
          "disc_material", "has_signal", "has_signal_weak", "is_lockable", "is_long_neck",
          "is_higher_lever", "has_lug", "has_wafer", "has_al_handle", "has_cs_lever",
          "has_normal_close", "has_new_turbine", "has_jis", "has_awwa", "has_70g", "has_300psi"]


@query("variant_features", variant(ORACLES["features"]))
def variant_features(spark, d):
    f = ST.with_features(_texts(spark, d), "description")
    return f.select("description", *[F.col(f"features.{n}").alias(n) for n in _FLAGS],
                    F.coalesce("features.size_dn", F.lit(-1)).alias("size_dn"))


@query("variant_segments", variant(sql("""
SELECT raw AS description, body, seat, disc, act AS actuation, extra FROM segs""", "segs")))
def variant_segments(spark, d):
    return ST.with_segments(_texts(spark, d), "description").select(
        "description", "body", "seat", "disc", "actuation", "extra")


def _design_keys(spark, d):
    return order_variants(spark, d).select(
        F.col("description").alias("raw_description"), "by1", F.lit("").alias("form_code")).distinct()


_PAIR = r'((?:\d+\s+\d+/\d+|\d+/\d+|\d+))\s*"\s*/\s*(?:DN\s*(\d+)|(\d+(?:\.\d+)?)\s*MM)'
_ODS = mapping(SZ.DESIGN_DN_TO_OD, "{}")
_FLAT = mapping({od: dn for dn, od in SZ.DESIGN_DN_TO_OD.items()}, "pair_od")
_SPECIAL = "concat_ws('; ', " + ", ".join(
    f"CASE WHEN {re(p)} THEN '{v}' END" for p, v in DS.SPECIALS) + ")"


@query("variant_design_parts", variant(sql(rf"""
SELECT description, by1, role, family, status, special, coalesce(CASE WHEN role = 'valve' THEN coalesce(
  "left" || '"/' || CASE WHEN conn = 'GROOVED' THEN {_ODS.format('pair_dn')} END || 'MM', "left" || '"/DN' || pair_dn,
  "left" || '"/DN' || CASE WHEN conn IN ('FLANGED', 'WAFER', 'LUG', 'LUG WAFER') THEN {_FLAT} END, "left" || '"/' || pair_od || 'MM',
  {mapping(SZ.DESIGN_DN_TO_INCH, 'dn')} || '"/' || CASE WHEN conn = 'GROOVED' THEN {_ODS.format('dn')} END || 'MM',
  {mapping(SZ.DESIGN_DN_TO_INCH, 'dn')} || '"/DN' || dn, 'DN' || dn, inch || '"') END, '') AS size
FROM (SELECT f.raw AS description, f.by1, f.role, coalesce(f.fam, '') AS family, m.value AS conn,
    CASE WHEN f.role IN ('accessory', 'spare_part') THEN 'excluded' WHEN f.role = 'valve' THEN 'valve' ELSE 'unsupported' END AS status,
    CASE WHEN f.role = 'valve' THEN {_SPECIAL} ELSE '' END AS special,
    nullif(regexp_extract(t, '{_PAIR}', 1), '') AS "left", nullif(regexp_extract(t, '{_PAIR}', 2), '') AS pair_dn,
    nullif(regexp_extract(t, '{_PAIR}', 3), '') AS pair_od, nullif(regexp_extract(t, '\bDN\s*(\d+)\b', 1), '') AS dn,
    nullif(regexp_extract(t, '((?:\d+\s+\d+/\d+|\d+/\d+|\d+))\s*"', 1), '') AS inch
  FROM dfam f LEFT JOIN matched m ON m.raw = f.raw AND m.by1 = f.by1 AND m.field = 'connection')""", "dfam", "matched")))
def variant_design_parts(spark, d):
    designed = DS.design(_design_keys(spark, d))

    def value(name):
        return T.blank(F.try_element_at("attributes", F.lit(name))["value"])

    return designed.select(
        F.col("raw_description").alias("description"), "by1", F.col("product_role").alias("role"),
        T.blank(F.col("valve_family")).alias("family"),
        F.when(F.col("status").isin("complete", "partial"), "valve").otherwise(F.col("status"))
        .alias("status"), value("special_requirements").alias("special"), value("size").alias("size"))


@query("variant_terms", variant(ORACLES["term_match"]))
def variant_terms(spark, d):
    o = DS.observe(_design_keys(spark, d)).select(
        F.col("raw_description").alias("description"), "by1", F.explode(
            F.map_entries("attributes")).alias("e"))
    return o.filter(~F.col("e.key").isin("pressure", "size", "special_requirements")).select(
        "description", "by1", F.col("e.key").alias("field"), F.col("e.value.value").alias("value"),
        F.col("e.value.evidence").alias("term"))


@query("variant_spec_rules", variant(ORACLES["spec_rules"], labelled=True))
def variant_spec_rules(spark, d):
    return J.build_spec_rules(_prepared(spark, d))["rules"]


@query("variant_rule_holdout", variant(sql("""
SELECT count(*) AS holdout_rows, count(*) FILTER (p IS NOT NULL) AS prefix_covered, count(*) FILTER (p = spec_prefix) AS prefix_correct,
  count(*) FILTER (p IS NOT NULL AND size IS NOT NULL) AS combined_covered, count(*) FILTER (p || size = spec_prefix || spec_size) AS combined_correct
FROM (SELECT t.*, r.prefix AS p, s.size FROM tag_by1 t LEFT JOIN rules_tag_by1 r ON r.form = t.form JOIN sized s ON s.raw = t.raw WHERE win = 'holdout')""",
    "tag_by1", "rules_tag_by1", "sized"), labelled=True))
def variant_rule_holdout(spark, d):
    return J.build_spec_rules(_prepared(spark, d))["holdout"].select(
        "holdout_rows", "prefix_covered", "prefix_correct", "combined_covered", "combined_correct")


_SCORE = f"least({mapping(SZ.SIZE_RULE_RELIABILITY, 's.rule')}::DOUBLE, 0.995)"


@query("variant_legacy_spec", variant(sql(f"""
SELECT l.query, l.form_code, l.customer_key, match_level, value, support, inferred_spec, confidence,
  round_even(CASE WHEN match_level = 'mature_rule' THEN {_SCORE} ELSE confidence_score END, 4) AS confidence_score
FROM legacy_out l LEFT JOIN sized s ON s.raw = l.query WHERE rank = 1""", "legacy_out", "sized"), labelled=True))
def variant_legacy_spec(spark, d):
    # Filtered behind the table: before it, the filter would normalise every text once more.
    rows = needed(spark, d, *HQ.LEGACY, variants=True).filter("description <> ''")
    rules = R.prefix_rules(cut_lineage(R.rule_rows(rows, "by1")))
    index = as_lookup(EV.legacy_evidence_index(past(rows)), EV.KEYS)
    answers = in_slices(K.legacy_answers(keys(later(rows), "by1", customer=True), index, rules),
                        ["description"])
    return HQ._legacy_rows(answers).filter("rank = 1").select(
        "query", "form_code", "customer_key", "match_level", "value", "support", "inferred_spec",
        "confidence", F.round("confidence_score", 4).alias("confidence_score"))
