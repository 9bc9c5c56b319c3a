"""Description design: role, family, attributes, canonical text, status and templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import design_template_id
from ..functions.sizes import design_pressure, design_size
from ..functions.standardize import EVIDENCE_TYPE
from ..functions.text import blank, collapse, matches, strip
from ..plans.scale import cut_lineage, over_distinct, salted_lookup, top_k
from .dictionary import Dictionary, default_dictionary, with_exceptions, with_matches
from .rules import counts_by_window, mature_attribute_rules

# Family names, role and family patterns, special requirements, required fields.
FAMILY_NAMES = {"butterfly": "BUTTERFLY VALVE", "check": "CHECK VALVE", "gate": "GATE VALVE"}
ACCESSORY = (r"^(?:VALVE\s+)?(?:SUPERVISORY\s+SWITCH|INDEX\s+PLATE|TURBINE\s+HEAD|GEAR\s*BOX|"
             r"HANDWHEEL|VERTICAL\s+INDICATOR\s+POST|SIGNAL\s+WORM\s+GEAR)\b")
SPARE = (r"\b(?:MAINTENANCE|REPAIR|SEAL)\s+KIT\b|\bGASKETS?\b|\bSPARE\s+PARTS?\b|"
         r"^(?:DISC|SEAT|STEM)\s+FOR\b")
UNSUPPORTED = r"\b(?:BALL|CONTROL)\s+VALVE\b"
FULL_NAMES = {
    "butterfly": r"\b(?:BUTTERFLY(?:\s+VALVE)?|BFV|BFLY)\b",
    "check": r"\b(?:CHECK\s+VALVE|SWING\s+CHECK|DUAL\s+PLATE\s+CHECK|NON[ -]?RETURN|NRV)\b",
    "gate": r"\b(?:GATE\s+VALVE|RESILIENT\s+SEATED\s+GATE|KNIFE\s+GATE)\b",
}
SHORT_NAMES = {
    "butterfly": (r"\bBV\b", r"FIRE RISER"),
    "check": (r"\bCV\b", r"\b(?:SWING|DUAL\s+PLATE|D\.D\.)\b"),
    "gate": (r"\bGV\b", r"\b(?:OS&Y|OSY|NRS|RESILIENT)\b"),
}
BODY_CONTEXT = r"\b(?:DI|CI|DUCTILE\s+IRON|CAST\s+IRON)\b"
CONNECTION_CONTEXT = r"\b(?:LUG\s+WAFER|WAFER|GRVD|GROOVED|FLGD|FLANGED|THD|THREADED)\b"
CODE_SHAPES = {"butterfly": r"^[A-Z]?XD\d", "check": r"^[A-Z]?DH?\d", "gate": r"^[A-Z]?XZ?\d"}
SPECIALS = [(r"\bSTEM\s+PRE[- ]NOTCHED\b", "STEM PRE-NOTCHED"), (r"\bDRAIN\s+HOLE\b", "DRAIN HOLE"),
            (r"\bTAMPER\s+SWITCH\b", "TAMPER SWITCH"), (r"\bHIGHER\s+LEVER\b", "HIGHER LEVER"),
            (r"\bLONG\s+NECK\b", "LONG NECK"), (r"\bLOCKABLE\b", "LOCKABLE")]
REQUIRED = ["body_material", "connection", "size"]
ATTRIBUTE_FIELDS = ["body_material", "connection", "structure", "seat_material",
                    "closure_material", "actuation", "pressure", "standard_certification", "size",
                    "special_requirements"]
RENDER_TAIL = ["actuation", "special_requirements", "pressure", "standard_certification", "size"]
CONFIDENCE_GATE = 0.99


def design_text(raw: Column) -> Column:
    """Upper case, straight quotes, BUNA-N spelled one way, single blanks."""
    upper = F.translate(F.upper(strip(blank(raw))), "“”″", '"""')
    return collapse(F.replace(upper, F.lit("BUNA N"), F.lit("BUNA-N")))


def role(text: Column) -> Column:
    return (F.when(matches(text, ACCESSORY), "accessory").when(matches(text, SPARE), "spare_part")
            .otherwise("valve"))


def code_family(by1: Column) -> Column:
    """Family suggested by the shape of a variety code."""
    compact = F.regexp_replace(F.upper(blank(by1)), "[^A-Z0-9]", "")
    return F.coalesce(*[F.when(compact.rlike(shape), name) for name, shape in CODE_SHAPES.items()])


def family(text: Column, hint: Column) -> Column:
    """butterfly, check, gate or null. Abbreviations need context; the code hint comes last."""
    context = matches(text, BODY_CONTEXT) & matches(text, CONNECTION_CONTEXT)
    named = [F.when(matches(text, p), name) for name, p in FULL_NAMES.items()]
    short = [F.when(matches(text, p) & (context | matches(text, also)), name)
             for name, (p, also) in SHORT_NAMES.items()]
    return F.when(~matches(text, UNSUPPORTED), F.coalesce(*named, *short, hint))


def _entry(name: str, value: Column, proof: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), F.struct(
        value.alias("value"), F.lit("query").alias("source"), F.lit(1.0).alias("confidence"),
        proof.alias("evidence")).alias("value"))


def _extract(pairs: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Role, family, dictionary matches and pattern parts of distinct (description, hint)."""
    text = F.col("text")
    staged = pairs.withColumn("text", design_text(F.col("raw_description"))).withColumns({
        "product_role": role(text),
        "family": family(text, F.nullif(F.col("hint"), F.lit("")))})
    found = [F.when(matches(text, p), F.lit(v)) for p, v in SPECIALS]
    # Distinct texts only; matching reads them twice.
    matched = with_matches(cut_lineage(staged), dictionary.terms, ["raw_description", "hint"], "text", "family")
    return matched.withColumns({
        "p_pressure": design_pressure(text),
        "p_special": F.nullif(F.concat_ws("; ", *found), F.lit(""))})


def observe(rows: DataFrame, dictionary: Dictionary | None = None,
            row_id: str | None = None) -> DataFrame:
    """Adds product_role, valve_family and attributes seen in the text.

    rows: raw_description, by1, form_code. All regex work runs once per distinct description and
    code hint; only exceptions, which may look at codes, run per row.
    """
    dictionary = dictionary or default_dictionary(rows.sparkSession)
    hinted = rows.withColumn("hint", F.coalesce(code_family(F.col("by1")), F.lit("")))
    key = ["raw_description", "hint"]
    found = over_distinct(
        hinted, key, lambda d: _extract(d, dictionary), row_id)
    valve = (F.col("product_role") == "valve") & F.col("family").isNotNull()
    staged = found
    if dictionary.exceptions is not None:
        named = found.withColumns({
            "_text": blank(F.col("text")), "_family": F.upper(blank(F.col("family"))),
            "_by1": F.upper(strip(blank(F.col("by1")))),
            "_form": F.upper(strip(blank(F.col("form_code"))))})
        context = {"description": "_text", "family": "_family", "valve_family": "_family",
                   "by1": "_by1", "form_code": "_form"}
        staged = with_exceptions(named, dictionary.exceptions, ["_text", "_family", "_by1", "_form"],
                                 context).drop("_text", "_family", "_by1", "_form")
    staged = staged.withColumn("p_size", design_size(
        F.col("text"), F.coalesce(F.try_element_at("found", F.lit("connection"))["value"],
                                  F.lit(""))))
    patterns = F.filter(F.array(*[
        _entry(name, F.col(column), F.col(column)) for name, column in
        (("pressure", "p_pressure"), ("size", "p_size"), ("special_requirements", "p_special"))]),
        lambda e: e["value"]["value"].isNotNull())
    over = F.map_from_entries(patterns)
    named = F.transform_values("found", lambda _, m: F.struct(
        m["value"].alias("value"), F.lit("query").alias("source"),
        F.lit(1.0).alias("confidence"), m["term"].alias("evidence")))
    merged = F.map_concat(
        F.map_filter(named, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)
    empty = F.map_from_arrays(F.array().cast("array<string>"),
                              F.array().cast(f"array<{EVIDENCE_TYPE}>"))
    return staged.withColumn("attributes", F.when(valve, merged).otherwise(empty)).withColumn(
        "valve_family", F.col("family")).withColumn(
        "product_role", F.when((F.col("product_role") == "valve") & F.col("family").isNull(),
                               "other").otherwise(F.col("product_role"))).drop(
        "hint", "text", "family", "found", "p_pressure", "p_special", "p_size")


def active_rules(rules: DataFrame) -> DataFrame:
    """Rules fit for use: active, complete, confident."""
    from ..functions.text import is_active
    cleaned = rules.filter(is_active(F.col("active"))).select(
        F.upper(strip(blank(F.col("by1")))).alias("by1"),
        F.upper(strip(blank(F.col("form_code")))).alias("form_code"),
        strip(blank(F.col("field"))).alias("field"), strip(blank(F.col("value"))).alias("value"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    return cleaned.filter((F.col("by1") != "") & (F.col("field") != "") & (F.col("value") != "")
                          & (F.col("confidence") >= CONFIDENCE_GATE))


def overlay_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds inferred: rule values of the variety, overridden by those of variety and form."""
    packed = rules.groupBy("by1", "form_code").agg(F.map_from_entries(F.collect_list(F.struct(
        "field", F.struct("value", F.lit("mature_rule").alias("source"), "confidence",
                          F.lit("validated historical rule").alias("evidence")))))
        .alias("values"))
    packed = cut_lineage(packed)
    general = packed.filter(F.col("form_code") == "").select(
        F.col("by1").alias("r_by1"), F.col("values").alias("general"))
    special = packed.filter(F.col("form_code") != "").select(
        F.col("by1").alias("s_by1"), F.col("form_code").alias("s_form"),
        F.col("values").alias("special"))
    by1, form = F.upper(F.trim("by1")), F.upper(F.trim("form_code"))
    joined = rows.join(general, by1 == F.col("r_by1"), "left").join(
        special, (by1 == F.col("s_by1")) & (form == F.col("s_form")), "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"),
                              F.array().cast(f"array<{EVIDENCE_TYPE}>"))
    base, over = F.coalesce("general", empty), F.coalesce("special", empty)
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return joined.withColumn("inferred", F.map_concat(kept, over)).drop(
        "r_by1", "general", "s_by1", "s_form", "special")


def merge_inferred(observed: Column, inferred: Column) -> Column:
    """Struct (attributes, inferred_fields): confident values for fields the text leaves open."""
    added = F.map_filter(inferred, lambda k, v: ~F.map_contains_key(observed, k)
                         & (F.trim(blank(v["value"])) != "")
                         & (v["confidence"] >= CONFIDENCE_GATE))
    return F.struct(F.map_concat(observed, added).alias("attributes"),
                    F.array_sort(F.map_keys(added)).alias("inferred_fields"))


def plain_values(attributes: Column) -> Column:
    return F.transform_values(attributes, lambda _, a: a["value"])


def render(family_name: Column, values: Column) -> Column:
    """Canonical text of a family and its field values."""
    def value(name: str) -> Column:
        return F.nullif(strip(blank(F.try_element_at(values, F.lit(name)))), F.lit(""))

    full_name = reduce(lambda out, kv: F.when(family_name == kv[0], kv[1]).otherwise(out),
                       FAMILY_NAMES.items(), F.lit(None).cast("string"))
    heading = F.concat_ws(" ", value("body_material"), value("connection"), value("structure"),
                          full_name)
    closing = F.when(family_name == "gate", " WEDGE").otherwise(" DISC")
    return F.concat_ws(", ", heading, F.concat(value("seat_material"), F.lit(" SEAT")),
                       F.concat(value("closure_material"), closing),
                       *[value(name) for name in RENDER_TAIL])


def finish(rows: DataFrame) -> DataFrame:
    """Adds template id, text, status, score, label and warnings from observed and inferred."""
    empty = F.map_from_arrays(F.array().cast("array<string>"),
                              F.array().cast(f"array<{EVIDENCE_TYPE}>"))
    valve = F.col("product_role") == "valve"
    source = rows if "inferred" in rows.columns else rows.withColumn("inferred", empty)
    merged = source.withColumn("_m", merge_inferred(
        F.col("attributes"), F.when(valve, F.col("inferred")).otherwise(empty)))
    merged = merged.withColumns({"attributes": F.col("_m.attributes"),
                                 "inferred_fields": F.col("_m.inferred_fields")}).drop(
        "_m", "inferred")
    values = plain_values(F.col("attributes"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)),
                                          F.map_keys("attributes")))
    complete = F.size(missing) == 0
    score = (F.when(~valve, 0.0).when(complete & (F.size("inferred_fields") == 0), 0.99)
             .when(complete, 0.95)
             .otherwise(F.round(F.greatest(F.lit(0.6), 0.9 - 0.1 * F.size(missing)), 4)))
    status = (F.when(F.col("product_role").isin("accessory", "spare_part"), "excluded")
              .when(~valve, "unsupported").when(complete, "complete").otherwise("partial"))
    staged = merged.withColumns({
        "template_id": F.when(valve, design_template_id(F.col("valve_family"), values)),
        "standardized_description": F.when(valve, render(F.col("valve_family"), values)),
        "status": status, "confidence_score": score,
        "warnings": F.when(valve, F.transform(missing, lambda m: F.concat(F.lit("missing_"), m)))
        .otherwise(F.array().cast("array<string>"))})
    return staged.withColumn("confidence", F.when(F.col("confidence_score") >= 0.95, "high")
                             .when(F.col("confidence_score") >= 0.75, "medium").otherwise("low"))


def design(rows: DataFrame, dictionary: Dictionary | None = None,
           rules: DataFrame | None = None, row_id: str | None = None) -> DataFrame:
    """Design every row (raw_description, by1, form_code), filling fields from mature rules."""
    seen = observe(rows, dictionary, row_id)
    return finish(seen if rules is None else overlay_rules(seen, active_rules(rules)))


def only_valves(designed: DataFrame) -> DataFrame:
    return designed.filter((F.col("product_role") == "valve") & F.col("valve_family").isNotNull())


DESIGN_KEY = ["raw_description", "by1", "form_code"]


def build_assets(rows: DataFrame, train_until: str, validation_until: str,
                 dictionary: Dictionary | None = None, version: str = "bootstrap") -> dict:
    """Two-pass asset build over prepared order rows.

    Pass one extracts attributes per distinct (description, variety, form) and mines rules from the
    counts by window; pass two only merges and renders. Returns rules, designs (one row per
    distinct key) and lazily orders (every input row with its design).
    """
    observed = cut_lineage(observe(rows.select(*DESIGN_KEY).distinct(), dictionary))
    counts = cut_lineage(counts_by_window(rows, DESIGN_KEY, train_until, validation_until))
    valves = only_valves(observed).select(*DESIGN_KEY, "attributes")
    rules = mature_attribute_rules(counts.join(valves, DESIGN_KEY), train_until, validation_until)
    rules = cut_lineage(rules)
    # Cut, because every slice of the orders reads the designs anew.
    designs = cut_lineage(finish(overlay_rules(observed, active_rules(rules))))
    orders = salted_lookup(rows, designs, DESIGN_KEY, "row_id")
    code_warning = F.when(F.col("code_status") != "ok", F.array(
        F.concat(F.lit("product_code_"), F.col("code_status")))).otherwise(
        F.array().cast("array<string>"))
    orders = orders.withColumns({
        **{f: F.try_element_at("attributes", F.lit(f))["value"] for f in ATTRIBUTE_FIELDS},
        "warnings": F.array_join(F.concat("warnings", code_warning), ";"),
        "inferred_fields": F.array_join("inferred_fields", ","),
        "dictionary_version": F.lit(version)})
    return {"rules": rules, "designs": designs, "orders": orders}


def template_rollup(orders: DataFrame, version: str = "bootstrap") -> DataFrame:
    """Design templates of designed orders: support, varieties, forms, dates, first examples.

    orders: row_id, date, raw_description, by1, form_code, valve_family, template_id, attributes,
    standardized_description.
    """
    rows = orders.filter(F.col("template_id").isNotNull())
    order = F.struct(F.col("date").isNull(), F.col("date"), F.col("row_id"))
    grouped = rows.groupBy("template_id").agg(
        F.first("valve_family").alias("valve_family"),
        F.min_by(plain_values(F.col("attributes")), order).alias("values"),
        F.min_by("standardized_description", order).alias("standardized_description"),
        F.array_sort(F.collect_set(F.nullif(F.upper("by1"), F.lit("")))).alias("supported_by1"),
        F.array_sort(F.collect_set(F.nullif(F.upper("form_code"), F.lit("")))).alias("form_codes"),
        F.count(F.lit(1)).alias("support"), F.min("date").alias("date_min"),
        F.max("date").alias("date_max"))
    first = top_k(rows.filter(F.col("raw_description") != ""), ["template_id"],
                  [F.col("date").asc_nulls_last(), F.asc("row_id")], 3)
    examples = first.groupBy("template_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "raw_description"))).alias("ranked")).select(
        "template_id", F.col("ranked.raw_description").alias("examples"))
    joined = grouped.join(examples, "template_id", "left").withColumn(
        "attributes", F.map_filter("values", lambda k, _: k != "size")).drop("values")
    return joined.withColumns({"semantic_text": semantic_text(
        F.col("valve_family"), F.col("attributes"), " | ", ": "),
        "product_role": F.lit("valve"), "dictionary_version": F.lit(version)})


def semantic_text(family_name: Column, values: Column, between: str, inside: str) -> Column:
    """Family, then sorted field and value pairs; size is left out."""
    fields = F.array_sort(F.filter(F.map_keys(values), lambda k: k != "size"))
    pairs = F.transform(fields, lambda k: F.concat(k, F.lit(inside), F.element_at(values, k)))
    return F.array_join(F.concat(F.array(family_name), pairs), between)


def build_counts(designed: DataFrame) -> DataFrame:
    """Row counts by family ("other" without one), role, status, and in total, in one pass."""
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (
        ("rows", F.lit("all")), ("family", F.coalesce("valve_family", F.lit("other"))),
        ("role", F.col("product_role")), ("status", F.col("status")))])
    return (designed.select(F.explode(dims).alias("d")).groupBy("d.dimension", "d.value")
            .agg(F.count(F.lit(1)).alias("rows")))


def templates_per_family(templates: DataFrame) -> DataFrame:
    return templates.groupBy("valve_family").agg(F.count(F.lit(1)).alias("templates"))


def pending_review(designed: DataFrame, k: int = 500) -> DataFrame:
    """Partial descriptions by support, the k most frequent (a report)."""
    counts = designed.filter((F.col("status") == "partial") & (F.col("raw_description") != "")) \
        .groupBy(F.col("raw_description").alias("description")).agg(
        F.count(F.lit(1)).alias("support"))
    return counts.orderBy(F.desc("support"), F.asc("description")).limit(k)
