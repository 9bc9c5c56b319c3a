"""Cascades: the first key level with evidence answers a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import spec_number
from ..functions.sizes import infer_size, size_candidates
from ..functions.text import fingerprint, normalize_code, normalize_text, split_context
from .evidence import exact_hits

# Level orders. "rule" is the mature-rule step; "profile" and "fuzzy" are the last resorts.
BY1_ORDER = ["description_form_customer", "description_form", "description_customer",
             "description"]
SPEC_ORDER = ["description_form_customer", "description_form", "rule", "description_customer",
              "description", "profile"]
LEGACY_ORDER = ["description_form_customer", "rule", "description_form", "description_customer",
                "description", "fuzzy"]
# Names of the levels in results.
RECOMMEND_LEVELS = {"description_form": "description_form_code", "rule": "mature_form_rule"}
LEGACY_LEVELS = {"description_form_customer": "description_customer_form", "rule": "mature_rule",
                 "fuzzy": "fuzzy_description"}
# Measured reliability of each exact level of the specification index.
STAGE_RELIABILITY = {"description_form_customer": 0.984, "description_form": 0.868,
                     "description_customer": 0.940, "description": 0.952}
RULE_SCORE = 0.995
KEY = ["query", "description", "form_code", "customer_key"]


def parse_requests(requests: DataFrame) -> DataFrame:
    """Resolve [SEP] contexts and add the lookup keys; status tells invalid requests."""
    parsed = requests.withColumn("_c", split_context(
        F.col("query"), F.col("customer"), F.col("form_code")))
    return parsed.select(
        "request_id", F.col("_c.query").alias("query"), F.col("_c.customer").alias("customer"),
        normalize_text(F.col("_c.query")).alias("description"),
        normalize_code(F.col("_c.form_code")).alias("form_code"),
        fingerprint(F.col("_c.customer")).alias("customer_key"),
        F.col("_c.status").alias("status"))


def request_keys(parsed: DataFrame) -> DataFrame:
    """Distinct answerable requests: every cascade answers these once."""
    return parsed.filter(F.col("status") == "ok").select(*KEY).distinct()


def rule_hits(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Mature prefix rules whose form and inferred size both apply."""
    prefixes = rules.filter(F.col("prefix").rlike(r"^\p{L}+$")).select(
        F.col("form").alias("form_code"), "prefix", "train_support", "validation_support")
    joined = keys.join(prefixes, "form_code")
    # Read from an aggregate, so that the filter below is not pushed to the single requests.
    texts = joined.groupBy("query").agg(F.max("query").alias("text")).select(
        "query", infer_size(F.col("text")).alias("size"))
    sizes = joined.join(texts, "query").filter(F.col("size").isNotNull())
    support = F.col("train_support") + F.col("validation_support")
    return sizes.select(
        *KEY, F.lit("rule").alias("level"), support.alias("total"),
        F.lit(1).cast("bigint").alias("candidates"),
        F.array(F.struct(F.lit(1).alias("rank"), F.concat("prefix", "size.size").alias("value"),
                         support.alias("n"))).alias("ranked"),
        F.col("size.rule").alias("size_rule"), F.col("size.reliability").alias("reliability"),
        "prefix", "train_support", "validation_support")


def first_level(hits: DataFrame, order: list[str]) -> DataFrame:
    """Keep the strongest level per request key; combines before the shuffle."""
    position = F.array_position(F.array(*map(F.lit, order)), F.col("level"))
    values = [c for c in hits.columns if c not in KEY]
    best = hits.filter(position > 0).groupBy(*KEY).agg(
        F.min_by(F.struct(*values), position).alias("hit"))
    return best.select(*KEY, "hit.*")


def shares(total: Column, ranked: Column) -> Column:
    """Candidates with their rounded share of all evidence."""
    return F.transform(ranked, lambda x: F.struct(
        x["rank"].alias("rank"), x["value"].alias("value"),
        F.bround(x["n"] / total, 4).alias("score"), x["n"].alias("support")))


def confidence_label(score: Column, support: Column) -> Column:
    return (F.when((score >= 0.85) & (support >= 2), "high").when(score >= 0.60, "medium")
            .otherwise("low"))


def level_name(level: Column, names: dict) -> Column:
    out = level
    for key, name in names.items():
        out = F.when(level == key, name).otherwise(out)
    return out


def by1_answers(keys: DataFrame, evidence: DataFrame, k: int = 5) -> DataFrame:
    """Variety candidates of the first exact level, at most k (1 to 20).

    evidence: an evidence index of varieties.
    """
    k = max(1, min(int(k), 20))
    hit = first_level(exact_hits(keys, evidence, k), BY1_ORDER)
    return hit.select(*KEY, level_name(F.col("level"), RECOMMEND_LEVELS).alias("by1_match_level"),
                      F.col("total").alias("by1_support"),
                      shares(F.col("total"), F.col("ranked")).alias("by1_candidates"))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def spec_answers(keys: DataFrame, evidence: DataFrame, rules: DataFrame,
                 profiles: DataFrame | None = None) -> DataFrame:
    """Specification of each request key: exact form levels, rule, weaker levels, profiles.

    evidence is an evidence index of specifications; ``profiles`` are template hits in the shape
    of exact hits with level "profile" and template_ids.
    """
    exact = exact_hits(keys, evidence, 10)
    hits = exact.unionByName(rule_hits(keys, rules), allowMissingColumns=True)
    if profiles is not None:
        hits = hits.unionByName(profiles, allowMissingColumns=True)
    best = first_level(hits, SPEC_ORDER)
    ruled = F.col("level") == "rule"
    name = level_name(F.col("level"), RECOMMEND_LEVELS)
    if profiles is not None:
        name = F.when(F.col("level") == "profile", F.when(
            F.col("size_rule").isNotNull(), "template_form_size").otherwise(
            "template_profile")).otherwise(name)
    alternatives = F.when(ruled, F.transform("ranked", lambda x: F.struct(
        x["rank"].alias("rank"), x["value"].alias("value"), F.lit(RULE_SCORE).alias("score"),
        x["n"].alias("support")))).otherwise(shares(F.col("total"), F.col("ranked")))
    scored = best.withColumns({"spec_match_level": name, "spec_alternatives": alternatives})
    top = F.col("spec_alternatives")[0]
    label = F.when(ruled, "high").otherwise(confidence_label(top["score"], top["support"]))
    templates = F.col("template_ids") if profiles is not None else _none("array<string>")
    return scored.select(
        *KEY, F.when(label != "low", top["value"]).alias("inferred_spec"),
        label.alias("spec_confidence"), top["score"].alias("spec_confidence_score"),
        "spec_match_level", "spec_alternatives", F.col("total").alias("spec_support"),
        F.col("candidates").alias("spec_candidates"), "size_rule", templates.alias("template_ids"))


def legacy_answers(keys: DataFrame, evidence: DataFrame, rules: DataFrame | None, k: int = 50,
                   ) -> DataFrame:
    """Specification index answers: exact with customer, rule, weaker exact levels.

    evidence: a legacy evidence index.
    """
    hits = exact_hits(keys, evidence, max(1, int(k)))
    if rules is not None:
        hits = hits.unionByName(rule_hits(keys, rules), allowMissingColumns=True)
    else:
        hits = hits.withColumns({"size_rule": _none("string"), "reliability": _none("double")})
    best = first_level(hits, LEGACY_ORDER)
    ruled = F.col("level") == "rule"
    rule_score = F.bround(F.least(F.col("reliability"), F.lit(RULE_SCORE)), 4)
    sizes = size_candidates(F.col("query"))

    def alternative(x: Column) -> Column:
        share = F.bround(x["n"] / F.col("total"), 4)
        fits = F.when(F.size("sizes") > 0, F.coalesce(
            F.array_contains("sizes", spec_number(x["value"])), F.lit(False)))
        return F.struct(x["rank"].alias("rank"), x["value"].alias("value"),
                        F.when(ruled, rule_score).otherwise(share).alias("score"),
                        x["n"].alias("support"),
                        F.when(ruled, F.lit(True)).otherwise(fits).alias("size_match"))

    scored = best.withColumn("sizes", sizes).withColumn(
        "alternatives", F.transform("ranked", alternative))
    top = F.col("alternatives")[0]
    reliability = F.lit(None).cast("double")
    for level, value in STAGE_RELIABILITY.items():
        reliability = F.when(F.col("level") == level, value).otherwise(reliability)
    # Half to even on the binary value, as products of rounded shares often end in a 5.
    calibrated = F.rint(top["score"] * reliability * 10_000) / 10_000
    score = F.when(ruled, rule_score).otherwise(calibrated)
    scored = scored.withColumn("confidence_score", score)
    label = F.when(ruled, "high").otherwise(
        confidence_label(F.col("confidence_score"), top["support"]))
    return scored.select(
        *KEY, F.when(label != "low", top["value"]).alias("inferred_spec"),
        label.alias("confidence"), "confidence_score",
        level_name(F.col("level"), LEGACY_LEVELS).alias("match_level"), "alternatives",
        F.col("total").alias("support"), "sizes", "size_rule")
