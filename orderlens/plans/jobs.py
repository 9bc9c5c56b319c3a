"""The composed jobs: indexes, rules, recommendation, specification inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import record_id
from ..functions.sizes import infer_size
from ..functions.standardize import with_views
from ..functions.vectors import hashed_vector
from ..operators import cascade, evidence, fuzzy, history, publish, rules, templates, vectors
from ..operators.cascade import KEY
from ..sources.orders import TRAIN_BEFORE, VALIDATION_BEFORE, before, usable
from .scale import cut_lineage, dealt


def build_recommendation_index(rows: DataFrame, before_date: str | None = None,
                               train_before: str = TRAIN_BEFORE,
                               validation_before: str = VALIDATION_BEFORE) -> dict:
    """Records, counters, evidence tables, form rules and profile from prepared order rows."""
    index = before(rows, before_date)
    tagged = cut_lineage(rules.rule_rows(index, "form_code", train_before, validation_before))
    return {
        "records": history.recommendation_records(index),
        "counters": history.record_counters(index),
        "by1_evidence": evidence.evidence_index(index, "by1"),
        "spec_evidence": evidence.evidence_index(index, "spec"),
        "form_rules": cut_lineage(rules.prefix_rules(tagged, literal_spec=True)),
        "profile": history.source_profile(index),
    }


def build_spec_index(rows: DataFrame, before_date: str | None = None) -> dict:
    """Records, customer counters and evidence table of the specification index."""
    index = before(rows, before_date)
    return {
        "records": cut_lineage(history.spec_records(index)),
        "customers": history.spec_record_customers(index),
        "evidence": evidence.legacy_evidence_index(index),
        "profile": history.source_profile(index),
    }


# Sort order of the stored tables of both indexes; tables of LOOKUPS are bucketed by their keys.
SORTED = {"records": ["by1", "form_code", "spec", "description"],
          "counters": ["by1", "form_code", "spec", "description", "counter", "value"],
          "customers": ["description", "form_code", "spec", "customer_key"],
          "form_rules": ["form"], "profile": []}
LOOKUPS = {"by1_evidence": evidence.KEYS, "spec_evidence": evidence.KEYS,
           "evidence": evidence.KEYS}


def write_index(index: dict, path: str, buckets: int | None = None) -> None:
    """Store the tables of an index below a path: sorted files, evidence as tables of buckets."""
    for name, table in index.items():
        if name in LOOKUPS:
            publish.write_lookup(table, f"{path}/{name}", LOOKUPS[name], buckets)
        else:
            order = [c for c in SORTED[name] if c in table.columns]
            publish.write_table(table, f"{path}/{name}", sort_by=order)


def read_index(spark: SparkSession, path: str, names: list[str]) -> dict:
    """Tables of a stored index by name; answers read them without ranking or dealing evidence."""
    return {name: publish.read_lookup(spark, f"{path}/{name}") if name in LOOKUPS
            else spark.read.parquet(f"{path}/{name}") for name in names}


def build_spec_rules(rows: DataFrame, train_before: str = TRAIN_BEFORE,
                     holdout_from: str = VALIDATION_BEFORE, min_train: int = 20,
                     min_validation: int = 5) -> dict:
    """Variety prefix rules, window sizes and holdout metrics."""
    tagged = cut_lineage(rules.rule_rows(rows, "by1", train_before, holdout_from))
    mined = cut_lineage(rules.prefix_rules(tagged, min_train, min_validation))
    return {"rules": mined, "windows": rules.window_counts(tagged),
            "holdout": rules.rule_holdout(tagged, mined)}


def embedded_children(records: DataFrame, embed=hashed_vector) -> DataFrame:
    """Records with child ids and a vector per distinct semantic text."""
    # Cut before the filter: pushed down, it would parse every example once more.
    usable_rows = cut_lineage(records).filter(
        (F.col("by1") != "") & (F.col("semantic_description") != ""))
    placed = usable_rows.withColumn("child_id", record_id(
        F.col("by1"), F.col("form_code"), F.col("spec"), F.col("description")))
    with_vector = vectors.with_vectors(placed, "semantic_description", embed)
    return with_vector.select("child_id", "by1", "form_code", "spec", "description", "example",
                              F.col("count").alias("support"), "vector")


def template_member_rows(rows: DataFrame, embed=hashed_vector) -> DataFrame:
    """Template members from prepared order rows: one per (description, form, variety, spec)."""
    grouped = usable(rows).groupBy("raw_description", "form_code", "by1", "spec").agg(
        F.count(F.lit(1)).alias("support"), F.min("date").alias("contract_date"))
    key = F.concat_ws("|", "by1", "form_code", "spec", "raw_description")
    members = grouped.withColumn("point_id", F.sha1(key.cast("binary")))
    texts = members.select("raw_description").distinct()
    views = with_views(texts, "raw_description").select(
        "raw_description", F.col("structural_view").alias("structural"),
        F.col("full_view").alias("full"), "attributes",
        F.coalesce(infer_size(F.col("raw_description"))["size"], F.lit("")).alias("parsed_size"))
    views = vectors.with_vectors(views, "structural", embed)
    return members.join(views, "raw_description")


def request_views(keys: DataFrame, embed=hashed_vector) -> DataFrame:
    """Request keys with id, plain attributes, semantic text and vector."""
    texts = with_views(keys.select("query").distinct(), "query").select(
        "query", F.col("structural_view").alias("semantic_text"),
        F.transform_values("attributes", lambda _, a: a["value"]).alias("attributes"))
    texts = vectors.with_vectors(texts, "semantic_text", embed)
    return keys.join(texts, "query").withColumn("request_id", F.sha1(F.concat_ws(
        "|", *KEY).cast("binary")))


def recommend(requests: DataFrame, index: dict, template_index: dict | None = None,
              children: DataFrame | None = None, rerank_scores=None,
              embed=hashed_vector, k: int = 5) -> DataFrame:
    """One row per request: variety candidates and level, specification, alternatives.

    index: by1_evidence, spec_evidence, form_rules. template_index: templates and profiles.
    children: embedded_children. Templates, then vectors, answer only requests without an exact
    variety; rerank scores (request_id, by1, score) re-order vector candidates. They are a table
    or a function from the documents to be scored (vectors.rerank_documents) to such a table.
    """
    parsed = cascade.parse_requests(requests)
    keys = cut_lineage(cascade.request_keys(parsed))
    exact = cascade.by1_answers(keys, index["by1_evidence"], k)
    answers = exact.select(*KEY, "by1_match_level", "by1_support", "by1_candidates")
    profiles = None
    if template_index is not None or children is not None:
        open_keys = cut_lineage(request_views(
            keys.join(dealt(exact.select(*KEY)), KEY, "left_anti"), embed))
    if template_index is not None:
        hits = cut_lineage(templates.retrieve_templates(open_keys, template_index["templates"]))
        found = _answer(open_keys, templates.by1_from_templates(hits, k), "template_retrieval")
        answers = answers.unionByName(found)
        profiles = templates.profile_hits(open_keys, hits, template_index["profiles"])
        open_keys = open_keys.join(hits.select("request_id").distinct(), "request_id", "left_anti")
    if children is not None:
        asked = open_keys.filter(F.col("semantic_text") != "")
        hits = vectors.child_hits(asked, children)
        ranked = vectors.by1_from_hits(hits, asked, k)
        level = F.lit("vector_full_index")
        if rerank_scores is not None:
            ranked = cut_lineage(ranked)
            scores = (rerank_scores(vectors.rerank_documents(ranked, asked))
                      if callable(rerank_scores) else rerank_scores)
            ranked = vectors.fuse_rerank(ranked, scores)
            level = F.when(F.col("used"), "vector_reranked").otherwise(level)
        answers = answers.unionByName(_answer(asked, ranked, level))
    specs = cascade.spec_answers(keys, index["spec_evidence"], index["form_rules"], profiles)
    return _attach(parsed, answers, specs)


def _answer(keys: DataFrame, ranked: DataFrame, level) -> DataFrame:
    if "reranker_used" not in ranked.columns:
        ranked = ranked.withColumn("reranker_used", F.lit(False))
    grouped = ranked.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("rank").alias("rank"), F.col("by1").alias("value"), "score", "support")))
        .alias("by1_candidates"), F.sum("support").alias("by1_support"),
        F.max("reranker_used").alias("used"))
    named = grouped.withColumn(
        "by1_match_level", level if not isinstance(level, str) else F.lit(level))
    return keys.select("request_id", *KEY).join(named, "request_id").select(
        *KEY, "by1_match_level", "by1_support", "by1_candidates")


def _attach(parsed: DataFrame, answers: DataFrame, specs: DataFrame) -> DataFrame:
    """Give every request the answer of its key; one key may hold many requests."""
    from .scale import salted_lookup
    both = answers.join(specs, KEY, "full")
    joined = salted_lookup(parsed, both, KEY, "request_id")
    return joined.withColumns({
        "by1_match_level": F.coalesce("by1_match_level", F.lit("none")),
        "spec_match_level": F.coalesce("spec_match_level", F.lit("none")),
        "spec_confidence": F.coalesce("spec_confidence", F.lit("low")),
        "spec_confidence_score": F.coalesce("spec_confidence_score", F.lit(0.0)),
        "by1_support": F.coalesce("by1_support", F.lit(0)).cast("bigint")})


def infer_specification(requests: DataFrame, index: dict, spec_rules: DataFrame | None = None,
                        k: int = 50) -> DataFrame:
    """One row per request: specification by exact levels, rules, then fuzzy descriptions.

    index: records, customers and evidence of build_spec_index.
    """
    from .scale import salted_lookup
    k = max(1, min(int(k), 100))
    parsed = cascade.parse_requests(requests)
    keys = cut_lineage(cascade.request_keys(parsed).filter(F.col("description") != ""))
    exact = cut_lineage(cascade.legacy_answers(keys, index["evidence"], spec_rules, k))
    missed = keys.join(dealt(exact.select(*KEY)), KEY, "left_anti")
    similar = fuzzy.fuzzy_answers(missed, index["records"], index["customers"], k)
    answers = exact.unionByName(similar, allowMissingColumns=True)
    status = F.when((F.col("status") == "ok") & (F.col("description") == ""),
                    "not_searchable").otherwise(F.col("status"))
    joined = salted_lookup(parsed.withColumn("status", status), answers, KEY, "request_id")
    return joined.withColumns({
        "match_level": F.coalesce("match_level", F.lit("none")),
        "confidence": F.coalesce("confidence", F.lit("low")),
        "confidence_score": F.coalesce("confidence_score", F.lit(0.0)),
        "support": F.coalesce("support", F.lit(0)).cast("bigint")})
