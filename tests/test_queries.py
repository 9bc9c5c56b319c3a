"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
PICKED = ["normalize_text", "parse_product_codes", "infer_size", "segments", "views", "term_match",
          "recommendation_records", "evidence_by1", "prefix_rules", "exact_spec", "fuzzy_rank",
          "hits_by_label", "rerank_fusion", "eval_gold", "append_descriptions", "stream_scores",
          "term_match_large", "dictionary_usage", "design_render", "designed_orders",
          "cluster_descriptions", "cluster_report", "legacy_spec", "cosine_topk",
          "weighted_jaccard", "template_retrieve", "recommend", "infer_spec", "batch_import",
          "exact_by1", "written_index", "stream_specs"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", PICKED)
def test_query(spark, name):
    assert compare(spark, duck(FOLDER), FOLDER, name, entry.queries(), entry.oracle_sql())


def test_every_query_is_named_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
