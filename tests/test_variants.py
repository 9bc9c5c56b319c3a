"""The rarer wordings and codes: their queries equal their SQL and reach every branch."""

import os

import pytest

import __spark_entry__ as entry

from compare import compare, duck
from orderlens.functions.sizes import SIZE_RULE_RELIABILITY
from orderlens.operators.cascade import LEGACY_LEVELS

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.queries() if n.startswith("variant_"))
REACHED = [
    ("variant_sizes", "rule", {"", *SIZE_RULE_RELIABILITY}),
    ("variant_code_status", "code_status", {
        "ok", "missing_code", "spec_segment_not_found", "material_not_found", "by1_mismatch",
        "empty_form_code", "business_prefix_missing"}),
    ("variant_models", "status", {"ok", "empty", "unknown_type", "material_not_found"}),
    ("variant_design_parts", "role", {"valve", "other", "accessory", "spare_part"}),
    ("variant_design_parts", "status", {"valve", "unsupported", "excluded"}),
    ("variant_design_parts", "family", {"butterfly", "check", "gate", ""}),
    ("variant_specs", "nonstandard", {True, False}),
    ("variant_size_text", "pressure", {"", "16BAR", "10BAR", "PN16", "300PSI"}),
    ("variant_features", "connection", {
        "WAFER", "LUG_WAFER", "LUG", "GROOVED", "FLANGED", "THREADED", "UNKNOWN"}),
    ("variant_legacy_spec", "match_level", {
        "description_form", "description", *LEGACY_LEVELS.values()} - {"fuzzy_description"}),
]
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@here
@pytest.mark.parametrize("name", NAMES)
def test_variant_query(spark, name):
    assert compare(spark, duck(FOLDER), FOLDER, name, entry.queries(), entry.oracle_sql())


@here
@pytest.mark.parametrize("name,column,values", REACHED)
def test_branches_are_reached(name, column, values):
    found = duck(FOLDER).execute(
        f"SELECT DISTINCT {column} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert values <= {row[0] for row in found}
