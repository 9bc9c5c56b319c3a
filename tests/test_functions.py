"""Golden inputs and outputs of the column functions."""

import uuid

from pyspark.sql import functions as F

from orderlens.functions import codes as C
from orderlens.functions import sizes as S
from orderlens.functions import standardize as D
from orderlens.functions import text as T


def test_product_codes(spark):
    rows = [("LD71XLV99_D100_90FQ11L50", "D71XLV99", "D100", "Q11"),
            ("RDWLX_B80_922Q11R40", "DWLX", "B80", "Q11"),
            ("RXD381X_D100_91VQ11R40", "RXD381X", "D100", "Q11"),
            ("30103010012", "DB114", "B50", "B11"), (None, "A", "B", "C"),
            ("A_B_FC", "", "", "C"), ("XA_B_C", "A", "B", "C"), ("XYA_B_FC", "A", "B", "C")]
    df = spark.createDataFrame(rows, "code string, by1 string, spec string, material string")
    got = [r["p"] for r in df.select(C.parse_product_code(
        *map(F.col, df.columns)).alias("p")).collect()]
    assert [(p.status, p.business_prefix, p.form_code, p.surface) for p in got] == [
        ("ok", "L", "90F", "L50"), ("ok", "R", "922", "R40"), ("ok", "", "91V", "R40"),
        ("spec_segment_not_found", "", "", ""), ("missing_code", "", "", ""),
        ("spec_segment_not_found", "", "", ""), ("empty_form_code", "X", "", ""),
        ("business_prefix_missing", "", "F", "")]


def test_codes_with_odd_segments(spark):
    rows = [("XA__D50__F1Q1__S_", "A", "", "Q1"), ("__D50_F1Q1", "", "", "Q1"), ("__D50", "", "", "Q1"),
            ("D50_A_D50_FQ1", "A", "D50", "Q1"), ("A_D50", "A", "D50", "Q1"),
            ("A_D50_", "A", "D50", "Q1"), ("A_D_50_F", "A", "D_50", "F"),
            ("xa_d 50__f_q1_s_d50_", "a", "D50", "q 1"), ("ÉA_Ü1_FQ1", "A", "ü1", "Q1")]
    df = spark.createDataFrame(rows, "code string, by1 string, spec string, material string")
    got = [r["p"] for r in df.select(C.parse_product_code(
        *map(F.col, df.columns)).alias("p")).collect()]
    assert [(p.status, p.code_by1, p.specification, p.form_code, p.surface) for p in got] == [
        ("spec_segment_not_found", "", "", "", ""), ("by1_mismatch", "_", "D50", "F1", ""),
        ("spec_segment_not_found", "", "", "", ""), ("spec_segment_not_found", "", "", "", ""),
        ("spec_segment_not_found", "", "", "", ""), ("material_not_found", "A", "D50", "", ""),
        ("spec_segment_not_found", "", "", "", ""), ("ok", "XA", "D50", "F", "S_D50"),
        ("ok", "ÉA", "Ü1", "F", "")]
    specs = spark.createDataFrame([(x,) for x in (
        "d 50", "A100", "A10.50", "A1.00", "A0.0", "A5.", "A.5", None)], "s string")
    assert [r["p"] and tuple(r["p"]) for r in specs.select(
        C.parse_spec(F.col("s")).alias("p")).collect()] == [
        ("D", "50"), ("A", "100"), ("A", "10.5"), ("A", "1"), ("A", "0"), None, None, None]


def test_infer_size(spark):
    cases = [('DI WAFER BV, 4"/DN100', "100", "dn_size"),
             ("SUITABLE FOR DN50, DN65 AND DN80", "80", "suitable_range_max"),
             ('DI GROOVED BV, 4"/DN100', "114", "grooved_inch_to_od"),
             ('GROOVED BV, 21/2"/DN65', "76", "grooved_inch_to_od"),
             ('DI GRVD BV, 6"/165MM', "165", "grooved_explicit_mm"),
             ('DI GRVD BV, 3"/80MM', "89", "grooved_inch_to_od"),
             ("DI 80MM GRV END BV", None, None),
             ("DI GRVD BV DN100", "114", "grooved_dn_to_od"),
             ('3" BRZ BDY GRVD CTS BFV', "79", "grooved_cts_inch_to_od"),
             ("6 COP GRV BFV", "156", "grooved_cts_inch_to_od"),
             ('2 3/8" GRVD CTS', "64", "grooved_cts_inch_to_od"),
             ('GD48638N 2 1/2" GROOVE BUTTERFLY VALVE', "73", "grooved_product_inch_to_od"),
             ('GD48638N 2 1/2" GROOVE BUTTERFLY VALVE (76 mm)', "76", "grooved_explicit_mm"),
             ("VALVE 80.5MM", "81", "explicit_mm"), ("DN3000", None, None), ("NO SIZE", None, None)]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string")
    got = [r["s"] for r in df.select(S.infer_size(F.col("t")).alias("s")).collect()]
    assert [(s.size, s.rule) if s else (None, None) for s in got] == [c[1:] for c in cases]


def test_standardize(spark):
    text = "DI LUG WAFER BUTTERFLY VALVE EPDM SEAT SS316 DISC GEAR DN100 PN16"
    rows = [(text,), ("PTFE Gasket-WP 6",), ("DI WAFER BUTTERFLY VALVE GEAR DN100 PN16",),
            ('1 1/2"/DN40 BV',), ('2 1/2" BV',), ('4"/114MM LUG BV',), ("DIWAFERFIRERISERBV",)]
    got = D.with_views(spark.createDataFrame(rows, "t string"), "t").collect()
    assert got[0]["standardized"] == 'DI LUG WAFER BFV,EPDM SEAT,SS316 DISC,GEAR,4"/DN100,PN16'
    assert got[0]["semantic_text"] == "DI LUG WAFER BFV,EPDM SEAT,SS316 DISC,GEAR,PN16"
    assert got[1]["semantic_text"] == "PTFE GASKET WP 6"
    assert got[2]["seat"] == "" and "seat_material" not in got[2]["attributes"]
    # The mixed fraction in front of a DN loses its blank before parsing.
    assert [got[i]["size"] for i in (3, 4, 5, 6)] == ['5 1/2"/DN40', '2 1/2"/DN65', '4"/DN100', ""]
    assert got[6]["clean_text"] == "DI WAFER FIRE RISER BV"
    assert got[0]["attributes"]["connection"]["value"] == "LUG WAFER"


def test_model_decode(spark):
    df = spark.createDataFrame([("D371X4",), (" ",), ("??",), ("DH77X",), ("Q9",)], "m string")
    got = [r["p"] for r in df.select(C.decode_model(F.col("m")).alias("p")).collect()]
    assert got[0].standardizedProduct == "D371X" and got[0].type == "蝶阀"
    assert [p.status for p in got] == ["ok", "empty", "unknown_type", "ok", "material_not_found"]
    assert got[3].driveMode == "手动驱动" and got[3].form == "旋启式-蝶形止回"


def test_ids_and_prefixes(spark):
    row = spark.range(1).select(
        C.parent_id(F.lit("D371X4")).alias("a"), C.record_id(*map(F.lit, "abcd")).alias("b"),
        T.prefix_similarity(F.lit("D371X4"), F.lit("D371X7")).alias("c"),
        T.prefix_similarity(F.lit("D371X4"), F.lit("Q41F")).alias("d"),
        T.prefix_similarity(F.lit(""), F.lit("")).alias("e")).first()
    assert row.a == str(uuid.uuid5(uuid.NAMESPACE_DNS, "D371X4"))
    assert row.b == str(uuid.uuid5(uuid.NAMESPACE_URL, "a|b|c|d"))
    assert (row.c, row.d, row.e) == (5 / 6, 0.0, 0.0)
    assert C.versioned_name("t", "Build 1.0-B") == "t_build_1_0_b"


def test_context_and_text(spark):
    df = spark.createDataFrame([("ACME [SEP] DI LUG WAFER BV [SEP] D371X4", "Explicit Customer"),
                                ("ACME[sep]  ", ""), ("plain", None)], "q string, c string")
    got = [r["x"] for r in df.select(T.split_context(
        F.col("q"), F.col("c"), F.lit("")).alias("x")).collect()]
    assert tuple(got[0])[:3] == ("DI LUG WAFER BV", "Explicit Customer", "D371X4")
    assert got[1].status == "missing_description" and got[2].query == "plain"
    norm = spark.createDataFrame([("a_b--C  buna-n é",)], "t string").select(
        T.normalize_text(F.col("t")), T.normalize_code(F.col("t"))).first()
    assert tuple(norm) == ("A B C NBR É", "A_B--CBUNA-NÉ")
