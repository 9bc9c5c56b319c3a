"""Cuts of the lineage are tables, parses run once, and fuzzy keys do not meet all records."""

from pyspark.sql import functions as F

from orderlens.checks import text_queries
from orderlens.checks.inputs import prepared
from orderlens.operators import fuzzy, rules
from orderlens.plans import scale
from orderlens.plans.jobs import embedded_children
from orderlens.plans.scale import cut_lineage
from orderlens.sources.orders import prepare_orders


def plan(df):
    return df._jdf.queryExecution().toString()


def test_cut_is_read_by_column(spark):
    cut = cut_lineage(spark.range(50).select("id", F.lit("x" * 100).alias("wide")))
    assert "ReadSchema: struct<id:bigint>" in plan(cut.select("id"))
    assert cut.agg(F.sum("id")).first()[0] == 1225


def test_children_do_not_parse_twice(spark):
    records = spark.createDataFrame(
        [("A", "F", "D50", "gate valve", "Gate", 2), ("A", "F", "D50", "", "Empty", 1)],
        "by1 string, form_code string, spec string, description string, example string, count long")
    children = embedded_children(records.withColumn("semantic_description", F.reverse("description")))
    assert "reverse(" not in plan(children)
    assert [r.description for r in children.collect()] == ["gate valve"]


def test_orders_normalise_their_codes_once(spark):
    names = ["row_id", "order_no", "product_code", "by1", "spec", "material", "description",
             "customer"]
    orders = spark.range(3).select(
        *[F.concat(F.lit(n), "id").alias(n) for n in names],
        F.when(F.col("id") < 2, F.expr("date_add(date'9999-12-31', int(id))")).alias("contract_date"))
    rows = prepare_orders(orders)
    optimized = rows._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count(r"(?U)\s+, ") == 4
    # The customer's name once, the description once.
    assert optimized.count("BUNA-N") == 2
    rows = rows.orderBy("row_id").collect()
    assert [str(r.date) for r in rows] == ["9999-12-31", "None", "None"]
    assert [len(r.customer_key) for r in rows] == [64, 64, 64]


def test_quarantine_is_cut_before_it_is_dealt(spark, monkeypatch):
    dealt = []
    rank = scale.ordered_rank
    monkeypatch.setattr(scale, "ordered_rank", lambda df, *a: dealt.append(plan(df)) or rank(df, *a))
    text_queries.dictionary_bundle(spark, "/root/testdata/sf0.001")
    assert len(dealt) == 1 and "transform(" not in dealt[0]


def test_view_and_parse_are_two_stages(spark):
    assert "RepartitionByExpression" in plan(prepared(spark, "/root/testdata/sf0.001"))


def test_rules_count_by_window(spark):
    rows = spark.createDataFrame(
        [("A", d) for d in ("1997-01-01", "1998-12-31", "1999-01-01", "2000-06-30", "2000-07-01",
                            None)], "by1 string, day string").withColumn("date", F.to_date("day"))
    counts = rules.counts_by_window(rows, ["by1"], "1998-12-31", "2000-06-30")
    assert {(r.by1, str(r.date), r.n) for r in counts.collect()} == {
        ("A", "1998-12-31", 2), ("A", "2000-06-30", 2)}


def test_fuzzy_customer_and_form_raise_their_records(spark, monkeypatch):
    records = spark.createDataFrame(
        [("GATE VALVE RED", "F1", "A50", 1, "a"), ("GATE VALVE RED", "F2", "B50", 1, "b"),
         ("GATE VALVE RED", "F3", "C50", 1, "c")],
        "description string, form_code string, spec string, count long, example string")
    customers = spark.createDataFrame([("GATE VALVE RED", "F3", "C50", "k1")],
                                      "description string, form_code string, spec string, "
                                      "customer_key string")
    keys = spark.createDataFrame(
        [("Gate valve blue", "GATE VALVE BLUE", f, c) for f in ("F2", "F9")
         for c in ("", "k1", "k2")],
        "query string, description string, form_code string, customer_key string")
    met = []
    best = fuzzy._best_of_spec
    monkeypatch.setattr(fuzzy, "_best_of_spec",
                        lambda pairs, *a: met.append(pairs.count()) or best(pairs, *a))
    rows = {(r.form_code, r.customer_key): [x.value for x in r.alternatives]
            for r in fuzzy.fuzzy_answers(keys, records, customers).collect()}
    assert rows == {("F2", ""): ["B50", "A50", "C50"], ("F2", "k2"): ["B50", "A50", "C50"],
                    ("F2", "k1"): ["B50", "C50", "A50"], ("F9", ""): ["A50", "B50", "C50"],
                    ("F9", "k2"): ["A50", "B50", "C50"], ("F9", "k1"): ["C50", "A50", "B50"]}
    # 3 records of the text, 1 of the form F2, 1 of the customer for two keys; not 6 x 3 pairs.
    assert met == [3, 1, 2]
