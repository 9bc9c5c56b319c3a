"""Large inputs go slice by slice, shuffle files go with each, and lists are never broadcast."""

import pytest
from pyspark.sql import functions as F

from orderlens.checks import inputs
from orderlens.operators import evidence, fuzzy, history, publish
from orderlens.plans import scale
from orderlens.sources.orders import prepare_orders
from orderlens.streaming import jobs as streaming


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def star(spark, tmp_path):
    """A few order lines; keys repeat and are null."""
    for name, rows, kinds in (
            ("customer", [(i, f"C{i % 2}") for i in range(4)], "c_custkey long, c_name string"),
            ("part", [(i, f"Brand#{i % 3}", "LARGE", i) for i in range(6)],
             "p_partkey long, p_brand string, p_type string, p_size int"),
            ("orders", [(i, i % 4) for i in [*range(9), 8]], "o_orderkey long, o_custkey long"),
            ("lineitem", [(o if o < 9 else None, n, (o + n) % 6, o, 2.0)
                          for o in range(10) for n in (1, 2, 2)],
             "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")):
        df = spark.createDataFrame(rows, kinds)
        if name == "orders":
            df = df.withColumn("o_orderdate", F.expr("timestamp'1999-01-01' + make_interval(0, int(o_orderkey))"))
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def order_rows(spark, n=60):
    """Prepared rows of some texts, forms and customers."""
    i = F.col("id")
    return prepare_orders(spark.range(n).select(
        i.cast("string").alias("row_id"), F.lit("1999-01-01").alias("contract_date"),
        i.cast("string").alias("order_no"), F.concat(F.lit("AB"), i % 3, F.lit("_D50_F"), i % 2,
                                                     F.lit("Q1R1")).alias("product_code"),
        F.concat(F.lit("B"), i % 3).alias("by1"), F.lit("D50").alias("spec"),
        F.lit("Q1").alias("material"), F.concat(F.lit("VALVE "), i % 5).alias("description"),
        F.concat(F.lit("C"), i % 4).alias("customer")))


def test_order_lines_in_slices(spark, star, monkeypatch):
    whole = rows_of(inputs.prepared(spark, star))
    written = []
    keep = scale.write_parts
    monkeypatch.setattr(scale, "SLICE_BYTES", 100)
    monkeypatch.setattr(inputs, "write_parts", lambda parts, path: (
        written.append(len(parts)), keep(parts, path)))
    assert rows_of(inputs.stored(spark, star)) == whole and len(whole) == 30
    assert written[0] > 1
    narrow = inputs.needed(spark, star, "row_id", "by1")
    assert narrow.columns == ["row_id", "by1"] and narrow.count() == 30


def test_lines_are_dealt_before_their_strings_are_made(spark, star):
    text = inputs.prepared(spark, star)._jdf.queryExecution().optimizedPlan().toString()
    wide = [x for x in text.split("\n") if "RepartitionByExpression" in x]
    assert len(wide) == 1 and "l_orderkey" in wide[0]


def test_evidence_in_slices(spark, monkeypatch, tmp_path):
    rows = scale.cut_lineage(order_rows(spark))
    keys = rows.select(F.col("raw_description").alias("query"), "description", "form_code",
                       "customer_key").distinct()

    def results(path):
        index = evidence.evidence_index(rows, "by1", buckets=3)
        publish.write_lookup(index, f"{tmp_path}/{path}", evidence.KEYS, 3)
        publish.write_table(history.record_counters(rows), f"{tmp_path}/{path}-c",
                            sort_by=history.RECORD_KEY)
        stored = publish.read_lookup(spark, f"{tmp_path}/{path}")
        return [rows_of(x) for x in (
            evidence.evidence_rows(stored), evidence.exact_hits(keys, index, 5),
            evidence.exact_hits(keys, stored, 5),
            scale.in_slices(history.evidence_levels(rows, "spec"), ["description", "value"]),
            spark.read.parquet(f"{tmp_path}/{path}-c"))], stored

    whole, _ = results("whole")
    monkeypatch.setattr(scale, "SLICE_BYTES", 2_000)
    assert scale.slices_of(evidence.evidence_index(rows, "by1")) > 2
    sliced, stored = results("sliced")
    assert sliced == whole and all(whole)
    # One file a bucket, and a stored index is met as it lies.
    names = [f.rsplit("/", 1)[1] for f in stored.inputFiles()]
    buckets = [n.split("_")[1].split(".")[0] for n in names]
    assert len(buckets) == len(set(buckets)) and scale.slices_of(stored) == 1


def test_slices_reach_the_inputs(spark):
    rows = scale.cut_lineage(order_rows(spark))
    for df, by in ((evidence.evidence_index(rows, "by1"), ["description"]),
                   (history.evidence_levels(rows, "by1"), ["description", "value"]),
                   (history.record_counters(rows), history.RECORD_KEY)):
        plan = scale.slices(df, by, 3)[0]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("xxhash64") == 1
        assert plan.rindex("Aggregate") < plan.index("xxhash64")


def test_shuffle_files_go_with_the_tables_they_made(spark, star, tmp_path, monkeypatch):
    seen = []
    keep = scale.shuffles_removed
    table = spark.range(8).groupBy((F.col("id") % 2).alias("k")).agg(F.count("*").alias("n"))

    def watch(s):
        seen.append(1)
        return keep(s)

    monkeypatch.setattr(scale, "shuffles_removed", watch)
    monkeypatch.setattr(publish, "shuffles_removed", watch)
    monkeypatch.setattr(streaming, "shuffles_removed", watch)
    inputs.needed(spark, star, "by1")
    publish.write_lookup(table, f"{tmp_path}/l", ["k"], 2)
    publish.write_table(table, f"{tmp_path}/t", sort_by=["k"])
    assert len(seen) == 3


def test_cuts_of_a_batch_go_with_it(spark, tmp_path):
    import os
    before = scale.cut_lineage(spark.range(3))
    with scale.passing_cuts(spark):
        inside = scale.cut_lineage(spark.range(4))
        files = [f.removeprefix("file://") for f in inside.inputFiles()]
        assert files and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files)) and before.count() == 3


def test_fuzzy_lists_are_not_broadcast_nor_records_of_all_texts_kept(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(fuzzy, "cut_lineage", lambda df: cuts.append(df) or scale.cut_lineage(df))
    records = spark.createDataFrame(
        [("gate valve dn50", f"F{i}", "D50", 1 + i % 7, f"e{i}") for i in range(40)],
        "description string, form_code string, spec string, count long, example string")
    customers = records.select("description", "form_code", "spec", F.lit("c").alias("customer_key"))
    keys = spark.createDataFrame([("Gate valve lug DN50", "gate valve lug dn50", "F3", "c")],
                                 "query string, description string, form_code string, customer_key string")
    answer = fuzzy.fuzzy_answers(keys, records, customers).collect()
    assert [(r.alternatives[0]["value"], r.support) for r in answer] == [("D50", 4)]
    assert not [c for c in cuts if {"qid", "record_form"} <= set(c.columns)]
    ranked = next(c for c in cuts if "ranked" in c.columns)
    joins = [x for x in ranked._jdf.queryExecution().sparkPlan().toString().split("\n")
             if "Join" in x]
    assert all("SortMergeJoin" in x for x in joins[:2])
