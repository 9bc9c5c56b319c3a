"""Rows without ids and columns of the caller that share a name with an inner column."""

from pyspark.sql import functions as F

from orderlens.llm import lattice, merkle, mixing, passages


def test_lattice_rows_without_id(spark):
    near = [1.0, 0.01, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] * 2
    far = [0.0] * 8 + [1.0] * 8
    rows = [(1, near), (None, near), (2, [x + 0.001 for x in near]), (None, far), (3, far), (4, None)]
    got = lattice.lattice_links(spark.createDataFrame(rows, "point_id long, vector array<double>")).collect()
    assert sorted((r["point_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, 0, True), (0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_cuts_keep_a_column_of_that_name(spark):
    rows = spark.createDataFrame([(1, "a b c d", "mine"), (2, "x", "yours")], "row_id long, description string, _cuts string")
    spans = spark.createDataFrame([(1, 1, 3)], "row_id long, start int, stop int")
    got = {r["row_id"]: (r["description"].split(), r["_cuts"]) for r in passages.without_passages(rows, spans).collect()}
    assert got == {1: (["a", "d"], "mine"), 2: (["x"], "yours")}


def test_mixing_and_trees_keep_columns_of_inner_names(spark):
    rows = spark.createDataFrame([(1, "s", 5, "kept", 7), (2, "t", 9, "too", 8)],
                                 "row_id long, source string, tokens int, _source string, _tokens int")
    got = mixing.mix(rows, ["source"]).orderBy("row_id").collect()
    assert [(r["_source"], r["_tokens"]) for r in got] == [("kept", 7), ("too", 8)]
    tree = merkle.with_tree(rows.withColumn("_level", F.lit("own")), "source", "tree").first()
    assert tree["_level"] == "own" and tree["tree"]["root"]
