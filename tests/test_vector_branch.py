"""Stored vectors, worker models, reranker documents and the vector branch of recommendation."""

import os

import pytest

import __spark_entry__ as entry

from compare import compare, duck
from orderlens.operators import vectors as V

FOLDER = "/root/testdata/sf0.001"


# Lambdas travel to the workers by value; this module is not there.
lengths = lambda texts: [[float(len(t)), 1.0] for t in texts]
refuses = lambda texts: 1 / 0


def test_only_unseen_texts_are_embedded(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, None)], "id int, text string")
    embed = V.batch_embedder(lengths)
    first = V.stored_vectors(rows, "text", path, embed, 2, "m1")
    assert {r.id: r.vector for r in first.collect()} == {
        1: [1.0, 1.0], 2: [2.0, 1.0], 3: [2.0, 1.0], 4: [0.0, 1.0]}
    again = V.stored_vectors(rows, "text", path, V.batch_embedder(refuses), 2, "m1")
    assert again.filter("vector is not null").count() == 4
    more = rows.unionByName(spark.createDataFrame([(5, "ccc")], rows.schema))
    grown = V.stored_vectors(more, "text", path, embed, 2, "m1")
    assert grown.count() == 5
    assert spark.read.parquet(f"{path}/model=m1").count() == 4
    other = V.stored_vectors(rows, "text", path, embed, 2, "m2")
    assert other.count() == 4 and spark.read.parquet(f"{path}/model=m2").count() == 3


def test_vector_of_another_size_fails_and_stores_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="dim mismatch"):
        V.stored_vectors(rows, "text", str(tmp_path), V.batch_embedder(lengths), 3, "m").collect()
    good = V.stored_vectors(rows, "text", str(tmp_path), V.batch_embedder(lengths), 2, "m")
    assert good.first().vector == [1.0, 1.0]


def test_a_worker_loads_a_model_once():
    calls = []

    def load():
        calls.append(1)
        return lengths

    assert V.worker_model("once", load) is V.worker_model("once", load)
    assert len(calls) == 1
    with pytest.raises(ValueError):
        V.batch_embedder()


def test_documents_leave_out_blank_texts(spark):
    candidates = spark.createDataFrame(
        [("r", "V1", [" a ", "", "b"]), ("r", "V2", [None, " "])],
        "request_id string, by1 string, matched_descriptions array<string>")
    asked = spark.createDataFrame([("r", " q ", "")], "request_id string, query string, form_code string")
    got = {r.by1: (r.rerank_query, r.document)
           for r in V.rerank_documents(candidates, asked).collect()}
    assert got == {"V1": ("q", "V1: a | b"), "V2": ("q", "V2:")}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", ["recommend_vector", "stored_vectors"])
def test_query(spark, name):
    assert compare(spark, duck(FOLDER), FOLDER, name, entry.queries(), entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
def test_all_branches_answer():
    levels = duck(FOLDER).execute(
        f"SELECT DISTINCT by1_match_level FROM ({entry.oracle_sql()['recommend_vector']})").fetchall()
    assert {"description_form_code", "vector_full_index", "vector_reranked"} <= {x for x, in levels}
