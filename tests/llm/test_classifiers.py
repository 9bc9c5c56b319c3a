"""Held-out accuracy and odd rows of the quality and toxicity classifiers on order descriptions."""

import random

import pytest

from orderlens.llm import quality, toxicity

GOOD = "ductile iron wafer butterfly valve epdm seat gear operated flanged check swing disc".split()
INSULTS = ["rustbucket", "scrapheap"]


def described(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(GOOD) + rng.choice(["", "", "s", "ed"]) for _ in range(rng.randint(8, 40))]
        poor, toxic = i % 3 == 0, i % 4 == 0
        if poor:
            words = [w + "###" for w in words] if i % 2 else [w for w in words[:6] for _ in range(5)]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), "de" if i % 5 else "en", int(not poor), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(described(600, 1),
                                 "row_id long, description string, lang string, good int, toxic int")


def split(orders, column):
    learned = orders.filter("row_id % 4 <> 1").selectExpr("row_id", f"{column} AS label")
    return learned, orders.filter("row_id % 4 = 1")


def test_quality_held_out(orders):
    labels, held = split(orders, "good")
    model = quality.fit_quality(orders, labels, per_label=150, buckets=1 << 14)
    got = quality.score_quality(held, model).collect()
    assert len(got) == held.count()
    assert sum(r["predicted"] == r["good"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_held_out(orders):
    labels = orders.filter("row_id % 3 <> 1").selectExpr("row_id", "toxic AS label")
    model = toxicity.fit_toxicity(orders, labels, per_label=200, buckets=1 << 14)
    got = toxicity.score_toxicity(orders.filter("row_id % 3 = 1"), model).collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)
    one = got[0]
    assert abs(one["score"] - model.score(one["description"])) < 1e-5


def test_odd_rows_and_clashing_columns(spark, orders):
    labels, _ = split(orders, "good")
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (7, 9)],
                                                      labels.schema))
    rows = spark.createDataFrame(
        [(1, None, None, "x"), (2, "", "zz", "x"), (2, "", "zz", "x"), (None, "valve " * 50_000, "en", "x")],
        "row_id long, description string, lang string, score string")
    model = quality.fit_quality(orders, labels, per_label=50, buckets=1 << 12)
    got = quality.score_quality(rows, model).collect()
    empty = 1 / (1 + pow(2.718281828459045, -model.folded()[1]))
    assert [r["score"] for r in got[:3]] == pytest.approx([empty] * 3) and len(got) == 4
    conv = toxicity.fit_toxicity(orders, labels, per_label=50, buckets=1 << 12)
    got = toxicity.score_toxicity(rows, conv).collect()
    assert [r["score"] for r in got[:3]] == pytest.approx([conv.score("")] * 3, abs=1e-6)
    assert all(isinstance(r["flagged"], bool) for r in got) and len(got) == 4


def test_empty_tables(spark, orders):
    none = orders.limit(0)
    labels = none.selectExpr("row_id", "good AS label")
    model = quality.fit_quality(orders, labels, buckets=1 << 10)
    assert {r["score"] for r in quality.score_quality(orders, model).collect()} == {0.5}
    assert quality.score_quality(none, model).count() == 0
    conv = toxicity.fit_toxicity(orders, labels, buckets=1 << 10)
    assert {r["score"] for r in toxicity.score_toxicity(orders, conv).collect()} == {0.5}
    assert toxicity.score_toxicity(none, conv).count() == 0


def test_language_thresholds():
    model = toxicity.ConvClassifier.fit([], [], buckets=16)
    model.calibrate(["a"] * 8 + ["b"] * 2, [.9, .8, .7, .6, .2, .1, .1, .1, .4, .3],
                    [1, 1, 1, 1, 0, 0, 0, 0, 1, 0], least=4)
    assert model.thresholds == {"a": pytest.approx(0.4)}
    assert model.default_threshold == pytest.approx(0.35)
    assert toxicity.best_threshold([.2], [0]) == 0.5
