"""Mixing, perspectives and Merkle trees in column functions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from orderlens.llm import chat, merkle, mixing


def lines(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["ACME"] * 6 + ["BOLT", None]), rng.choice(["Q1", "Q2", "Q3"]),
             rng.choice(["XD", "H"]), rng.randint(0, 30), "p") for i in range(3000)]
    data += [(None, "ACME", "Q1", "H", 4, "p"), (7, "ACME", "Q1", "H", None, "p"), (8, "X", "Y", "Z", -3, "p")]
    return spark.createDataFrame(data, "row_id long, customer string, form_code string, by1 string, tokens int, probability string")


def test_mix_reaches_the_margins(spark):
    margins = ["customer", "form_code", "by1"]
    got = mixing.mix(lines(spark), margins, share=0.4).cache()
    assert got.count() == 3003 and got.filter("kept AND coalesce(tokens, 0) <= 0").count() == 0
    total = got.filter("tokens > 0").agg(F.sum("tokens")).first()[0]
    for m in margins:
        rows = got.filter("tokens > 0").groupBy(F.coalesce(m, F.lit("")).alias("v")).agg(
            F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("kept")).collect()
        goal = {r["v"]: r["t"] ** 0.5 for r in rows}
        for r in rows:
            assert r["kept"] / (0.4 * total) == pytest.approx(goal[r["v"]] / sum(goal.values()), rel=1e-4)
    kept = got.filter("kept").agg(F.sum("tokens")).first()[0]
    assert kept == pytest.approx(0.4 * total, rel=0.1)


def test_mix_small_cells_and_no_rows(spark):
    rows = spark.createDataFrame([(i, "a" if i else "b", 10) for i in range(50)], "row_id long, customer string, tokens int")
    got = {r["customer"]: r["probability"] for r in mixing.mix(rows, ["customer"], share=0.9).collect()}
    assert got["b"] == 1 and got["a"] == pytest.approx((0.9 * 500 - 10) / 490, abs=1e-6)
    assert mixing.mix(rows.limit(0), ["customer"]).count() == 0


def test_perspectives(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be brief", 1), (1, 2, "bob", "hi ann", 1), (1, 1, "ann", "hello", 1), (1, 3, "cy", None, 1),
         (1, 2, "bob", "hi ann", 1), (2, 0, "system", "alone", 1), (3, None, None, "who", 1), (None, 1, "ann", "lost", 1)],
        "conv_id long, turn int, role string, text string, piece int")
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotated_dialogues(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (3, "unknown")}
    bob = got[1, "bob"]
    assert bob["text"] == ("<|system|>\nbe brief<|end|>\n<|user|>ann\nhello<|end|>\n" + 2 * "<|assistant|>\nhi ann<|end|>\n"
                           + "<|user|>cy\n<|end|>\n")
    assert [bob["text"][s["start"]:s["end"]] for s in bob["loss_spans"]] == ["hi ann<|end|>\n"] * 2
    assert bob["n_turns"] == 5 and got[1, "cy"]["text"].endswith("<|assistant|>\n<|end|>\n")
    assert chat.rotated_dialogues(turns.limit(0)).count() == 0


def test_long_dialogues_come_in_pieces(spark):
    turns = spark.range(500).selectExpr("9 AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role", "'x' AS text")
    got = chat.rotated_dialogues(turns, turns_per_piece=64).collect()
    assert len(got) == 16 and sum(r["n_turns"] for r in got) == 1000 and max(r["n_turns"] for r in got) == 64


def brute_print(text):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    sections, out = [], ""
    for section in text.split("\n\n"):
        parts, inner = [], ""
        for paragraph in section.split("\n"):
            clauses = re.split(r"(?<=[.,;:!?|]) ", paragraph)
            parts.append(md5("".join(map(md5, clauses))))
            inner += ";" + parts[-1][:8] + "".join(f",{md5(c)[:8]}.{len(c)}" for c in clauses)
        sections.append(md5("".join(parts)))
        out += "/" + sections[-1][:8] + inner
    return md5("".join(sections)) + out


def brute_likeness(a, b):
    one, two = (set(re.findall(r",([0-9a-f]{8}\.[0-9]+)", x)) for x in (a, b))
    size = lambda s: sum(int(c[9:]) for c in s)
    return size(one & two) / size(one | two) if size(one | two) else float(one == two)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_merkle_fingerprints(spark, parts):
    rng = random.Random(parts)
    texts = ["", None, "DI valve. EPDM seat, gear | lever\nPN16\n\nsecond section. ä🔧", "\n\n", "a. b", "long " * 9000]
    texts += [". ".join("".join(rng.choices("ab \n", k=9)) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    data = [(i * 13 % 37, t, "x") for i, t in enumerate(texts)] + [(5, "tie b", "x"), (5, "tie a", "x"), (5, "tie a", "x"), (None, "no id", "x")]
    rows = spark.createDataFrame(data, "row_id long, description string, fingerprint string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = merkle.description_fingerprints(rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    want = []
    for i, (row_id, text, _) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edit = text[:len(text) - half] + other[:half]
        own, new, following = map(brute_print, (text, edit, other))
        want.append((row_id, len(text), edit, own, new, brute_likeness(own, new), brute_likeness(own, following)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[4])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


def test_merkle_no_rows_and_one_row(spark):
    one = spark.createDataFrame([(1, "only. row")], "row_id long, description string")
    assert merkle.description_fingerprints(one).first()["near_next"] == 1
    assert merkle.description_fingerprints(one.limit(0)).count() == 0


def test_changed_paragraphs(spark):
    rows = spark.createDataFrame([("a\nb\n\nc", "a\nx\n\nc\nd"), ("a\nb", "a\nb"), ("a", None), ("a\n\nb", "a")],
                                 "old string, new string")
    rows = merkle.with_tree(merkle.with_tree(rows, "old", "t"), "new", "u")
    got = [[tuple(p) for p in r[0]] for r in rows.select(
        merkle.changed_paragraphs(F.col("t"), F.col("u"))).collect()]
    assert got == [[(0, 1), (1, 1)], [], [(0, 0)], [(1, 0)]]
