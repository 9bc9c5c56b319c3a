"""The corpus pipeline, stage by stage and as a whole, on planted documents."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from orderlens.llm.simhash import fingerprint_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def planted():
    rng = random.Random(21)
    known = [f"{a}{b}" for a in "valve seat disc iron gear wafer".split() for b in ("", "ed", "s", "ing")]
    word = lambda: rng.choice(known) + str(rng.randrange(300))
    shared = [word() for _ in range(60)]
    docs, junk, cut = {}, set(), {}
    for i in range(160):
        words = [word() for _ in range(rng.randint(60, 140))]
        if i % 8 == 0:
            words, _ = [w + "%%%" for w in words], junk.add(i)
        elif i in (3, 45, 77):
            at = rng.randrange(len(words))
            words[at:at] = shared
            if i != 3:
                cut[i] = words[:at] + words[at + 60:]
        docs[i] = " ".join(words)
    docs[200], docs[201] = docs[9], docs[10].upper()
    return docs, junk, cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, junk, _ = planted()
    root = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "de" if i % 3 else "en", "hot" if i % 2 else f"s{i % 5}", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i not in junk), 0) for i in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_and_run(spark, folder):
    docs, junk, cut = planted()
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5
    table = spark.read.parquet(f"{folder}/documents.parquet")

    first = stages[0](spark, table, folder).cache()
    assert {r["doc_id"] for r in first.collect()} == set(docs) - junk
    assert first.columns == table.columns

    second = stages[1](spark, first, folder).cache()
    kept, prints = set(), {}
    for i in sorted(set(docs) - junk):
        mark = fingerprint_of(docs[i])
        if not any((mark ^ p).bit_count() <= 2 for p in prints.values()):
            kept.add(i)
        prints[i] = mark
    assert {r["doc_id"] for r in second.collect()} == kept and not kept & {200, 201}

    third = stages[2](spark, second, folder).cache()
    got = {r["doc_id"]: r for r in third.collect()}
    assert set(got) == kept and third.columns == table.columns
    for i, r in got.items():
        assert r["text"].split() == (cut[i] if i in cut else docs[i].split())
        assert r["n_chars"] == len(r["text"])

    fourth = stages[3](spark, third, folder).cache()
    picked = {r["doc_id"]: r["text"] for r in fourth.collect()}
    assert fourth.columns == table.columns and all(picked[i] == got[i]["text"] for i in picked)
    assert 0.3 * len(kept) < len(picked) < 0.7 * len(kept)

    ranks = {base64.b64decode(a): int(b) for a, b in map(
        bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, text in picked.items():
        ids = tool.encode_ordinary(text)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest()))
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in stages[4](spark, fourth, folder).select(columns).collect()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).select(columns).collect()} == want


def test_stages_on_odd_rows(spark, folder):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (5, "valve seat", "en", "s", 10),
                                 (5, "valve seat", "en", "s", 10)], SCHEMA)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, folder).count() <= docs.count()


def test_near_copies_tell_texts_of_one_doc_id_apart(spark):
    rng = random.Random(3)
    one, two, three = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(3))
    docs = spark.createDataFrame([(5, one, "en", "s", 1), (3, one, "en", "s", 1), (5, two, "de", "s", 2),
                                  (5, two, "de", "s", 2), (None, three, "en", "s", 3)], SCHEMA)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(3, one, "en", "s", 1), (5, two, "de", "s", 2), (None, three, "en", "s", 3)], key=str)
