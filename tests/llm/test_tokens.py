"""Byte BPE and directly addressable token files against the tokenizer libraries."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from orderlens.llm import bytebpe, dac

ODD = ["", " ", "DI LUG WAFER BV, EPDM SEAT, 4\"/DN100", "naïve café Ünïcode ß İstanbul ΣΊΣΥΦΟΣ",
       "a\x00b \x1f c\x1cd\x85e", "日本語の弁 🚰🔧", "don't I'LL x.y 3,14 !!!  \n\n\t tail ",
       "<|endoftext|> valve <|startoftext|>", "w" * 30_000, "valve, " * 4_000, "각 K Å ﬁne"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    alphabet = "abc ,.'é弁\n 12"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 90))) for _ in range(80)]
    data = [(i * 7 % 101 - 40, t, "old") for i, t in enumerate(texts)] + [(None, None, "n"), (3, None, "n"), (3, "b", "n"), (3, "b", "n")]
    return spark.createDataFrame(data, "row_id long, description string, token_ids string")


def test_byte_bpe_equals_tiktoken(rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})
    terms = (path, public_tokenizers.PATTERN)
    got = bytebpe.decode_tokens(bytebpe.encode_descriptions(rows, *terms), *terms).collect()
    assert len(got) == rows.count()
    for r in got:
        text = r["description"] or ""
        ids = np.frombuffer(r["token_ids"], "<u4").tolist()
        assert ids == want.encode_ordinary(text) and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == text.encode()
    assert bytebpe.encode_descriptions(rows.limit(0), *terms).count() == 0


def test_every_vocabulary_word_is_its_own_id():
    words = bytebpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    tool = bytebpe.Codec(words, public_tokenizers.PATTERN)
    assert tool.decode(np.arange(len(words), dtype="<u4").tobytes()) == b"".join(words)
    with pytest.raises(ValueError, match="gaps"):
        bytebpe.read_ranks(b"YQ== 0\nYg== 2\n")


def test_token_files(spark, rows, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    dac.write_token_files(rows, f"{tmp_path}/tokens", path, 2, shard_tokens=500)
    got = dac.read_token_files(spark, f"{tmp_path}/tokens").collect()
    order = sorted((r["row_id"] is not None, r["row_id"] or 0, r["description"] is not None,
                    r["description"] or "") for r in rows.collect())
    start, want = 0, []
    for known, row_id, _, text in order:
        ids = [*tool.encode(text, add_special_tokens=False).ids, 2]
        want.append((row_id if known else None, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    images = spark.read.parquet(f"{tmp_path}/tokens").orderBy("part", "shard").collect()
    assert len(images) > 3
    ids = np.concatenate([np.frombuffer(w[3], "<u4") for w in want])
    at = 0
    for r in images:
        reader = dac.Reader(bytes(r["image"]))
        for i in range(0, reader.tokens, 37):
            assert reader.get(i) == ids[at + i]
        at += reader.tokens
    assert at == len(ids)


def test_no_rows(spark, rows, tmp_path):
    dac.write_token_files(rows.limit(0), f"{tmp_path}/none",
                          public_tokenizers.path("word_bpe_49k.json"), 2)
    assert dac.read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_levels_hold_any_id():
    rng = np.random.default_rng(0)
    ids = (rng.integers(0, 2 ** 32, 5_000) >> rng.integers(0, 32, 5_000)).astype(np.uint32)
    reader = dac.Reader(dac.build(ids, [None, 4], [4_000, 1_000]))
    assert (reader.all() == ids).all() and reader.row_ids == [None, 4]
    assert [reader.get(i) for i in range(0, 5_000, 11)] == ids[::11].tolist()
    with pytest.raises(IndexError):
        reader.get(5_000)
    with pytest.raises(ValueError, match="not a token file"):
        dac.Reader(b"something else")
