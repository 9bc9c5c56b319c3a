"""Byte-level BPE of descriptions through a sentencepiece model serialised from the vocabulary.

The vocabulary file lists byte strings with ranks. Every byte becomes one printable character, the
pieces are scored by their negative rank and the text is not normalised, so sentencepiece merges
just what the ranks say. Texts are cut by the pre-token pattern first and every pre-token is
encoded by itself. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import slices

CACHE_TOKENS = 200_000
TEXTS = 256


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(lines: bytes) -> list[bytes]:
    """Byte strings by rank from a vocabulary of base64 and rank a line; ranks are 0 to n - 1."""
    pairs = [line.split() for line in lines.splitlines() if line.strip()]
    ranks = {int(rank): base64.b64decode(word) for word, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks of the vocabulary have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def serialise_model(words: list[bytes]) -> bytes:
    """A sentencepiece model file: the unknown piece, then one piece a rank."""
    letters = byte_characters()
    pieces = [_message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02")]
    for rank, word in enumerate(words):
        text = "".join(letters[b] for b in word).encode()
        pieces.append(_message(1, _message(1, text) + b"\x15" + struct.pack("<f", -float(rank))
                               + b"\x18\x01"))
    trainer = _message(2, b"\x18\x02")  # model_type BPE
    normalizer = _message(3, _message(1, b"identity") + b"\x18\x00" + b"\x20\x00" + b"\x28\x00")
    return b"".join(pieces) + trainer + normalizer


class Codec:
    """Encoder and decoder of one vocabulary; ids are the ranks."""

    def __init__(self, words: list[bytes], pattern: str):
        self.words = words
        self.cut = regex.compile(pattern)
        letters = byte_characters()
        self.letters = {b: letters[b] for b in range(256)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(words))
        # Tokens that no chain of merges reaches are still ids of a pre-token equal to them.
        self.whole = {}
        texts = [self.mapped(w) for w in words]
        for rank, ids in enumerate(self.model.encode(texts, num_threads=1)):
            if ids != [rank + 1]:
                self.whole[words[rank]] = rank
        self.known: dict[str, bytes] = {}
        sizes = np.array([len(w) for w in words], np.int64)
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.sizes = sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(words) else sizes

    def mapped(self, word: bytes) -> str:
        return word.decode("latin-1").translate(self.letters)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        cut = [self.cut.findall(t) for t in texts]
        known = self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
        new = [p for p in dict.fromkeys(p for parts in cut for p in parts) if p not in known]
        raw = [p.encode() for p in new]
        for p, w, ids in zip(new, raw, self.model.encode([self.mapped(w) for w in raw],
                                                         num_threads=1), strict=True):
            known[p] = struct.pack("<I", self.whole[w]) if w in self.whole else \
                (np.array(ids, "<u4") - 1).astype("<u4").tobytes()
        return [b"".join([known[p] for p in parts]) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian 32-bit ids by the inverse mapping."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        if not len(at):
            return b""
        place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) \
            + np.repeat(self.starts[at], sizes)
        return self.blob[place].tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file; a Python worker builds it once."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(Path(path).read_bytes()), pattern)
    return _CODECS[key]


def encode_descriptions(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """All columns of description rows with token_ids and n_tokens.

    vocabulary: path of a file of base64 words and ranks on every executor; pattern: regular
    expression of the pre-tokens. token_ids are little-endian unsigned 32-bit ids. A null or empty
    description has no tokens. Columns named token_ids or n_tokens are replaced. One pass, no
    shuffle; a text longer than a batch is encoded whole.
    """
    kept = rows.drop("token_ids", "n_tokens")

    def encode(batches):
        tool = codec(vocabulary, pattern)
        for batch in slices(batches, TEXTS):
            texts = [t or "" for t in batch.column("description").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tool.encode(texts), pa.binary())],
                [*batch.schema.names, "token_ids"])

    return kept.mapInArrow(encode, _schema(kept, "token_ids binary")).withColumn(
        "n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


def decode_tokens(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """All columns with decoded, the bytes of token_ids (null for null ids)."""
    kept = encoded.drop("decoded")

    def decode(batches):
        tool = codec(vocabulary, pattern)
        for batch in slices(batches, TEXTS):
            found = [None if ids is None else tool.decode(ids)
                     for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())],
                                             [*batch.schema.names, "decoded"])

    return kept.mapInArrow(decode, _schema(kept, "decoded binary"))


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])
