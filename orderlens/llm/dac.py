"""Token ids of descriptions as directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the low chunk of every id and a bit that says
whether more chunks follow; level 1 holds the next chunk of those ids, and so on. A rank directory
beside each bitmap counts the set bits before every block, so the place of an id's next chunk is
one look-up and the token at any position is read without decoding a block.
"""

from __future__ import annotations

import os
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rows import slices, written

MAGIC = b"DACTOK01"
CHUNK_BITS, BLOCK_BITS = 8, 512
SHARD_TOKENS = 1 << 20
CACHE_WORDS = 300_000
GROUP, TEXTS = 200, 256


def build(ids: np.ndarray, row_ids: list[int | None], sizes: list[int]) -> bytes:
    """A shard image: row ids, sizes and the levels of all ids, which follow each other by row."""
    rest = ids.astype(np.uint32)
    levels = []
    while True:
        more = rest >> CHUNK_BITS > 0
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more.astype(np.uint64), np.arange(0, max(len(more), 1), BLOCK_BITS)) \
            if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u8") if len(blocks) else \
            np.zeros(0, "<u8")
        chunk = (rest & 0xFF).astype(np.uint8)
        levels.append(struct.pack("<QQQ", len(chunk), len(bits), len(ranks)) + chunk.tobytes()
                      + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            break
    known = np.array([0 if r is None else r for r in row_ids], "<i8").tobytes()
    nulls = np.array([r is None for r in row_ids], np.uint8).tobytes()
    return b"".join([MAGIC, struct.pack("<QQQ", len(row_ids), len(ids), len(levels)), known, nulls,
                     np.array(sizes, "<u8").tobytes(), *levels])


class Reader:
    """Random access to the tokens of a shard image."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a token file")
        rows, self.tokens, count = struct.unpack_from("<QQQ", image, 8)
        at = 32
        known = np.frombuffer(image, "<i8", rows, at)
        nulls = np.frombuffer(image, np.uint8, rows, at + 8 * rows)
        self.row_ids = [None if n else int(r) for r, n in zip(known, nulls, strict=True)]
        self.sizes = np.frombuffer(image, "<u8", rows, at + 9 * rows).astype(np.int64)
        at += 17 * rows
        self.levels = []
        for _ in range(count):
            n, n_bits, n_ranks = struct.unpack_from("<QQQ", image, at)
            at += 24
            self.levels.append((np.frombuffer(image, np.uint8, n, at),
                                np.frombuffer(image, np.uint8, n_bits, at + n),
                                np.frombuffer(image, "<u8", n_ranks, at + n + n_bits)))
            at += n + n_bits + 8 * n_ranks

    def get(self, position: int) -> int:
        """The token at a position of the shard: one chunk a level, one rank look-up between."""
        if not 0 <= position < self.tokens:
            raise IndexError(position)
        value = shift = 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[position]) << shift
            shift += CHUNK_BITS
            if not bits[position >> 3] >> (position & 7) & 1:
                return value
            block = position // BLOCK_BITS
            first = block * BLOCK_BITS // 8
            inside = np.unpackbits(bits[first:(position >> 3) + 1], bitorder="little")
            position = int(ranks[block]) + int(inside[:position - block * BLOCK_BITS].sum())
        raise ValueError("the token file ends inside an id")

    def all(self) -> np.ndarray:
        """All ids of the shard, level by level from the last."""
        value = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            here = chunk.astype(np.uint32)
            here[np.unpackbits(bits, count=len(chunk), bitorder="little") == 1] |= \
                value << CHUNK_BITS
            value = here
        return value


class WordEncoder:
    """Ids of whole texts by the tokenizers library, every distinct word encoded once.

    The tokenizer must drop white space between words and mark the ends of its pre-tokens, so that
    a text's ids are those of its words one after another. Words of letters, with or without one
    comma or full stop behind them, are one or two pre-tokens; they are encoded many at a time and
    cut at the end marks. All other words go one by one. A text that holds a special token, or one
    of the controls that only Python takes for white space, is encoded as it is. Known words are
    kept in two generations: when the younger is full, words not met again are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tool = Tokenizer.from_file(path)
        self.odd = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.odd += ["\x1c", "\x1d", "\x1e", "\x1f"]
        vocabulary = self.tool.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tool.encode_batch_fast(words, add_special_tokens=False)]

    def _many(self, words: list[str], pieces: list[int]) -> list[bytes]:
        out = []
        places = range(0, len(words), GROUP)
        for i, coded in zip(places, self.tool.encode_batch_fast(
                [" ".join(words[i:i + GROUP]) for i in places], add_special_tokens=False),
                strict=True):
            raw = np.array(coded.ids, "<u4")
            last = np.cumsum(pieces[i:i + GROUP]) - 1
            stops = np.flatnonzero(self.ends[raw])
            if len(stops) != last[-1] + 1:
                out += self._one(words[i:i + GROUP])
                continue
            ends = (4 * (stops[last] + 1)).tolist()
            coded_bytes = raw.tobytes()
            out += [coded_bytes[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def learn(self, new: list[str]) -> None:
        plain, pieces, other = [], [], []
        for word in new:
            if word.isalpha():
                plain.append(word)
                pieces.append(1)
            elif word[-1] in ",." and word[:-1].isalpha():
                plain.append(word)
                pieces.append(2)
            else:
                other.append(word)
        self.words.update(zip(plain, self._many(plain, pieces), strict=True))
        self.words.update(zip(other, self._one(other), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [None if any(s in t for s in self.odd) else t.split() for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words, self.older = {}, self.words
        words, older = self.words, self.older
        missing = [w for w in set(chain.from_iterable(c for c in cut if c)) if w not in words]
        words.update((w, older[w]) for w in missing if w in older)
        if new := [w for w in missing if w not in words]:
            self.learn(new)
        return [np.array(self.tool.encode(t, add_special_tokens=False).ids, np.uint32)
                if c is None else np.frombuffer(b"".join([words[w] for w in c]), "<u4")
                for t, c in zip(texts, cut, strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file; a Python worker reads it once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_token_files(rows: DataFrame, path: str, tokenizer: str, end_id: int,
                      shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode description rows and write shard images to path in ascending row_id.

    rows: row_id (long), description; every description gets end_id appended, a null one counts as
    empty. Rows are range-partitioned by row_id (null first, equal ids by description) and encoded
    in that order; a shard is closed at shard_tokens ids, never inside a description. The files are
    Parquet files with one image a row (columns part, shard, tokens, image), so any store that
    Spark writes to can hold them.
    """
    def pack(batches):
        part = TaskContext.get().partitionId()
        held, ids, sizes, total, shard = [], [], [], 0, 0

        def close():
            image = build(np.concatenate(ids), held, sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()),
                 pa.array([total], pa.int64()), pa.array([image], pa.binary())],
                ["part", "shard", "tokens", "image"])

        encoder = word_encoder(tokenizer)
        for batch in slices(batches, TEXTS):
            texts = [t or "" for t in batch.column("description").to_pylist()]
            for row_id, coded in zip(batch.column("row_id").to_pylist(), encoder.encode(texts),
                                     strict=True):
                held.append(row_id)
                ids.append(np.append(coded, np.uint32(end_id)))
                sizes.append(len(ids[-1]))
                total += sizes[-1]
                if total >= shard_tokens:
                    yield close()
                    held, ids, sizes, total, shard = [], [], [], 0, shard + 1
        if held:
            yield close()

    (rows.select(F.col("row_id").cast("long").alias("row_id"), "description")
     .repartitionByRange("row_id").sortWithinPartitions("row_id", "description")
     .mapInArrow(pack, "part int, shard int, tokens long, image binary")
     .write.parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """row_id, start (ids of all rows before), n_tokens and token_ids from written files.

    token_ids are little-endian unsigned 32-bit ids. Starts come from the sizes noted beside the
    images: one sum per part, and a running sum over the parts, of which there are as many as
    writing tasks.
    """
    files = spark.read.schema("part int, shard int, tokens long, image binary").parquet(path)
    sizes = files.select("part", "shard", "tokens")
    whole = sizes.groupBy("part").agg(F.sum("tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = whole.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # Written first: as a small table it reaches the images without a shuffle of them.
    starts = written(sizes.join(parts, "part").select("part", "shard", (
        F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("first")), "starts")

    def unpack(batches):
        for batch in batches:
            for first, image in zip(batch.column("first").to_pylist(),
                                    batch.column("image").to_pylist(), strict=True):
                reader = Reader(image)
                ids, ends = reader.all().astype("<u4"), np.cumsum(reader.sizes)
                for i in range(0, len(ends), 1000):
                    low = ends[i:i + 1000] - reader.sizes[i:i + 1000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(reader.row_ids[i:i + 1000], pa.int64()), pa.array(low + first),
                        pa.array(reader.sizes[i:i + 1000]),
                        pa.array([ids[a:b].tobytes() for a, b in
                                  zip(low, ends[i:i + 1000], strict=True)], pa.binary())],
                        ["row_id", "start", "n_tokens", "token_ids"])

    return files.join(starts, ["part", "shard"]).select("first", "image").mapInArrow(
        unpack, "row_id long, start long, n_tokens long, token_ids binary")
