"""Quality of descriptions by supervised subword embeddings.

Hashed vectors of words and of character n-grams are learned together with a softmax output by
stochastic gradient descent in numpy. A description is the mean of the vectors of its words, their
n-grams and one mark for every word that repeats the word before it. As mean and output are linear, scoring folds every vector with the output weights into
one number per bucket, so the table that travels to the executors has a fixed size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import labelled_sample, slices

CACHE_WORDS = 150_000
TEXTS = 256
REPEAT_MARK = b"<repeated word>"


def features(word: str, buckets: int, shortest: int, longest: int) -> list[int]:
    """Buckets of a word and of its character n-grams between word marks."""
    marked = f"<{word}>"
    ids = [zlib.crc32(marked.encode("utf-8", "surrogatepass")) % buckets]
    for n in range(shortest, longest + 1):
        ids += [zlib.crc32(marked[i:i + n].encode("utf-8", "surrogatepass"), n) % buckets
                for i in range(len(marked) - n + 1)]
    return ids


def repeats(words: list[str]) -> int:
    return sum(map(eq, words, words[1:]))


@dataclass
class SubwordClassifier:
    """Learned vectors (buckets x dim), output weights (2 x dim) and output bias (2)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    shortest: int = 3
    longest: int = 5

    @classmethod
    def fit(cls, descriptions: list[str], labels: list[int], prior: float = 0.5, dim: int = 8,
            buckets: int = 1 << 17, epochs: int = 4, rate: float = 1.0, seed: int = 7,
            shortest: int = 3, longest: int = 5) -> SubwordClassifier:
        """Stochastic gradient descent, one description a step, the rate falling to zero.

        prior: share of label 1 among all labelled rows; the sample may hold another share, so
        the output bias is moved by the difference. Without rows the score is 0.5.
        """
        rng = np.random.default_rng(seed)
        model = cls(((rng.random((buckets, dim)) - 0.5) / dim).astype(np.float32),
                    np.zeros((2, dim), np.float32), np.zeros(2, np.float32), shortest, longest)
        bags, known = [], {}
        for text in descriptions:
            words = (text or "").lower().split()
            for word in [w for w in set(words) if w not in known]:
                known[word] = np.array(features(word, buckets, shortest, longest))
            marks = np.full(repeats(words), zlib.crc32(REPEAT_MARK) % buckets)
            ids, times = np.unique(np.concatenate([marks, *(known[w] for w in words)]),
                                   return_counts=True)
            bags.append((ids.astype(np.int64), (times / max(times.sum(), 1)).astype(np.float32)))
        steps, done = max(1, epochs * len(bags)), 0
        for _ in range(epochs):
            for k in rng.permutation(len(bags)):
                ids, parts = bags[k]
                speed = np.float32(rate * (1 - done / steps))
                done += 1
                rows = model.vectors[ids]
                mean = parts @ rows
                raw = model.weights @ mean + model.bias
                share = np.exp(raw - raw.max())
                error = (share / share.sum()).astype(np.float32)
                error[labels[k]] -= 1
                back = error @ model.weights
                model.weights -= speed * np.outer(error, mean)
                model.bias -= np.float32(0.1) * speed * error
                pull = (speed * np.float32(len(ids) ** 0.5)) * back
                model.vectors[ids] = rows - parts[:, None] * pull
        ones = sum(labels)
        if 0 < ones < len(labels) and 0 < prior < 1:
            model.bias[1] += np.log(prior / (1 - prior)) - np.log(ones / (len(labels) - ones))
        return model

    def folded(self) -> tuple[np.ndarray, float]:
        """Log odds each bucket adds per unit of the mean, and the odds of an empty text."""
        return (self.vectors @ (self.weights[1] - self.weights[0]),
                float(self.bias[1] - self.bias[0]))


def fit_quality(rows: DataFrame, labels: DataFrame, per_label: int = 2000,
                max_chars: int = 60_000, **settings) -> SubwordClassifier:
    """Learn the quality of description rows.

    rows: row_id, description; labels: row_id, label (1 good, 0 poor). The model is fitted on at
    most per_label rows of each label with at most max_chars characters (labelled_sample); only
    these come to the driver. Null descriptions count as empty texts.
    """
    picked = sorted((r["row_id"], r["description"] or "", r["label"])
                    for r in labelled_sample(rows, labels, per_label, max_chars)
                    .select("row_id", "description", "label").collect())
    share = labels.filter(F.col("label").isin(0, 1)).agg(F.avg("label").alias("share")).first()
    return SubwordClassifier.fit([p[1] for p in picked], [p[2] for p in picked],
                                 share["share"] if share["share"] is not None else 0.5, **settings)


def score_quality(rows: DataFrame, model: SubwordClassifier, threshold: float = 0.7) -> DataFrame:
    """All columns of description rows with score (probability of good) and predicted (0 or 1).

    Whole descriptions are scored in one pass without a shuffle; a null or empty description gets
    the odds of the output bias. Columns named score or predicted are replaced.
    """
    kept = rows.drop("score", "predicted")
    table, base = model.folded()
    shared = kept.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    shortest, longest = model.shortest, model.longest

    def score(batches):
        odds = shared.value.astype(np.float64).tolist()
        size = len(odds)
        mark = odds[zlib.crc32(REPEAT_MARK) % size]
        known: dict[str, tuple[float, int]] = {}
        for batch in slices(batches, TEXTS):
            out = np.full(batch.num_rows, base)
            for i, text in enumerate(batch.column("description").to_pylist()):
                words = (text or "").lower().split()
                n = repeats(words)
                total = n * mark
                for word, times in Counter(words).items():
                    entry = known.get(word)
                    if entry is None:
                        ids = features(word, size, shortest, longest)
                        entry = (sum(odds[j] for j in ids), len(ids))
                        if len(word) <= 64:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            known[word] = entry
                    total += times * entry[0]
                    n += times * entry[1]
                if n:
                    out[i] += total / n
            scores = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(score, ", ".join([*names, "score double", "predicted int"]))
