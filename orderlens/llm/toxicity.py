"""Toxic descriptions by a small convolutional text classifier trained in numpy.

Hashed word embeddings pass filters of several widths, the largest answer of every filter over
the whole text goes to a logistic output. A word's share in each filter place depends on the word
alone, so scoring keeps one projected row per word and adds shifted rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import labelled_sample, slices

WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 100_000
TEXTS = 256
RARE = 3  # words of fewer texts start without odds; they would only tell the texts apart


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def places_of(word: str, buckets: int) -> tuple[int, int]:
    """Two buckets of a word, from the low and the high bits of its hash; its embedding is the mean
    of both rows, so a word that shares one row with another is only half like it."""
    code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return code % buckets, code * buckets >> 32


def embedded(words: list[str], embeddings: np.ndarray) -> np.ndarray:
    ids = np.array([places_of(w, len(embeddings)) for w in words], np.int64).reshape(-1, 2)
    return embeddings[ids].mean(axis=1)


@dataclass
class ConvClassifier:
    """Embeddings, filters by width (width, dim, filters), their bias, and the output."""

    embeddings: np.ndarray
    filters: dict[int, np.ndarray]
    filter_bias: dict[int, np.ndarray]
    output: np.ndarray
    bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5

    def pooled(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answer of each filter and the place of it; vectors hold padding already."""
        tops, places = [], []
        for width, kernel in self.filters.items():
            n = len(vectors) - width + 1
            answers = sum(vectors[k:k + n] @ kernel[k] for k in range(width))
            at = answers.argmax(axis=0)
            tops.append(answers[at, np.arange(kernel.shape[2])] + self.filter_bias[width])
            places.append(at)
        return np.concatenate(tops), places

    @classmethod
    def fit(cls, descriptions: list[str], labels: list[int], prior: float = 0.5, dim: int = 12,
            widths: tuple[int, ...] = (1, 2, 3), filters: int = 8, buckets: int = 1 << 18,
            epochs: int = 3, rate: float = 0.01, fast: float = 0.1,
            seed: int = 11) -> ConvClassifier:
        """Adaptive stochastic gradient descent, one description a step: rate for embeddings and
        filters, fast for biases and the output.

        Max pooling passes a gradient to few words, so the first coordinate of an embedding starts
        at the smoothed log odds of the word's presence by label. Every filter starts by reading it
        in one of its places, above a limit of its own.
        prior: share of label 1 among all labelled rows; the output bias is moved from the
        sample's share to it. Without rows every score is 0.5.
        """
        rng = np.random.default_rng(seed)
        model = cls((rng.standard_normal((buckets, dim)) * 0.1).astype(np.float32),
                    {w: (rng.standard_normal((w, dim, filters)) / (w * dim) ** 0.5)
                     .astype(np.float32) for w in widths},
                    {w: np.zeros(filters, np.float32) for w in widths},
                    (rng.standard_normal(filters * len(widths)) * 0.1).astype(np.float32))
        pad = np.zeros((max(widths) - 1, dim), np.float32)
        texts = [np.array([places_of(w, buckets) for w in words_of(t)], np.int64).reshape(-1, 2)
                 for t in descriptions]
        sizes = np.array([labels.count(0) + 1, labels.count(1) + 1], np.float32)
        counts = np.tile(4 * sizes[:, None] / sizes.sum(), buckets)
        for ids, label in zip(texts, labels, strict=True):
            counts[label][np.unique(ids)] += 1
        odds = np.log(counts[1] / sizes[1]) - np.log(counts[0] / sizes[0])
        model.embeddings[:, 0] = np.where(counts.sum(axis=0) < 4 + RARE, 0, odds)
        for width, kernel in model.filters.items():
            kernel *= 0.3
            for f in range(filters):
                kernel[f % width, 0, f] = 1
            model.filter_bias[width] -= np.linspace(0.5, 4, filters, dtype=np.float32)
        model.output = np.abs(model.output)
        model.bias = -1.0
        seen = {"e": np.full(buckets, 1e-2, np.float32), "o": np.full(len(model.output), 1e-2),
                "b": 1e-2}
        seen |= {w: np.full_like(k, 1e-2) for w, k in model.filters.items()}
        seen |= {-w: np.full(filters, 1e-2) for w in widths}
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                ids = texts[i]
                vectors = np.concatenate([pad, model.embeddings[ids].mean(axis=1), pad])
                tops, places = model.pooled(vectors)
                live = np.maximum(tops, 0)
                error = 1 / (1 + np.exp(-np.clip(live @ model.output + model.bias, -30, 30))) \
                    - labels[i]
                back = error * model.output * (tops > 0)
                grad = error * live
                seen["o"] += grad ** 2
                model.output -= (fast * grad / np.sqrt(seen["o"])).astype(np.float32)
                seen["b"] += error ** 2
                model.bias -= fast * error / seen["b"] ** 0.5
                toward: dict[int, np.ndarray] = {}
                for j, (width, kernel) in enumerate(model.filters.items()):
                    part = back[j * filters:(j + 1) * filters]
                    hot = np.flatnonzero(part)
                    if not len(hot):
                        continue
                    change = np.zeros_like(kernel)
                    for f in hot:
                        at = int(places[j][f])
                        change[:, :, f] = part[f] * vectors[at:at + width]
                        for k in range(width):
                            place = at + k - len(pad)
                            if 0 <= place < len(ids):
                                for b in ids[place].tolist():
                                    toward[b] = toward.get(b, 0) + 0.5 * part[f] * kernel[k, :, f]
                    seen[width] += change ** 2
                    kernel -= rate * change / np.sqrt(seen[width])
                    seen[-width] += part ** 2
                    model.filter_bias[width] -= (fast * part / np.sqrt(seen[-width])
                                                 ).astype(np.float32)
                for b, grad in toward.items():
                    seen["e"][b] += float(grad @ grad)
                    model.embeddings[b] -= rate * grad / seen["e"][b] ** 0.5
        ones = sum(labels)
        if 0 < ones < len(labels) and 0 < prior < 1:
            model.bias += float(np.log(prior / (1 - prior)) - np.log(ones / (len(labels) - ones)))
        if not labels:
            model.output[:], model.bias = 0, 0.0
        return model

    def score(self, text: str | None) -> float:
        pad = np.zeros((max(self.filters) - 1, self.embeddings.shape[1]), np.float32)
        tops, _ = self.pooled(np.concatenate([pad, embedded(words_of(text), self.embeddings), pad]))
        return float(1 / (1 + np.exp(-np.clip(np.maximum(tops, 0) @ self.output + self.bias,
                                              -500, 500))))

    def calibrate(self, languages: list[str | None], scores: list[float], labels: list[int],
                  least: int = 20) -> None:
        """Threshold of the best F1 per language; one over all rows stands for languages with
        fewer than least rows of either label."""
        self.default_threshold = best_threshold(scores, labels)
        for lang in sorted({x for x in languages if x is not None}):
            own = [(s, y) for x, s, y in zip(languages, scores, labels, strict=True) if x == lang]
            ones = sum(y for _, y in own)
            if min(ones, len(own) - ones) >= least:
                self.thresholds[lang] = best_threshold(*map(list, zip(*own, strict=True)))


def best_threshold(scores: list[float], labels: list[int]) -> float:
    """Middle of the gap below the lowest score that is kept at the best F1; 0.5 without ones."""
    if not any(labels):
        return 0.5
    order = sorted(zip(scores, labels, strict=True), reverse=True)
    total, hits, best, cut = sum(labels), 0, -1.0, 0.5
    for i, (s, y) in enumerate(order):
        hits += y
        below = order[i + 1][0] if i + 1 < len(order) else 0.0
        if below < s and (f1 := 2 * hits / (i + 1 + total)) > best:
            best, cut = f1, (s + below) / 2
    return cut


def fit_toxicity(rows: DataFrame, labels: DataFrame, per_label: int = 3000,
                 max_chars: int = 60_000, language: str | None = "lang",
                 **settings) -> ConvClassifier:
    """Learn toxicity of description rows and a threshold per language.

    rows: row_id, description and, for the thresholds, a language column, which never enters a
    score; labels: row_id, label (1 toxic). At most per_label rows of each label with at most
    max_chars characters come to the driver (labelled_sample); a fifth of them, by crc32 of row_id,
    sets the thresholds and trains nothing.
    """
    columns = ["row_id", "description", "label"] + ([language] if language else [])
    picked = sorted((zlib.crc32(str(r["row_id"]).encode()), str(r["row_id"]),
                     r["description"] or "", r["label"], r[language] if language else None)
                    for r in labelled_sample(rows, labels, per_label, max_chars)
                    .select(*columns).collect())
    share = labels.filter(F.col("label").isin(0, 1)).agg(F.avg("label").alias("share")).first()
    train = [p for p in picked if p[0] // 8 % 5]
    held = [p for p in picked if not p[0] // 8 % 5]
    model = ConvClassifier.fit([p[2] for p in train], [p[3] for p in train],
                               share["share"] if share["share"] is not None else 0.5, **settings)
    model.calibrate([p[4] for p in held], [model.score(p[2]) for p in held], [p[3] for p in held])
    return model


def score_toxicity(rows: DataFrame, model: ConvClassifier, threshold: float = 0.3,
                   language: str | None = "lang") -> DataFrame:
    """All columns of description rows with score, predicted, language_threshold and flagged.

    predicted compares the score with one threshold, flagged with the one of the row's language.
    Whole texts are scored in one pass without a shuffle. Null and empty texts hold only padding
    and get the score of that. Columns with these names are replaced.
    """
    kept = rows.drop("score", "predicted", "language_threshold", "flagged")
    shared = kept.sparkSession.sparkContext.broadcast(model.embeddings)
    widths = list(model.filters)
    deep = max(widths) - 1
    table = np.concatenate([k[i] for k in model.filters.values() for i in range(len(k))], axis=1)
    each = table.shape[1] // sum(widths)
    filter_bias, output, bias = model.filter_bias, model.output, model.bias
    limits, limit = model.thresholds, model.default_threshold

    def score(batches):
        embeddings = shared.value
        place: dict[str, int] = {}
        rows_ = np.zeros((1024, table.shape[1]), np.float32)
        for batch in slices(batches, TEXTS):
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column("description").to_pylist()):
                words = words_of(text)
                if len(place) > CACHE_WORDS:
                    place.clear()
                new = [w for w in dict.fromkeys(words) if w not in place]
                if new:
                    first = len(place) + 1  # row 0 is the padding
                    if first + len(new) > len(rows_):
                        grown = np.zeros((2 * (first + len(new)), table.shape[1]), np.float32)
                        grown[:first] = rows_[:first]
                        rows_ = grown
                    rows_[first:first + len(new)] = embedded(new, embeddings) @ table
                    place.update(zip(new, range(first, first + len(new)), strict=True))
                ids = np.zeros(len(words) + 2 * deep, np.int64)
                ids[deep:deep + len(words)] = [place[w] for w in words]
                parts = rows_[ids]
                tops, at = [], 0
                for w in widths:
                    n = len(ids) - w + 1
                    answers = parts[:n, at:at + each]
                    for k in range(1, w):
                        answers = answers + parts[k:k + n, at + k * each:at + (k + 1) * each]
                    tops.append(answers.max(axis=0) + filter_bias[w])
                    at += w * each
                out[i] = np.maximum(np.concatenate(tops), 0) @ output + bias
            scores = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            lines = np.full(batch.num_rows, limit)
            if language and language in batch.schema.names:
                lines = np.array([limits.get(x, limit)
                                  for x in batch.column(language).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                 pa.array(lines), pa.array(scores >= lines)],
                [*batch.schema.names, "score", "predicted", "language_threshold", "flagged"])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(score, ", ".join(
        [*names, "score double", "predicted int", "language_threshold double", "flagged boolean"]))
