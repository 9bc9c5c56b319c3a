"""Vector column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize_text, token_set

SCORE_DIGITS = 9


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def unit(vector: Column) -> Column:
    """Unit length as doubles; a zero vector stays zero."""
    return let(vector.cast("array<double>"), lambda v: let(norm(v), lambda length: F.transform(
        v, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def clip(similarity: Column) -> Column:
    return F.greatest(F.least(similarity, F.lit(1.0)), F.lit(-1.0))


def rank_score(similarity: Column) -> Column:
    """Similarity rounded for ranking, so that equal scores tie in every engine."""
    return F.round(similarity, SCORE_DIGITS)


def hashed_vector(text: Column, size: int = 64) -> Column:
    """Token counts hashed into a fixed number of dimensions.

    A stand-in for texts that come without a model vector; pass an own column or pandas UDF
    wherever vectors are taken.
    """
    tokens = token_set(normalize_text(text))
    slots = F.transform(tokens, lambda t: F.pmod(
        F.conv(F.substring(F.md5(t.cast("binary")), 1, 6), 16, 10).cast("int"), F.lit(size)))
    return let(slots, lambda own: F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double")))
