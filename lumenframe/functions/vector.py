"""Arithmetic on ``array<float>`` columns, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published calibration of the embedding model, and the norm's guard.
CALIBRATION_SCALE, CALIBRATION_BIAS, EPSILON = 113.73, -15.94, 1e-12


def literal(vector: Sequence[float]) -> Column:
    """A query vector as one literal array of doubles."""
    return F.split(F.lit(",".join(repr(float(x)) for x in vector)), ",").cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its length; lengths below EPSILON count as EPSILON."""
    length = F.greatest(norm(v), F.lit(EPSILON))
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPSILON)) * F.greatest(norm(b), F.lit(EPSILON)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def probability(cos: Column, scale: float = CALIBRATION_SCALE, bias: float = CALIBRATION_BIAS) -> Column:
    """Calibrated probability of a cosine."""
    return sigmoid(cos * F.lit(scale) + F.lit(bias))


def mean_vector(v: Column, dim: int) -> Column:
    """Element-wise mean as an aggregate: one average per component, combined map-side."""
    return F.array(*[F.avg(v[i].cast("double")) for i in range(dim)])


def sign_words(v: Column, dim: int) -> Column:
    """One bit a component (positive: one), packed into longs of 62 bits."""
    words = []
    for start in range(0, dim, 62):
        bits = [F.when(v[i] > 0, F.lit(1 << (i - start))).otherwise(F.lit(0)).cast("long") for i in range(start, min(dim, start + 62))]
        word = bits[0]
        for b in bits[1:]:
            word = word.bitwiseOR(b)
        words.append(word)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def rocchio(q: Column, positive: Column, negative: Column, alpha: float = 0.75, beta: float = 0.25) -> Column:
    """q + alpha * positive - beta * negative, to length one; a null mean counts as zero and a
    zero result leaves q as it was."""
    nothing = F.transform(q, lambda x: F.lit(0.0))
    moved = F.zip_with(q, F.coalesce(positive, nothing), lambda x, p: x.cast("double") + F.lit(alpha) * p)
    moved = F.zip_with(moved, F.coalesce(negative, nothing), lambda x, n: x - F.lit(beta) * n)
    return F.when(norm(moved) > EPSILON, unit(moved)).otherwise(F.transform(q, lambda x: x.cast("double")))
