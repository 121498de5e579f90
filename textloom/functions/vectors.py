"""Column builders for arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY = 1e-9


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` over its length; guarded as the length plus 1e-9."""
    # An array of one binds the length, which each element would compute again.
    return F.get(F.transform(F.array(norm(a) + TINY), lambda length: F.transform(a, lambda x: x / length)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY))


def offset(a: Column, a_to: Column, b: Column) -> Column:
    """a' - a + b, the target of an analogy."""
    return F.zip_with(F.zip_with(a_to, a, lambda x, y: x - y), b, lambda x, y: x + y)


def pair_features(a: Column, b: Column) -> Column:
    """Both vectors, their absolute difference and their product."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def soft_membership(probabilities: Column, slots: int) -> Column:
    """Distribution of the segment index after each boundary probability, the last slot absorbing.

    Folds f[k] = f[k] (1 - p) + f[k - 1] p over the probabilities.
    """
    start = F.array(F.lit(1.0), *[F.lit(0.0)] * (slots - 1))

    def step(f: Column, p: Column) -> Column:
        stay = lambda x, k: F.when(k == slots - 1, x).otherwise(x * (1 - p))
        move = lambda k: F.when(k == 0, F.lit(0.0)).otherwise(F.get(f, k - 1) * p)
        return F.transform(f, lambda x, k: stay(x, k) + move(k))

    return F.aggregate(probabilities, start, step)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
