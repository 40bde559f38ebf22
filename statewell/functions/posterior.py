"""Expressions on arrays of state probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    return F.transform(a, lambda x: x / total(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def argmax(a: Column) -> Column:
    """Ordinal of the first largest, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def entropy(a: Column, floor: float = 1e-15) -> Column:
    return -total(F.transform(a, lambda x: x * F.ln(F.greatest(x, F.lit(floor)))))


def gaussian_posterior(x: Column, centres: Sequence[float], sd: float) -> Column:
    """Probabilities of states with fixed means and one deviation, equally likely."""
    weights = F.array(*[F.exp(-0.5 * ((x - c) / sd) * ((x - c) / sd)) for c in centres])
    return normalise(weights)


def vector_matrix(p: Column, matrix: Sequence[Sequence[float]]) -> Column:
    return F.array(*[dot(p, numbers([row[j] for row in matrix])) for j in range(len(matrix[0]))])
