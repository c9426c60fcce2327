"""Vector distances as Catalyst expressions, and the metric registry.

Everything is computed in double. A smaller value always means nearer: the inner product is
ordered by its negative, which ``order_value`` hides.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, functions as F


def _fold(left: Column, right: Column, term: Callable[[Column, Column], Column]) -> Column:
    pairs = F.zip_with(left, right, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def l2_squared(left: Column, right: Column) -> Column:
    return _fold(left, right, lambda x, y: (x - y) * (x - y))


def l2(left: Column, right: Column) -> Column:
    return F.sqrt(l2_squared(left, right))


def dot(left: Column, right: Column) -> Column:
    return _fold(left, right, lambda x, y: x * y)


def cosine(left: Column, right: Column) -> Column:
    """1 - cos; NULL when either vector has length zero."""
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.lit(1.0) - F.try_divide(dot(left, right), norms)


def manhattan(left: Column, right: Column) -> Column:
    return _fold(left, right, lambda x, y: F.abs(x - y))


@dataclass(frozen=True)
class Metric:
    name: str
    column: Callable[[Column, Column], Column]
    descending: bool = False


METRICS = {
    metric.name: metric
    for metric in (
        Metric("l2", l2),
        Metric("l2_squared", l2_squared),
        Metric("cosine", cosine),
        Metric("dot", dot, descending=True),
        Metric("manhattan", manhattan),
    )
}


def metric(name: str) -> Metric:
    """Look a metric up; an unknown name is an error, never a silent L2."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]


def distance(left: Column, right: Column, name: str = "l2") -> Column:
    return metric(name).column(left, right)


def order_value(value: Column, name: str = "l2") -> Column:
    """Ascending order of this column is nearest first."""
    return -value if metric(name).descending else value


def vector_literal(values) -> Column:
    """An array<double> constant."""
    return F.array(*[F.lit(float(x)) for x in values])


def has_dimension(vector: Column, dimension: int) -> Column:
    return F.coalesce(F.size(vector) == F.lit(dimension), F.lit(False))
