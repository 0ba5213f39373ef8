"""Vector columns: arrays of numbers, computed in double precision and left to right."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _with_norm(v: Column, scaled: Callable[[Column, Column], Column]) -> Column:
    """``scaled(number, norm)`` of every number. The norm is a field of a struct, so it is computed once a vector, not once a number."""
    held = F.array(F.struct(v.alias("v"), norm(v).alias("n")))
    return F.element_at(F.transform(held, lambda s: F.transform(s["v"], lambda x: scaled(x, s["n"]))), 1)


def l2_normalize(v: Column) -> Column:
    """The vector over its norm; a norm below ``EPS`` counts as ``EPS``, so a zero vector stays zero."""
    return _with_norm(as_double(v), lambda x, n: x / F.greatest(n, F.lit(EPS)))


def fuse(a: Column, b: Column) -> Column:
    """The mean of two vectors at unit length; zeros where they cancel out."""
    mean = F.zip_with(as_double(a), as_double(b), lambda x, y: (x + y) / F.lit(2.0))
    return _with_norm(mean, lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
