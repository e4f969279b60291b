"""Expressions on predictor vectors (ARRAY columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions.missing import INF


def finite_share(vec: Column) -> Column:
    """Share of elements that are finite."""
    n_finite = F.size(F.filter(vec, lambda x: F.abs(x) < F.lit(INF)))
    return F.try_divide(n_finite, F.size(vec))


def sanitise_vector(vec: Column, lo: float = -1e4, hi: float = 1e4) -> Column:
    """Non-finite elements become 0, then everything is clamped to [lo, hi]."""
    return F.transform(
        vec,
        lambda x: F.when(
            F.abs(x) < F.lit(INF), F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))
        ).otherwise(F.lit(0.0)),
    )


def dot(vec: Column, weights: Column) -> Column:
    return F.aggregate(
        F.zip_with(vec, weights, lambda x, w: x.cast("double") * w),
        F.lit(0.0),
        lambda acc, p: acc + p,
    )


def centre_slice(vec: Column, size: int) -> Column:
    """Central ``size`` elements of a vector."""
    start = F.floor((F.size(vec) - F.lit(size)) / 2).cast("int") + 1
    return F.slice(vec, start, F.lit(size))
