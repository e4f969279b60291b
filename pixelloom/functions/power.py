"""Yeo-Johnson power transform, its inverse and the inverse's domain guard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def yeo_johnson_core(v: Column, lam: Column) -> Column:
    """Transform without standardisation; the expm1/log1p form stays accurate for small lambda."""
    two = F.lit(2.0) - lam
    pos = F.when(lam == 0, F.log1p(v)).otherwise(F.try_divide(F.expm1(lam * F.log1p(v)), lam))
    neg = F.when(two == 0, -F.log1p(-v)).otherwise(-F.try_divide(F.expm1(two * F.log1p(-v)), two))
    return F.when(v >= 0, pos).when(v < 0, neg)


def yeo_johnson(v: Column, lam: Column, mean: Column, scale: Column) -> Column:
    """Forward transform followed by the z-score."""
    return F.try_divide(yeo_johnson_core(v, lam) - mean, scale)


def inverse_yeo_johnson(y: Column, lam: Column) -> Column:
    """Inverse transform; outside the domain the result is NULL."""
    two = F.lit(2.0) - lam
    pos = F.when(lam == 0, F.expm1(y)).when(
        y * lam > -1, F.expm1(F.try_divide(F.log1p(y * lam), lam))
    )
    neg = F.when(two == 0, -F.expm1(-y)).when(
        -y * two > -1, -F.expm1(F.try_divide(F.log1p(-y * two), two))
    )
    return F.when(y >= 0, pos).when(y < 0, neg)


def clip_inverse_domain(
    y: Column, lam: Column, eps: float = EPS, ratio: float = 0.0, abs_: float = 0.0
) -> Column:
    """Pull ``y`` inside the open domain of the inverse: above bound for lambda<0, below for lambda>2."""
    upper = F.try_divide(F.lit(-1.0), lam)
    lower = F.try_divide(F.lit(1.0), F.lit(2.0) - lam)

    def margin(bound: Column) -> Column:
        return F.greatest(F.lit(float(eps)), F.lit(float(abs_)), F.abs(bound) * F.lit(float(ratio)))

    return (
        F.when((y >= 0) & (lam < 0), F.least(y, upper - margin(upper)))
        .when((y < 0) & (lam > 2), F.greatest(y, lower + margin(lower)))
        .otherwise(y)
    )
