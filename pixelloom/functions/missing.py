"""One missing-value rule: NaN, infinities and sentinels become NULL at the edge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
# Relative and absolute tolerance of the "close to nodata" test.
CLOSE_RTOL, CLOSE_ATOL = 1e-5, 1e-8


def finite(v: Column) -> Column:
    """NULL unless finite. NaN sorts above infinity in Spark, so one comparison covers both."""
    return F.when(F.abs(v) < F.lit(INF), v)


def is_sentinel(v: Column, sentinels: Sequence[float], close: bool = True) -> Column:
    def hit(s: float) -> Column:
        if close:
            return F.abs(v - F.lit(float(s))) <= F.lit(CLOSE_ATOL + CLOSE_RTOL * abs(s))
        return v == F.lit(float(s))

    return reduce(lambda p, q: p | q, [hit(s) for s in sentinels], F.lit(False))


def normalise_missing(v: Column, sentinels: Sequence[float] = (), close: bool = True) -> Column:
    return F.when((F.abs(v) < F.lit(INF)) & ~is_sentinel(v, sentinels, close), v)
