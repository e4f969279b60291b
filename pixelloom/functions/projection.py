"""Equal-area cylindrical projection (EPSG:6933) in closed form, after Snyder (1987)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the projection's standard parallel.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
STANDARD_PARALLEL_DEG = 30.0

E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
K0 = math.cos(math.radians(STANDARD_PARALLEL_DEG)) / math.sqrt(
    1 - E2 * math.sin(math.radians(STANDARD_PARALLEL_DEG)) ** 2
)


def _q_value(s: float) -> float:
    return (1 - E2) * (
        s / (1 - E2 * s * s) - (1 / (2 * E)) * math.log((1 - E * s) / (1 + E * s))
    )


QP = _q_value(1.0)
# Authalic-latitude series coefficients (Snyder 1987, eq. 3-18).
AUTHALIC_2 = E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040
AUTHALIC_4 = 23 * E2**2 / 360 + 251 * E2**3 / 3780
AUTHALIC_6 = 761 * E2**3 / 45360


def to_6933(lon: Column, lat: Column) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    q = F.lit(1 - E2) * (
        s / (F.lit(1.0) - F.lit(E2) * s * s)
        - F.lit(1 / (2 * E)) * F.log((F.lit(1.0) - F.lit(E) * s) / (F.lit(1.0) + F.lit(E) * s))
    )
    return F.radians(lon) * F.lit(SEMI_MAJOR * K0), q * F.lit(SEMI_MAJOR / (2 * K0))


def from_6933(x: Column, y: Column) -> tuple[Column, Column]:
    ratio = F.greatest(F.least(y * F.lit(2 * K0 / (SEMI_MAJOR * QP)), F.lit(1.0)), F.lit(-1.0))
    beta = F.asin(ratio)
    lat = (
        beta
        + F.lit(AUTHALIC_2) * F.sin(beta * 2)
        + F.lit(AUTHALIC_4) * F.sin(beta * 4)
        + F.lit(AUTHALIC_6) * F.sin(beta * 6)
    )
    return F.degrees(x / F.lit(SEMI_MAJOR * K0)), F.degrees(lat)
