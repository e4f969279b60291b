"""Web Mercator, tile addressing and colour-table indices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius and latitude limit of Web Mercator.
MERCATOR_RADIUS = 6378137.0
MERCATOR_MAX_LAT = 85.05112878
COLOURS = 255


def to_3857(lon: Column, lat: Column) -> tuple[Column, Column]:
    clamped = F.greatest(F.least(lat, F.lit(MERCATOR_MAX_LAT)), F.lit(-MERCATOR_MAX_LAT))
    x = F.radians(lon) * F.lit(MERCATOR_RADIUS)
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamped) / 2)) * F.lit(MERCATOR_RADIUS)
    return x, y


def web_tile(lon: Column, lat: Column, zoom: int, tilesize: int) -> tuple[Column, Column]:
    """Global pixel (gx, gy) counted from the north-west corner at ``zoom``."""
    x, y = to_3857(lon, lat)
    half = math.pi * MERCATOR_RADIUS
    n = tilesize * 2**zoom
    gx = F.floor((x + F.lit(half)) / F.lit(2 * half) * F.lit(float(n)))
    gy = F.floor((F.lit(half) - y) / F.lit(2 * half) * F.lit(float(n)))

    def clip(g: Column) -> Column:
        return F.least(F.greatest(g, F.lit(0)), F.lit(n - 1)).cast("bigint")

    return clip(gx), clip(gy)


def colour_index(v: Column, vmin: Column, vmax: Column) -> Column:
    """Colour-table index 0..255; NULL (transparent) where the value is missing."""
    share = F.try_divide(v - vmin, vmax - vmin)
    return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * COLOURS).cast("int") + F.when(
        v.isNotNull(), F.lit(0)
    )
