"""Validity, masking, cropping and conformity rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.missing import finite
from pixelloom.functions.projection import SEMI_MAJOR, K0, E, E2  # noqa: F401
from pixelloom.functions.vectors import finite_share
from pixelloom.grid import GridSpec

import math

GRID_FIELDS = ["crs", "height", "width", "a", "c", "e", "f"]


def grid_conformity(grids: DataFrame, reference: GridSpec) -> DataFrame:
    """Attributes in which a dataset's grid differs from the reference grid."""
    wanted = {k: str(getattr(reference, k)) for k in GRID_FIELDS}
    numeric = [k for k in GRID_FIELDS if k != "crs"]
    rows = F.array(
        F.struct(F.lit("crs").alias("attribute"), F.col("crs").alias("found"), F.lit(wanted["crs"]).alias("expected"),
                 (F.col("crs") == wanted["crs"]).alias("same")),
        *[
            F.struct(
                F.lit(k).alias("attribute"), F.col(k).cast("double").cast("string").alias("found"),
                F.lit(float(getattr(reference, k))).cast("string").alias("expected"),
                (F.abs(F.col(k) - F.lit(float(getattr(reference, k)))) <= 1e-9).alias("same"),
            )
            for k in numeric
        ],
    )
    return (
        grids.select("dataset", F.explode(rows).alias("r")).select("dataset", "r.*").filter(~F.col("same")).drop("same")
    )


def predictor_validity(
    df: DataFrame, vec: str = "vec", mode: str = "min_fraction", min_ratio: float = 0.2, out: str = "valid"
) -> DataFrame:
    """Pixel validity from its channels: all finite, any finite, or at least a share finite."""
    share = F.coalesce(finite_share(F.col(vec)), F.lit(0.0))
    rule = {"all": share >= 1.0, "any": share > 0.0, "min_fraction": share >= F.lit(float(min_ratio))}
    if mode not in rule:
        raise ValueError(f"unknown validity mode {mode!r}")
    return df.withColumn(out, rule[mode])


def validity_mask(pixels: DataFrame, value: str = "value") -> DataFrame:
    """1 where any raster has data in the pixel, else 0."""
    has = F.bool_or(finite(F.col(value)).isNotNull())
    return pixels.groupBy("row", "col").agg(F.when(has, 1).otherwise(0).alias("valid"))


def validity_share(mask: DataFrame, grid: GridSpec | None = None) -> DataFrame:
    """Valid pixels and their share of the mask (or of the whole grid)."""
    n_all = F.lit(grid.height * grid.width).cast("bigint") if grid else F.count(F.lit(1))
    return mask.agg(F.sum("valid").alias("n_valid"), n_all.alias("n_pixels")).withColumn(
        "share", F.try_divide(F.col("n_valid"), F.col("n_pixels"))
    )


def is_wet(row: Column, col: Column, code: Column, extent: tuple[int, int, int, int]) -> Column:
    """Whether a pixel of the mask grid lies in ``extent`` (row0, row1, col0, col1) and is water, nodata or absent there."""
    r0, r1, c0, c1 = extent
    inside = (row >= r0) & (row < r1) & (col >= c0) & (col < c1)
    return inside & F.coalesce(code, F.lit(255)).isin(0, 255)


def apply_water_mask(
    dem: DataFrame, mask: DataFrame, extent: tuple[int, int, int, int], offset: tuple[int, int] = (0, 0),
    value: str = "value", code: str = "land",
) -> DataFrame:
    """DEM values become missing on water (0) and nodata (255, or absent from the sparse mask).

    ``offset`` is the (col, row) of the DEM origin on the mask grid and ``extent`` the mask's
    (row0, row1, col0, col1) there, ends excluded; DEM pixels outside the extent stay.
    """
    dc, dr = offset
    shifted = mask.select(
        (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col(code).alias("__code")
    )
    wet = is_wet(F.col("row") + dr, F.col("col") + dc, F.col("__code"), extent)
    return dem.join(shifted, ["row", "col"], "left").withColumn(value, F.when(~wet, F.col(value))).drop("__code")


def split_mask(
    chip_pixels: DataFrame, mask_predictors: bool = True, mask_targets: bool = True,
    predictors: Sequence[str] = ("pred",), targets: Sequence[str] = ("y",),
) -> DataFrame:
    """Inside a chip, pixels of another split lose predictors and/or targets; in ``"all"``, pixels of no split do."""
    own = (F.col("pixel_split") == F.col("split")) | ((F.col("split") == "all") & F.col("pixel_split").isNotNull())
    names = (list(predictors) if mask_predictors else []) + (list(targets) if mask_targets else [])
    return chip_pixels.withColumns(
        {c: F.when(own, F.col(c)) for c in names if c in chip_pixels.columns}
    )


def supervision_slice(chip_pixels: DataFrame, mode: str, patch: int, crop: int | None = None) -> DataFrame:
    """Offsets under supervision: the whole patch, a centred crop, or the centre pixel."""
    size = {"dense": patch, "center_crop": crop, "center_pixel": 1}.get(mode)
    if size is None:
        raise ValueError(f"unknown supervision mode {mode!r} or missing crop")
    if not 1 <= size <= patch:
        raise ValueError(f"crop {size} does not fit patch {patch}")
    start = (patch - size) // 2
    keep = lambda c: (F.col(c) >= start) & (F.col(c) < start + size)
    return chip_pixels.filter(keep("dr") & keep("dc"))


def mask_by_validity(df: DataFrame, y: str = "y", valid: str = "valid", code: str = "source_code") -> DataFrame:
    """Target missing where predictors are invalid or no source covers the pixel."""
    ok = F.coalesce(F.col(valid), F.lit(False)) & (F.coalesce(F.col(code), F.lit(0)) != 0)
    return df.withColumn(y, F.when(ok, F.col(y)))


def default_source_code(y: Column, dataset: Column, primary: str = "primary") -> Column:
    """2 for the primary dataset, 1 for others, 0 where the target is missing."""
    return F.when(y.isNull(), 0).when(dataset == primary, 2).otherwise(1)


def project_6933(lon: float, lat: float) -> tuple[float, float]:
    """The closed form of :func:`pixelloom.functions.to_6933` for a single known point."""
    s = math.sin(math.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E * s) / (1 + E * s)) / (2 * E))
    return math.radians(lon) * SEMI_MAJOR * K0, SEMI_MAJOR * q / (2 * K0)


def region_crop(
    df: DataFrame, lonlat_box: tuple[float, float, float, float], grid: GridSpec, pad: float = 0.25
) -> DataFrame:
    """Pixels in the projected window of a (west, south, east, north) box padded by ``pad`` degrees.

    The window is computed once, so the filter is a plain range on row and col that reaches the scan.
    """
    west, south, east, north = lonlat_box
    x0, y0 = project_6933(west - pad, south - pad)
    x1, y1 = project_6933(east + pad, north + pad)
    c0 = max(math.floor((x0 - grid.c) / grid.a), 0)
    c1 = min(math.ceil((x1 - grid.c) / grid.a), grid.width)
    r0 = max(math.floor((y1 - grid.f) / grid.e), 0)
    r1 = min(math.ceil((y0 - grid.f) / grid.e), grid.height)
    return df.filter(
        (F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1)
    )


def land_finalize(df: DataFrame, value: str = "value") -> DataFrame:
    """Off land the value is missing; ``imputed`` is land, not observed, and filled."""
    v = finite(F.col(value))
    return df.withColumns(
        {
            value: F.when(F.col("land"), v),
            "imputed": F.coalesce(F.col("land") & ~F.col("observed") & v.isNotNull(), F.lit(False)),
        }
    )


def snap_bbox(df: DataFrame, grid: GridSpec) -> DataFrame:
    """Column, row and origin of the nearest grid pixel for each (lon_min, lat_max); +180 becomes -180."""
    col = F.rint((F.col("lon_min") - grid.c) / grid.a).cast("bigint")
    row = F.rint((F.col("lat_max") - grid.f) / grid.e).cast("bigint")
    left = F.lit(grid.c) + F.col("tile_col") * F.lit(grid.a)
    fixed = F.when((F.abs(left - 180.0) < 1e-6) & (F.col("lon_min") < -179.9), left - 360.0).otherwise(left)
    return (
        df.withColumn("tile_col", col)
        .withColumn("tile_row", row)
        .withColumn("tile_left", fixed)
        .withColumn("tile_top", F.lit(grid.f) + F.col("tile_row") * F.lit(grid.e))
    )


def fix_antimeridian(c: Column, lon_min: Column) -> Column:
    """Origin written as +180 by a service although the tile starts at -180."""
    return F.when((F.abs(c - 180.0) < 1e-6) & (lon_min < -179.9), c - 360.0).otherwise(c)


def unrealistic_filter(stats: DataFrame) -> DataFrame:
    """Statistics that cannot be real: no data, a maximum above 1e6, a minimum below -1e3."""
    return stats.filter(
        (F.col("n") == 0) | F.col("v_max").isNull() | (F.col("v_max") > 1e6) | (F.col("v_min") < -1e3)
    )
