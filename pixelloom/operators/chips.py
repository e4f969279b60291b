"""Sliding-window chips: membership, splits, filters, bounds and overlap-weighted mosaics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.missing import finite
from pixelloom.grid import GridSpec

CHIP = ["chip_row", "chip_col"]
#: The set that holds the chips of every split.
ALL = "all"


def n_windows(length: int, patch: int, stride: int) -> int:
    """Windows along an axis; the last one may overhang."""
    return max(math.ceil((length - patch) / stride), 0) + 1


def _covering(pos: Column, patch: int, stride: int, n: int) -> Column:
    """Indices of the windows covering a pixel."""
    first = F.greatest(F.ceil((pos - F.lit(patch - 1)) / F.lit(stride)), F.lit(0)).cast("int")
    last = F.least(F.floor(pos / F.lit(stride)), F.lit(n - 1)).cast("int")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def pixel_to_chip(df: DataFrame, grid: GridSpec, patch: int, stride: int) -> DataFrame:
    """One row per pixel and covering window (generated keys: no range join, no shuffle)."""
    rows, cols = n_windows(grid.height, patch, stride), n_windows(grid.width, patch, stride)
    return (
        df.withColumn("chip_row", F.explode(_covering(F.col("row"), patch, stride, rows)))
        .withColumn("chip_col", F.explode(_covering(F.col("col"), patch, stride, cols)))
        .withColumns(
            {
                "dr": F.col("row") - F.col("chip_row") * stride,
                "dc": F.col("col") - F.col("chip_col") * stride,
                "chip_id": F.col("chip_row").cast("bigint") * cols + F.col("chip_col"),
            }
        )
    )


def chip_splits(chip_pixels: DataFrame) -> DataFrame:
    """Every split a chip overlaps (any pixel), with the number of its pixels and of all splits."""
    n = chip_pixels.groupBy(*CHIP, "chip_id", F.col("pixel_split").alias("split")).agg(
        F.count_distinct("dr", "dc").alias("n_pixels")
    )
    return n


def overlap_report(splits_of_chips: DataFrame) -> DataFrame:
    """Chips by number of splits they overlap."""
    return (
        splits_of_chips.groupBy("chip_id").agg(F.count(F.lit(1)).alias("n_splits"))
        .groupBy("n_splits").agg(F.count(F.lit(1)).alias("n_chips"))
    )


def assign_chips(chip_pixels: DataFrame, strides: dict[str, int] | None = None, stride: int = 1) -> DataFrame:
    """Copy each chip into every split it overlaps. ``strides`` thins a split to its own stride.

    Splits that ``strides`` doesn't name are left out. ``"all"`` in it makes one more set, of every chip at that
    stride. A stride has to be a multiple of the windows' ``stride``, else ``ValueError``. Both sides have one chip's pixels per key, so the join groups are bounded by the patch area.
    """
    owners = chip_pixels.select("chip_id", *CHIP, F.col("pixel_split").alias("split")).distinct()
    if strides:
        uneven = {name: s for name, s in strides.items() if s <= 0 or s % stride}
        if uneven:
            raise ValueError(f"strides {uneven} are no multiples of {stride}")
        if ALL in strides:
            owners = owners.unionByName(chip_pixels.select("chip_id", *CHIP).distinct().withColumn("split", F.lit(ALL)))
        keep = F.lit(False)
        for name, s in strides.items():
            step = s // stride
            keep = keep | (
                (F.col("split") == name) & (F.col("chip_row") % step == 0) & (F.col("chip_col") % step == 0)
            )
        owners = owners.filter(keep)
    return chip_pixels.join(owners.drop(*CHIP), "chip_id")


def require_valid_target(chips: DataFrame, y: str = "y", always: Sequence[str] = (ALL,)) -> tuple[DataFrame, DataFrame]:
    """Drop (chip, split) pairs without a finite target among the split's own pixels.

    Splits in ``always`` are never dropped. The report counts kept and skipped chips per split.
    """
    own = (F.col("pixel_split") == F.col("split")) & finite(F.col(y)).isNotNull()
    free = F.col("split").isin(list(always))
    verdict = chips.groupBy("chip_id", "split").agg(F.bool_or(own | free).alias("keep"))
    kept = chips.join(verdict.filter("keep").select("chip_id", "split"), ["chip_id", "split"], "left_semi")
    report = verdict.groupBy("split").agg(
        F.count_if("keep").alias("n_kept"), F.count_if(~F.col("keep")).alias("n_skipped")
    )
    return kept, report


def chip_bounds(chips: DataFrame, grid: GridSpec, patch: int, stride: int) -> DataFrame:
    """xmin, ymin, xmax, ymax of every window."""
    x = F.lit(grid.c) + F.col("chip_col") * F.lit(stride * grid.a)
    y = F.lit(grid.f) + F.col("chip_row") * F.lit(stride * grid.e)
    return chips.withColumns(
        {"xmin": x, "ymin": y + F.lit(patch * grid.e), "xmax": x + F.lit(patch * grid.a), "ymax": y}
    )


def chip_arrays(chip_pixels: DataFrame, patch: int, value: str = "y") -> DataFrame:
    """Dense (patch*patch) FLOAT array per chip, split and trait, missing pixels NULL.

    The list holds one chip's pixels, so it is bounded by the patch area.
    """
    cell = F.struct((F.col("dr") * patch + F.col("dc")).alias("k"), F.col(value).cast("float").alias("v"))
    packed = chip_pixels.groupBy("split", *CHIP, "chip_id", "trait").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(cell))).alias("m")
    )
    slots = F.sequence(F.lit(0), F.lit(patch * patch - 1))
    return packed.select(
        "split", *CHIP, "chip_id", "trait", F.transform(slots, lambda k: F.try_element_at(F.col("m"), k)).alias("data")
    )


def triangular_weight(dr: Column, dc: Column, patch: int) -> Column:
    """Squared product of distances to the window border; largest in the centre."""
    i, j = dr + 1, dc + 1
    w = F.least(i, F.lit(patch + 1) - i) * F.least(j, F.lit(patch + 1) - j)
    return (w * w).cast("double")


def placed_scores(
    chip_scores: DataFrame, grid: GridSpec, patch: int, stride: int, crop: int | None = None
) -> DataFrame:
    """Scores at raster pixels with their weight. With ``crop``, dr/dc count inside the centred crop."""
    size = crop or patch
    shift = (patch - size) // 2
    return chip_scores.select(
        "trait",
        (F.col("chip_row") * stride + F.col("dr") + shift).alias("row"),
        (F.col("chip_col") * stride + F.col("dc") + shift).alias("col"),
        finite(F.col("score").cast("double")).alias("v"),
        triangular_weight(F.col("dr"), F.col("dc"), size).alias("w"),
    ).filter(grid.contains("row", "col"))


def weighted_sums(placed: DataFrame) -> DataFrame:
    """Additive sums per pixel and trait. A missing score carries no weight; it is not filtered out,
    because that filter would be pushed below, and so repeat, the expression that made the score."""
    w = F.when(F.col("v").isNotNull(), F.col("w"))
    return placed.groupBy("row", "col", "trait").agg(
        F.sum(w * F.col("v")).alias("sum_wv"), F.sum(w).alias("sum_w")
    )


def weighted_mean() -> Column:
    return F.try_divide(F.col("sum_wv"), F.col("sum_w"))


def mosaic_weighted(
    chip_scores: DataFrame, grid: GridSpec, patch: int, stride: int, crop: int | None = None
) -> DataFrame:
    """Overlap-weighted mean of chip scores per pixel and trait; a pixel has few chips, so no skew."""
    sums = weighted_sums(placed_scores(chip_scores, grid, patch, stride, crop))
    return sums.filter(F.col("sum_w") > 0).select("row", "col", "trait", weighted_mean().alias("value"))


def target_layout(traits: Sequence[str], bands: Sequence[str], wanted: Sequence[str] | None = None) -> list[tuple]:
    """(trait, band, position, channel) with ``channel = position * n_bands + band index``."""
    wanted = list(wanted or traits)
    unknown = [t for t in wanted if t not in traits]
    if unknown or not bands:
        raise ValueError(f"unknown traits {unknown} or no bands")
    return [
        (t, b, list(traits).index(t), list(traits).index(t) * len(bands) + i)
        for t in wanted
        for i, b in enumerate(bands)
    ]
