"""Pixels and a split table to chips."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.grid import GridSpec
from pixelloom.operators import cells, chips, masks


@dataclass(frozen=True)
class ChipPlan:
    patch: int = 128
    stride: int = 64
    strides: tuple[tuple[str, int], ...] = ()
    require_target: bool = True
    mask_predictors: bool = True
    mask_targets: bool = True
    cell_kind: str = "hex"
    cell_size: float | tuple[int, int] = 100_000.0


def build_chips(
    pixels: DataFrame, cell_split: DataFrame, grid: GridSpec, plan: ChipPlan = ChipPlan()
) -> tuple[DataFrame, DataFrame]:
    """Masked chip pixels and the report of kept and skipped chips.

    ``pixels`` holds ``row, col, trait, y, pred``; ``cell_split`` holds ``cell_id, split``. Pixels in
    no cell belong to no split and never make a chip. The cell table is joined on the pixel's cell;
    hexagons are computed, not looked up.
    """
    placed = cells.pixel_to_cell(pixels, grid, plan.cell_kind, plan.cell_size)
    owned = placed.join(
        cell_split.select("cell_id", F.col("split").alias("pixel_split")), "cell_id"
    ).drop("cell_id", "parent_id")
    windows = chips.pixel_to_chip(owned, grid, plan.patch, plan.stride)
    copies = chips.assign_chips(windows, dict(plan.strides) or None, plan.stride)
    kept, report = chips.require_valid_target(copies, always=("all",) if plan.require_target else tuple(
        ("all", "train", "val", "test", "none")))
    return masks.split_mask(kept, plan.mask_predictors, plan.mask_targets), report
