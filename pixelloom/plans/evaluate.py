"""Scores to metrics in original units, and scores to a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.grid import GridSpec
from pixelloom.operators import chips, masks, metrics, transforms
from pixelloom.operators.transforms import DenormOptions


def evaluate(
    chip_pixels: DataFrame, params: DataFrame, patch: int, mode: str = "dense", crop: int | None = None,
    options: DenormOptions = DenormOptions(clip_z=3.0), unique_pixels: bool = False,
) -> dict[str, DataFrame]:
    """Per-trait metrics, pooled macro metrics and source counts of supervised, valid pixels.

    ``chip_pixels``: normalised ``y`` and ``p`` with ``source_code`` and ``valid``. A pixel counts once
    per covering chip unless ``unique_pixels``, which averages its predictions first.
    """
    supervised = masks.supervision_slice(chip_pixels, mode, patch, crop)
    masked = masks.mask_by_validity(supervised)
    if unique_pixels:
        masked = masked.groupBy("row", "col", "trait", "source_code").agg(
            F.first("y", ignorenulls=True).alias("y"), F.avg("p").alias("p")
        )
    physical = transforms.denormalise_pair(masked, params, options)
    return {
        "traits": metrics.trait_metrics_denorm(masked, params, options),
        "macro": metrics.macro_pooled(physical),
        "sources": metrics.source_counts(masked),
    }


def predict_map(
    chip_scores: DataFrame, params: DataFrame, grid: GridSpec, patch: int, stride: int, crop: int | None = None,
    options: DenormOptions = DenormOptions(clip_z=3.0),
) -> DataFrame:
    """Normalised chip scores to a map in original units; traits without parameters stay missing."""
    physical, _missing = transforms.denormalise_all(chip_scores, params, "keep", options, value="score", out="score")
    return chips.mosaic_weighted(physical, grid, patch, stride, crop)
