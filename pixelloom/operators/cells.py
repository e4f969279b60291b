"""Hexagonal or square cells by arithmetic on coordinates, their counts and neighbours."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.grid import GridSpec

# cell_id = cq * AXIS + cr; holds for |cr| < AXIS / 2.
AXIS = 1 << 24
HEX_STEPS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]
SQUARE_STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def cell_key(cq: Column, cr: Column) -> Column:
    return (cq.cast("bigint") * AXIS + cr.cast("bigint")).cast("bigint")


def _hex_of(df: DataFrame, x: Column, y: Column, size: float, out: str) -> DataFrame:
    """Pointy-top hexagons of circumradius ``size``: axial coordinates by cube rounding."""
    s = F.lit(float(size))
    df = df.withColumns(
        {"__fq": (F.lit(math.sqrt(3) / 3) * x - y / 3) / s, "__fr": F.lit(2 / 3) * y / s}
    )
    q, r = F.col("__fq"), F.col("__fr")
    df = df.withColumns({"__rq": F.rint(q), "__rr": F.rint(r), "__rs": F.rint(-q - r)})
    df = df.withColumns(
        {
            "__dq": F.abs(F.col("__rq") - q), "__dr": F.abs(F.col("__rr") - r),
            "__ds": F.abs(F.col("__rs") + q + r),
        }
    )
    fix_q = (F.col("__dq") > F.col("__dr")) & (F.col("__dq") > F.col("__ds"))
    fix_r = ~fix_q & (F.col("__dr") > F.col("__ds"))
    return df.withColumns(
        {
            f"{out}q": F.when(fix_q, -F.col("__rr") - F.col("__rs")).otherwise(F.col("__rq")).cast("int"),
            f"{out}r": F.when(fix_r, -F.col("__rq") - F.col("__rs")).otherwise(F.col("__rr")).cast("int"),
        }
    ).drop("__fq", "__fr", "__rq", "__rr", "__rs", "__dq", "__dr", "__ds")


def hex_centre(cq: Column, cr: Column, size: float) -> tuple[Column, Column]:
    x = F.lit(float(size) * math.sqrt(3)) * (cq + cr / 2)
    y = F.lit(float(size) * 1.5) * cr
    return x, y


def pixel_to_cell(
    df: DataFrame, grid: GridSpec, kind: str = "hex", size: float | tuple[int, int] = 1.0,
    parent_size: float | tuple[int, int] | None = None,
) -> DataFrame:
    """Add ``cell_id`` and ``parent_id``. No polygons, no join, no shuffle.

    ``hex``: ``size`` is the circumradius in CRS units, the parent is the coarse hexagon holding the
    cell's centre. ``square``: ``size`` is (rows, cols) in pixels.
    """
    if kind == "square":
        pr, pc = parent_size or size
        cr, cc = F.floor(F.col("row") / size[0]), F.floor(F.col("col") / size[1])
        return df.withColumns(
            {
                "cell_id": cell_key(cc, cr),
                "parent_id": cell_key(F.floor(F.col("col") / pc), F.floor(F.col("row") / pr)),
            }
        )
    if kind != "hex":
        raise ValueError(f"unknown cell kind {kind!r}")
    df = _hex_of(df, grid.x("col"), grid.y("row"), size, "__c")
    x, y = hex_centre(F.col("__cq"), F.col("__cr"), size)
    df = _hex_of(df, x, y, parent_size or size, "__p")
    return df.withColumns(
        {
            "cell_id": cell_key(F.col("__cq"), F.col("__cr")),
            "parent_id": cell_key(F.col("__pq"), F.col("__pr")),
        }
    ).drop("__cq", "__cr", "__pq", "__pr")


def cell_counts(df: DataFrame, by: Sequence[str] = ("cell_id", "trait"), value: str = "mean") -> DataFrame:
    """Valid pixels per cell and trait (long form)."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def cell_counts_wide(df: DataFrame, traits: Sequence[str], value: str = "mean") -> DataFrame:
    """The same with one column per trait."""
    return df.groupBy("cell_id").agg(
        *[
            F.count_if((F.col("trait") == t) & F.col(value).isNotNull()).alias(f"n_{t}")
            for t in traits
        ]
    )


def cell_presence(df: DataFrame, first_trait: str, value: str = "mean") -> DataFrame:
    """Whether a cell has data, how many traits have a pixel, and the count of the first trait."""
    ok = F.col(value).isNotNull()
    return df.groupBy("cell_id").agg(
        F.bool_or(ok).alias("has_data"),
        F.count_distinct(F.when(ok, F.col("trait"))).alias("n_traits"),
        F.count_if(ok & (F.col("trait") == first_trait)).alias("n_first"),
    )


def neighbour_steps(kind: str) -> list[int]:
    return [q * AXIS + r for q, r in (HEX_STEPS if kind == "hex" else SQUARE_STEPS)]


def same_neighbours(labels: DataFrame, kind: str = "hex") -> DataFrame:
    """Ring-1 neighbours with the cell's own label: one equi-join on the neighbour's id."""
    steps = F.array(*[F.lit(s).cast("bigint") for s in neighbour_steps(kind)])
    near = labels.select(
        F.explode(F.transform(steps, lambda s: F.col("cell_id") + s)).alias("near_id"), "cell_id", "label"
    )
    other = labels.select(F.col("cell_id").alias("near_id"), F.col("label").alias("near_label"))
    hits = near.join(other, "near_id").groupBy("cell_id").agg(
        F.count_if(F.col("near_label") == F.col("label")).alias("n_same")
    )
    return labels.join(hits, "cell_id", "left").na.fill(0, ["n_same"])
