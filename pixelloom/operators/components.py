"""Connected components of labelled pixels: tiles first, then what touches across tiles, level by level."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.grid import GridSpec
from pixelloom.operators.groups import in_whole_groups
from pixelloom.operators.ranking import exact_quantiles, null_safe_join
from pixelloom.session import cut

# Side of a tile in pixels, and how many tiles (or blocks) a side of the next larger block has.
TILE, FAN = 256, 16


def hook(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches over the edges (u, v)."""
    parent = np.arange(n)
    while len(u):
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        low = np.minimum(pu, pv)
        np.minimum.at(parent, pu, low)
        np.minimum.at(parent, pv, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers of equal labels; each null has a negative number of its own."""
    codes = column.combine_chunks().dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    known = codes.indices.is_valid().to_numpy(zero_copy_only=False)
    numbers = codes.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(known, numbers, -1 - np.arange(len(numbers)))


def _tile_parts(columns: Sequence[str], label: str, grid: GridSpec, tile: Sequence[str]):
    width, size = grid.width, grid.height * grid.width

    def parts(pixels: pa.Table) -> pa.RecordBatch:
        """Adds ``part``, the smallest pixel number of the pixel's component inside the tile, for whole tiles in order."""
        row, col = (pixels.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        starts = np.zeros(len(row), bool)
        for c in tile:
            values = pixels.column(c).combine_chunks().dictionary_encode()
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            starts |= np.diff(values.indices.fill_null(-1).to_numpy(zero_copy_only=False), prepend=-2) != 0
        base = (np.cumsum(starts) - 1) * size
        number, label_of = base + row * width + col, _codes(pixels.column(label))
        nodes, node = np.unique(number, return_inverse=True)
        of_node = np.empty(len(nodes), np.int64)
        of_node[node] = label_of
        u, v = [], []
        for step, there in ((1, (nodes + 1) % width != 0), (width, nodes % size + width < size)):
            at = np.searchsorted(nodes, nodes + step)
            at[at == len(nodes)] = 0
            linked = there & (nodes[at] == nodes + step) & (of_node[at] == of_node)
            u.append(np.flatnonzero(linked))
            v.append(at[linked])
        root = nodes[hook(len(nodes), np.concatenate(u), np.concatenate(v))]
        found = pixels.select(list(columns)).append_column("part", pa.array(root[node] % size, pa.int64()))
        return found.combine_chunks().to_batches()[0]

    return parts


def _block_roots(keys: Sequence[str]):
    def roots(edges: pa.Table) -> pa.Table:
        """``part, root`` for the parts that the edges of one block connect, where they differ."""
        u, v = edges.column("u").to_numpy(), edges.column("v").to_numpy()
        nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = nodes[hook(len(nodes), ends[: len(u)], ends[len(u) :])]
        moved = root != nodes
        n = int(moved.sum())
        by = [edges.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in keys]
        return pa.table([*by, pa.array(nodes[moved]), pa.array(root[moved])], names=[*keys, "part", "root"])

    return roots


def _follow(df: DataFrame, column: str, roots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``column`` replaced by its root where it has one."""
    found = null_safe_join(df, roots.withColumnRenamed("part", column), [*keys, column], "left")
    return found.withColumn(column, F.coalesce("root", column)).drop("root")


def components(df: DataFrame, label: str, grid: GridSpec, by: Sequence[str] = ()) -> DataFrame:
    """4-connected components of equal label: adds ``component``, the smallest pixel number in it.

    ``df`` has one row per ``by``, row and col. Each tile is solved by itself, at most TILE * TILE pixels; tiles
    with few pixels share a call. What touches across tiles becomes an edge between two tile components, filed under the smallest block
    that holds both: a block has FAN * FAN tiles, the next one FAN * FAN blocks, until one block is the grid. Each level
    solves its blocks independently and hands the roots up. So the number of steps follows from the size of the
    grid, not from the shape of the components; one that spans the map is many small ones until the last step.
    Missing labels connect to nothing. Every level is written to the shared folder.
    """
    keys = list(by)
    tile = [F.floor(F.col(c) / TILE).cast("int").alias(f"__t{c}") for c in ("row", "col")]
    placed = df.select("*", *tile)
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.LongType())])
    at = [*keys, "__trow", "__tcol"]
    solve = in_whole_groups(_tile_parts(df.columns, label, grid, at), at)
    tiled = cut(placed.repartition(*at).sortWithinPartitions(*at).mapInArrow(solve, schema), "tiles")

    last_row, last_col = F.col("row") % TILE == TILE - 1, F.col("col") % TILE == TILE - 1
    first_row, first_col = F.col("row") % TILE == 0, F.col("col") % TILE == 0
    own = [F.floor(F.col(c) / TILE).alias(f"t{c}") for c in ("row", "col")]
    low = [F.col(label).alias("__l"), F.col("part").alias("u"), *own]
    below = tiled.filter(last_row).select(*keys, (F.col("row") + 1).alias("row"), "col", *low)
    right = tiled.filter(last_col).select(*keys, "row", (F.col("col") + 1).alias("col"), *low)
    near = tiled.filter(first_row | first_col).select(*keys, "row", "col", F.col(label).alias("__m"), F.col("part").alias("v"))
    touching = null_safe_join(below.unionByName(right), near, [*keys, "row", "col"]).filter(F.col("__l") == F.col("__m"))
    levels, side = 1, FAN * TILE
    while side < max(grid.height, grid.width):
        levels, side = levels + 1, side * FAN
    at = F.lit(levels)
    for k in reversed(range(1, levels)):
        inside = F.lit(True)
        for c in ("row", "col"):
            inside &= F.floor(F.col(f"t{c}") / FAN**k) == F.floor(F.col(c) / (TILE * FAN**k))
        at = F.when(inside, k).otherwise(at)
    edges = cut(touching.select(*keys, "u", "v", "trow", "tcol", at.alias("level")).distinct(), "edges")

    roots = None
    for k in range(1, levels + 1):
        mine = edges.filter(F.col("level") == k)
        if roots is not None:
            mine = _follow(_follow(mine, "u", roots, keys), "v", roots, keys)
        block = [F.floor(F.col(c) / FAN**k).alias(f"b{c}") for c in ("trow", "tcol")]
        kinds = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys] + ["part bigint", "root bigint"])
        found = mine.select(*keys, "u", "v", *block).groupBy(*keys, "btrow", "btcol").applyInArrow(_block_roots(keys), kinds)
        found = cut(found, "roots")
        roots = found if roots is None else cut(_compose(roots, found, keys), "roots")
    return _follow(tiled, "part", roots, keys).withColumnRenamed("part", "component")


def _compose(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roots of ``old`` moved on to those of ``new``, and the parts that only ``new`` moves."""
    onward = new.select(*keys, F.col("root").alias("__next"), F.col("part").alias("root"))
    moved = null_safe_join(old, onward, [*keys, "root"], "left").withColumn("root", F.coalesce("__next", "root")).drop("__next")
    return moved.unionByName(new)


def component_sizes(parts: DataFrame, label: str, pixel_km2: float, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` and label: number of components and their size in pixels and km2, with the mean's diameter."""
    sizes = parts.groupBy(*by, label, "component").agg(F.count(F.lit(1)).alias("px"))
    sizes = cut(sizes, "sizes")
    stats = exact_quantiles(
        sizes, [*by, label], "px", {"median_px": 0.5},
        [
            F.count(F.lit(1)).alias("n_components"), F.sum("px").alias("n_pixels"), F.min("px").alias("min_px"),
            F.max("px").alias("max_px"), F.avg("px").alias("mean_px"),
        ],
    )
    km2 = F.lit(float(pixel_km2))
    return stats.withColumns(
        {
            "min_km2": F.col("min_px") * km2, "max_km2": F.col("max_px") * km2,
            "mean_km2": F.col("mean_px") * km2, "median_km2": F.col("median_px") * km2,
            "total_km2": F.col("n_pixels") * km2,
            "diameter_km": F.sqrt(F.col("mean_px") * km2 / F.pi()) * 2,
        }
    )
