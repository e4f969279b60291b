"""Polygon zones and zonal coverage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.grid import GridSpec
from pixelloom.session import cut

NO_ZONE = -1
# Grid rows whose zone runs are worked out together; their number of polygon crossings bounds a group.
STRIPE = 16
AUX, PRIMARY = 1, 2


def zone_edges(zones: DataFrame) -> DataFrame:
    """``ord, zone_id, ax, ay, bx, by``: the edges of all rings (array of struct<x, y>, open or closed)."""
    n = F.size("ring")
    ahead = F.concat(F.slice("ring", F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice("ring", 1, 1))
    edges = F.zip_with(
        "ring", ahead, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    )
    return zones.select("ord", "zone_id", F.explode(edges).alias("e")).select("ord", "zone_id", "e.*")


def zone_crossings(zones: DataFrame, grid: GridSpec) -> DataFrame:
    """``row, ord, zone_id, k``: the first column right of where an edge crosses the centre line of a grid row.

    An edge counts when its half-open y-range holds the line. Rows and columns come from arithmetic and are then
    moved to where the comparison of the coordinates themselves puts them.
    """
    top, bottom = F.greatest("ay", "by"), F.least("ay", "by")
    first = F.greatest(F.floor(grid.fractional_row(top) - F.lit(0.5)), F.lit(0)).cast("int")
    last = F.least(F.floor(grid.fractional_row(bottom) - F.lit(0.5)) + 1, F.lit(grid.height - 1)).cast("int")
    rows = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    hits = zone_edges(zones).withColumn("row", F.explode(rows)).withColumn("__y", grid.y("row"))
    y = F.col("__y")
    hits = hits.filter((F.col("ay") > y) != (F.col("by") > y)).withColumn(
        "at", F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    )
    k = F.ceil(grid.fractional_col("at") - F.lit(0.5))
    hits = hits.withColumn("k", F.greatest(F.least(k, F.lit(grid.width)), F.lit(0)).cast("int"))
    k, at = F.col("k"), F.col("at")
    k = F.when((k > 0) & (grid.x(k - 1) >= at), k - 1).when((k < grid.width) & (grid.x(k) < at), k + 1).otherwise(k)
    return hits.select("row", "ord", "zone_id", k.alias("k"))


def zone_runs(zones: DataFrame, grid: GridSpec, stripe: int = STRIPE) -> DataFrame:
    """``row, col, zone_id``: from ``col`` on, up to the next run of the row, this zone lies on top (-1: none).

    A pixel is in a polygon when the crossings up to it are odd in number, so a polygon's crossings of a row, sorted
    and counted, open and close its spans in turn; crossings at one column cancel in pairs. Rows of the zone table
    with the same ``ord`` and ``zone_id`` are one polygon, which is how holes and islands are written. Where spans
    of several polygons overlap, the last ``ord`` wins: the spans of a stripe of rows are cut at all their ends, and
    the pieces keep their greatest ``ord``.
    """
    odd = (
        zone_crossings(zones, grid).groupBy("row", "ord", "zone_id", "k").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") % 2 == 1)
    )
    w = W.partitionBy("row", "ord", "zone_id").orderBy("k")
    spans = (
        odd.withColumns({"nth": F.row_number().over(w), "to": F.lead("k").over(w)}).filter("nth % 2 = 1 and k < to")
        .select("row", "k", "to", F.col("ord").cast("bigint").alias("ord"), "zone_id", F.floor(F.col("row") / stripe).alias("stripe"))
    )
    zone_type = zones.schema["zone_id"].dataType.simpleString()
    return spans.groupBy("stripe").applyInArrow(_top_runs, f"row int, col int, zone_id {zone_type}")


def _top_runs(spans: pa.Table) -> pa.Table:
    row, lo, hi, order = (spans.column(c).to_numpy().astype(np.int64) for c in ("row", "k", "to", "ord"))
    zone = spans.column("zone_id").to_numpy()
    wide = int(hi.max()) + 1
    cuts = np.unique(np.concatenate((row * wide + lo, row * wide + hi)))
    first, last = np.searchsorted(cuts, row * wide + lo), np.searchsorted(cuts, row * wide + hi)
    pieces = last - first
    owner = np.repeat(np.arange(len(row)), pieces)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[owner]
    by_order = np.lexsort((zone[owner], order[owner], piece))
    piece, owner = piece[by_order], owner[by_order]
    top = np.append(piece[1:] != piece[:-1], True)
    zones = np.full(len(cuts), NO_ZONE, zone.dtype)
    zones[piece[top]] = zone[owner[top]]
    # a run begins where the zone changes or the row does
    begins = np.append(True, (zones[1:] != zones[:-1]) | (cuts[1:] // wide != cuts[:-1] // wide))
    found = {"row": (cuts[begins] // wide).astype(np.int32), "col": (cuts[begins] % wide).astype(np.int32), "zone_id": zones[begins]}
    return pa.table(found)


def pixel_to_zone(df: DataFrame, zones: DataFrame, grid: GridSpec) -> DataFrame:
    """Zone of each pixel centre: the last polygon (``ord``) holding it, -1 for none.

    Polygons are turned into runs of zones along the grid rows once; a pixel takes the last run that begins at or
    before it in its row, from one sort by row and column. Polygons of any size and number need no bucket, no copy
    of their rings and no test per pixel, and a row of pixels is the largest unit that one task must sort.
    """
    runs = zone_runs(zones, grid).select("row", "col", F.lit(0).alias("__k"), F.col("zone_id").alias("__z"))
    fields = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__pixel")
    pixels = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.lit(1).alias("__k"), fields)
    w = W.partitionBy("row").orderBy("col", "__k").rowsBetween(W.unboundedPreceding, 0)
    zone = F.coalesce(F.last("__z", ignorenulls=True).over(w), F.lit(NO_ZONE)).alias("zone_id")
    placed = pixels.unionByName(runs, allowMissingColumns=True).select("__k", "__pixel", zone).filter("__k = 1")
    return placed.select(*[F.col("__pixel")[c].alias(c) for c in df.columns if c != "zone_id"], "zone_id")


def zonal_coverage(merged: DataFrame, pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone table: pixels, and over traits the mean valid / aux / primary pixels and shares.

    ``merged`` (one row per pixel and trait with ``zone_id`` and ``source_code``) and ``pixels`` (one
    row per pixel with ``zone_id``) are only counted; everything after is one row per zone and trait.
    A trait without pixels in a zone counts as 0 valid and is skipped in the source shares. Sections:
    0 named zones, 1 the zone named 'N/A', 2 the total.
    """
    total = pixels.filter(F.col("zone_id") != NO_ZONE).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_total"))
    code = F.col("source_code")
    counts = merged.groupBy("zone_id", "trait").agg(
        F.count_if(code == AUX).alias("n_aux"), F.count_if(code == PRIMARY).alias("n_primary")
    )
    counts = cut(counts, "counts")
    return _coverage_table(counts, total, zones, counts.select("trait").distinct().count())


def zonal_coverage_wide(pixels: DataFrame, zones: DataFrame, traits: Sequence[str]) -> DataFrame:
    """The same from one row per pixel: ``zone_id``, whether it is ``on_land``, and a source code column per trait.

    No row is ever repeated per trait: a pixel is placed and counted once, and the traits unfold in the counts.
    """
    per_trait = [F.count_if(F.col(t) == code).alias(f"{t}__{code}") for t in traits for code in (AUX, PRIMARY)]
    per_zone = pixels.groupBy("zone_id").agg(F.count_if("on_land").alias("n_total"), *per_trait)
    per_zone = cut(per_zone, "counts")
    rows = [F.struct(F.lit(t).alias("trait"), F.col(f"{t}__{AUX}").alias("n_aux"), F.col(f"{t}__{PRIMARY}").alias("n_primary")) for t in traits]
    counts = per_zone.select("zone_id", F.inline(F.array(*rows)))
    total = per_zone.filter((F.col("zone_id") != NO_ZONE) & (F.col("n_total") > 0)).select("zone_id", "n_total")
    return _coverage_table(counts, total, zones, len(traits))


def _coverage_table(counts: DataFrame, total: DataFrame, zones: DataFrame, n_traits: int) -> DataFrame:
    valid = F.col("n_aux") + F.col("n_primary")
    sums = counts.filter((F.col("zone_id") != NO_ZONE) & (valid > 0)).groupBy("zone_id").agg(
        F.sum("n_aux").alias("aux"), F.sum("n_primary").alias("primary"),
        F.avg(F.try_divide("n_aux", valid)).alias("aux_share"),
        F.avg(F.try_divide("n_primary", valid)).alias("primary_share"),
    )
    names = _zone_names(zones)
    per_zone = (
        names.join(total, "zone_id", "left").join(sums, "zone_id", "left")
        .na.fill(0, ["n_total", "aux", "primary"])
        .select(
            F.when(F.col("name") == "N/A", 1).otherwise(0).alias("section"), "zone_id", "name", "n_total",
            ((F.col("aux") + F.col("primary")) / F.lit(n_traits)).alias("valid_px"),
            F.try_divide(F.col("aux") + F.col("primary"), F.col("n_total") * n_traits).alias("valid_share"),
            (F.col("aux") / F.lit(n_traits)).alias("aux_px"), "aux_share",
            (F.col("primary") / F.lit(n_traits)).alias("primary_px"), "primary_share",
        )
    )
    px, shares = ["n_total", "valid_px", "aux_px", "primary_px"], ["valid_share", "aux_share", "primary_share"]
    whole = per_zone.agg(
        *[F.sum(c).alias(c) for c in px], *[F.avg(c).alias(c) for c in shares]
    ).select(
        F.lit(2).alias("section"), F.lit(None).cast("int").alias("zone_id"), F.lit("TOTAL").alias("name"), *px, *shares
    )
    return per_zone.unionByName(whole)


def zone_sizes(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """``section, name, n_total`` of :func:`zonal_coverage` alone, from land pixels with ``zone_id``."""
    total = pixels.filter(F.col("zone_id") != NO_ZONE).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_total"))
    sized = _zone_names(zones).join(total, "zone_id", "left").na.fill(0, ["n_total"])
    each = sized.select(F.when(F.col("name") == "N/A", 1).otherwise(0).alias("section"), "name", "n_total")
    return each.unionByName(each.agg(F.lit(2).alias("section"), F.lit("TOTAL").alias("name"), F.sum("n_total").alias("n_total")))


def _zone_names(zones: DataFrame) -> DataFrame:
    return zones.groupBy("zone_id").agg(F.max_by("name", "ord").alias("name")) if "ord" in zones.columns else zones.select("zone_id", "name")


def zone_order(coverage: DataFrame) -> DataFrame:
    """Named zones by size, then N/A, then the total."""
    return coverage.orderBy("section", F.desc("n_total"), "name")
