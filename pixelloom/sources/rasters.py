"""Point tables to pixels: column scans, grid snapping, routing, band order, nodata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.missing import normalise_missing
from pixelloom.grid import GridSpec


def scan_predictors(
    spark: SparkSession, path: str, cols: Sequence[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Coordinates and the chosen predictors only; Parquet reads no other column."""
    return spark.read.parquet(path).select(F.col(x).alias("x"), F.col(y).alias("y"), *cols)


def grid_snap(
    df: DataFrame, grid: GridSpec, x: str = "x", y: str = "y", ordinal: str | Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nearest pixel of each point (half-even) and a one-row count of points off the grid.

    With ``ordinal``, the last point of a pixel wins; ``max_by`` combines map-side, so a pixel with
    very many points stays cheap.
    """
    placed = df.withColumns(
        {
            "row": F.rint(grid.fractional_row(y) - 0.5).cast("int"),
            "col": F.rint(grid.fractional_col(x) - 0.5).cast("int"),
        }
    )
    inside = grid.contains("row", "col")
    dropped = placed.agg(
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_dropped"), F.count(F.lit(1)).alias("n_points")
    )
    kept = placed.filter(inside)
    if ordinal is None:
        return kept.drop(x, y), dropped
    keys = [ordinal] if isinstance(ordinal, str) else list(ordinal)
    values = [c for c in df.columns if c not in (x, y, *keys)]
    last = kept.groupBy("row", "col").agg(
        F.max_by(F.struct(*values), F.struct(*keys)).alias("__s")
    )
    return last.select("row", "col", "__s.*"), dropped


def predictor_route(
    df: DataFrame, rules: dict[str, str], fallback: str, variable: str = "variable", out: str = "grp"
) -> DataFrame:
    """Group of a predictor by name prefix (first matching rule), else ``fallback``."""
    group = F.lit(fallback)
    for prefix, name in reversed(rules.items()):
        group = F.when(F.col(variable).startswith(prefix), name).otherwise(group)
    return df.withColumn(out, group)


def nodata_normalise(
    df: DataFrame, value: str, sentinels: Sequence[float], isclose: bool = True
) -> DataFrame:
    """Sentinels, NaN and infinities become NULL."""
    return df.withColumn(value, normalise_missing(F.col(value), sentinels, isclose))


def band_reorder(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Bands in the requested order, matched by lower-cased name; a missing band is an error."""
    by_name = {c.lower(): c for c in df.columns if c not in keys}
    absent = [b for b in order if b.lower() not in by_name]
    if absent:
        raise ValueError(f"bands not found: {absent}")
    return df.select(*keys, *[F.col(by_name[b.lower()]).alias(b.lower()) for b in order])


def band_array(df: DataFrame, names: str, values: str, order: Sequence[str], out: str = "bands") -> DataFrame:
    """The same on rows holding parallel arrays of band names and values."""
    lowered = F.map_from_arrays(F.transform(names, F.lower), F.col(values))
    return df.withColumn(out, F.array(*[F.try_element_at(lowered, F.lit(b.lower())) for b in order]))


def name_parse(files: DataFrame, name: str = "name") -> DataFrame:
    """Split ``property_depth_stat`` names into their parts."""
    stem = F.regexp_replace(F.col(name), r"\.tif$", "")
    parts = F.split(stem, "_")
    return files.withColumns(
        {
            "property": F.get(parts, F.lit(0)),
            "depth": F.get(parts, F.lit(1)),
            "stat": F.get(parts, F.lit(2)),
        }
    )
