"""Profiles of rasters, files and size distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions.missing import finite
from pixelloom.grid import GridSpec
from pixelloom.operators.ranking import exact_quantiles, null_safe_join
from pixelloom.operators.scan import previous, running_sum
from pixelloom.session import cut, small_side


def describe(df: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """n, min, median, mean, max, population std of the finite values; n = 0 and NULLs without any."""
    clean = df.select(*by, finite(F.col(value).cast("double")).alias("v"))
    return exact_quantiles(
        clean, by, "v", {"median": 0.5},
        [F.count("v").alias("n"), F.min("v").alias("v_min"), F.avg("v").alias("v_mean"),
         F.max("v").alias("v_max"), F.stddev_pop("v").alias("v_std")],
    )


def raster_summary(df: DataFrame, by: Sequence[str] = ("file",), value: str = "value") -> DataFrame:
    """Per file: valid and missing pixels, min, max, mean, std, p1, p99."""
    clean = df.select(*by, finite(F.col(value).cast("double")).alias("v"))
    return exact_quantiles(
        clean, by, "v", {"p1": 0.01, "p99": 0.99},
        [F.count("v").alias("n_valid"), F.count_if(F.col("v").isNull()).alias("n_nodata"),
         F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"),
         F.stddev_pop("v").alias("v_std")],
    )


def seasonal_mean(df: DataFrame, by: Sequence[str] = ("month",), value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def name_parse_inventory(parsed: DataFrame) -> DataFrame:
    """Distinct properties, depths and statistics of parsed names (vocabularies, hence bounded)."""
    return parsed.agg(
        *[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("property", "depth", "stat")],
        F.count(F.lit(1)).alias("n_files"),
    )


def dataset_inventory(df: DataFrame) -> DataFrame:
    """Per dataset: chips, channels and sorted band names."""
    chips = df.select("dataset", "chip_id").distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("n_chips"))
    bands = df.select("dataset", "band").distinct().groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_channels"), F.sort_array(F.collect_set("band")).alias("bands")
    )
    return chips.join(bands, "dataset")


def run_summary(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_files"))


def histogram_pair(
    df: DataFrame, bins: int = 80, lo: float = 0.01, hi: float = 0.99, by: Sequence[str] = ()
) -> DataFrame:
    """Densities of two samples (``sample, value``) on shared edges between two joint percentiles, per ``by``.

    Values outside the edges are not counted, as in a plotted histogram; the last bin is closed. A group whose edges
    coincide has no bins.
    """
    keys = ["__group"] if not by else list(by)
    df = df.withColumn("__group", F.lit(0)) if not by else df
    edges = exact_quantiles(df, keys, "value", {"lo": lo, "hi": hi}).filter("hi > lo")
    edges = edges.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    inside = null_safe_join(df, edges, keys).filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
    index = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*keys, "sample", "lo", "width", index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys, "sample"))
    return counts.select(
        *by, "sample", "bin", "n", F.try_divide(F.col("n"), total * F.col("width")).alias("density"),
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
    )


def box_stats(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Quartiles and 1.5-IQR whiskers (the most extreme values within them) per group."""
    by = list(by)
    clean = df.select(*by, F.col(value).cast("double").alias("v")).filter("v is not null")
    q = small_side(exact_quantiles(clean, by, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    span = (F.col("q3") - F.col("q1")) * 1.5
    inside = clean.join(q, by).filter(
        (F.col("v") >= F.col("q1") - span) & (F.col("v") <= F.col("q3") + span)
    )
    whiskers = inside.groupBy(*by).agg(F.min("v").alias("whisker_lo"), F.max("v").alias("whisker_hi"))
    return q.join(whiskers, by)


def log_histogram(df: DataFrame, by: Sequence[str], value: str, bins_per_decade: int = 4) -> DataFrame:
    """Counts of positive values in equal steps of log10."""
    step = F.floor(F.log10(value) * bins_per_decade).cast("int")
    return df.filter(F.col(value) > 0).groupBy(*by, step.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def spacing(df: DataFrame, axis: str) -> DataFrame:
    """Median step between sorted distinct coordinates, and their range. NULL coordinates are left out."""
    known = df.select(axis).filter(F.col(axis).isNotNull()).distinct()
    steps = previous(known, axis).withColumn("d", F.col(axis) - F.col("before"))
    return steps.agg(
        F.percentile("d", 0.5).alias("step"), F.min(axis).alias("lo"), F.max(axis).alias("hi")
    )


def grid_infer(df: DataFrame, crs: str = "EPSG:6933") -> tuple[GridSpec, DataFrame]:
    """Grid of scattered pixel centres, and the points with row (north up) and col."""
    x, y = spacing(df, "x").first(), spacing(df, "y").first()
    dx, dy = x["step"], y["step"]
    if not dx or not dy:
        raise ValueError("at least two distinct coordinates per axis are needed")
    grid = GridSpec(
        crs, dx, x["lo"] - dx / 2, -dy, y["hi"] + dy / 2,
        round((y["hi"] - y["lo"]) / dy) + 1, round((x["hi"] - x["lo"]) / dx) + 1,
    )
    placed = df.withColumns(
        {
            "row": F.rint((F.lit(y["hi"]) - F.col("y")) / F.lit(dy)).cast("int"),
            "col": F.rint((F.col("x") - F.lit(x["lo"])) / F.lit(dx)).cast("int"),
        }
    )
    return grid, placed


def cdf(df: DataFrame, value: str) -> DataFrame:
    """Cumulative share of sizes not above each distinct value, counted from NULL on."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    summed = cut(running_sum(counts, value, "n"), "cdf")
    total = F.lit(summed.agg(F.max("upto")).first()[0])
    return summed.select(value, "n", F.try_divide("upto", total).alias("cum_share"))


def deciles(df: DataFrame, value: str) -> DataFrame:
    return exact_quantiles(df, [], value, {f"p{p}": p / 100 for p in range(10, 100, 10)})
