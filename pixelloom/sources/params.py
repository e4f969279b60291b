"""Transform parameters and spatial folds from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.transforms import LAMBDA, MEAN, SCALE, check_params


def params_load(spark: SparkSession, path: str, key: tuple[str, ...] = ("trait", "variable")) -> DataFrame:
    """Parameter CSV with checked columns, ids without the leading X, duplicates rejected."""
    raw = spark.read.option("header", True).csv(path)
    return check_params(raw, key)


def params_save(params: DataFrame, path: str) -> None:
    params.select("trait", LAMBDA, MEAN, SCALE).write.option("header", True).csv(path)


def folds_scan(spark: SparkSession, glob: str) -> DataFrame:
    """Fold points of many Parquet files or folders named after their trait."""
    return spark.read.schema("x double, y double, fold int").parquet(glob).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.parquet(?:/[^/]*)?$", 1).alias("trait"),
        "x", "y", "fold",
    )


def folds_shape(folds: DataFrame) -> DataFrame:
    """Rows and distinct folds per trait, to see whether all files have one shape."""
    return folds.groupBy("trait").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("fold").alias("n_folds")
    )
