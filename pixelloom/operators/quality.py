"""Data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_sanity(
    merged: DataFrame, band: str = "mean", bands: Sequence[str] = ("mean", "std"), limit: float = 1000.0
) -> DataFrame:
    """Per trait: codes within {0,1,2}, all bands missing exactly where the code is 0, values in range."""
    code = F.coalesce(F.col("source_code").cast("int"), F.lit(0))
    empty = F.lit(True)
    for b in bands:
        empty = empty & F.col(b).isNull()
    in_range = F.lit(True)
    for b in bands:
        in_range = in_range & F.coalesce((F.col(b) > -limit) & (F.col(b) < limit), F.lit(True))
    checks = merged.groupBy("trait").agg(
        F.bool_and(code.isin(0, 1, 2)).alias("codes_ok"),
        F.bool_and(empty == (code == 0)).alias("empty_ok"),
        F.bool_and(in_range).alias("range_ok"),
    )
    ok = F.col("codes_ok") & F.col("empty_ok") & F.col("range_ok")
    return checks.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def split_leakage(chip_pixels: DataFrame) -> DataFrame:
    """Pixels of another split that still carry a target, per chip split; must be 0."""
    return chip_pixels.groupBy("split").agg(
        F.count_if((F.col("pixel_split") != F.col("split")) & F.col("y").isNotNull()).alias("n_leaked"),
        F.count("y").alias("n_kept"),
    )


def trait_coverage(matched: DataFrame) -> DataFrame:
    """Files that matched no parameter row."""
    return matched.filter(F.col("trait").isNull()).drop("trait")


def table_contract(
    df: DataFrame, required: dict[str, str], unique: Sequence[str] = (), known: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Rows (check, subject, n_bad) for missing columns, wrong types, duplicate keys, unknown values."""
    types = dict(df.dtypes)
    schema_rows = [
        ("missing_column", c, 0 if c in types else 1) for c in required
    ] + [("wrong_type", c, 0 if types.get(c, t) == t else 1) for c, t in required.items()]
    report = df.sparkSession.createDataFrame(schema_rows, "check string, subject string, n_bad bigint")
    if unique:
        dup = df.groupBy(*unique).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n_bad"))
        report = report.unionByName(
            dup.select(F.lit("duplicate_key").alias("check"), F.lit(",".join(unique)).alias("subject"), "n_bad")
        )
    if known:
        sums = df.agg(*[F.count_if(~F.col(c).isin(list(v))).alias(c) for c, v in known.items()])
        report = report.unionByName(
            sums.unpivot([], list(known), "subject", "n_bad").select(
                F.lit("unknown_value").alias("check"), "subject", "n_bad"
            )
        )
    return report
