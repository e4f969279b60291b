"""Metrics documents (trait -> metrics) as JSON, and their comparison across runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRIC_STRUCT = (
    "struct<n_valid:bigint,rmse:double,nrmse:double,r2:double,pearson_r:double,mae:double>"
)


def to_metrics_json(metrics: DataFrame) -> DataFrame:
    """One JSON document per run. A run has one entry per trait, so the map is bounded."""
    fields = ["n_valid", "rmse", "nrmse", "r2", "pearson_r", "mae"]
    return metrics.groupBy("run").agg(
        F.to_json(
            F.map_from_entries(F.collect_list(F.struct(F.col("trait"), F.struct(*fields))))
        ).alias("doc")
    )


def metrics_json_scan(df: DataFrame, json_col: str) -> DataFrame:
    """Documents back to rows: run, trait and the metric columns."""
    parsed = F.from_json(F.col(json_col), f"map<string,{METRIC_STRUCT}>")
    return df.select("run", F.explode(parsed).alias("trait", "m")).select("run", "trait", "m.*")


def compare_runs(rows: DataFrame, metric: str, runs: Sequence[str]) -> DataFrame:
    """One row per trait, one column per run."""
    return rows.groupBy("trait").pivot("run", list(runs)).agg(F.first(metric))
