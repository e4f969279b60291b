"""Epoch and run tables: checkpoint selection, early stopping, seed summaries, leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.missing import finite

_STATE = "struct<best:double,best_epoch:int,wait:int,stop:int>"


def selection(
    epochs: DataFrame, mode: str = "max", min_delta: float = 0.0, patience: int | None = None,
    by: Sequence[str] = ("run", "seed"),
) -> DataFrame:
    """Per run: best value, its epoch, and the epoch at which training stops (NULL if it never does).

    An epoch improves when it beats the best so far by more than ``min_delta``; missing values never
    do. A run has at most a few hundred epochs, so folding them in one array is bounded.
    """
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    sign = 1.0 if mode == "max" else -1.0
    by = list(by)
    ordered = epochs.groupBy(*by).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), (finite(F.col("value")) * sign).alias("v")))
        ).alias("e")
    )
    limit = F.lit(patience if patience is not None else 2**31 - 1)
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("best_epoch"),
        F.lit(0).alias("wait"), F.lit(None).cast("int").alias("stop"),
    ).cast(_STATE)

    def step(acc, x):
        better = x["v"].isNotNull() & (acc["best"].isNull() | (x["v"] > acc["best"] + F.lit(float(min_delta))))
        wait = F.when(better, F.lit(0)).otherwise(acc["wait"] + 1)
        moved = F.struct(
            F.when(better, x["v"]).otherwise(acc["best"]).alias("best"),
            F.when(better, x["epoch"]).otherwise(acc["best_epoch"]).alias("best_epoch"),
            wait.alias("wait"),
            F.when(wait >= limit, x["epoch"]).alias("stop"),
        ).cast(_STATE)
        return F.when(acc["stop"].isNotNull(), acc).otherwise(moved)

    state = F.aggregate("e", start, step)
    return ordered.select(*by, state.alias("s")).select(
        *by, (F.col("s.best") * sign).alias("best_value"), "s.best_epoch", F.col("s.stop").alias("stop_epoch")
    )


def best_checkpoint(
    epochs: DataFrame, mode: str = "max", min_delta: float = 0.0, by: Sequence[str] = ("run", "seed")
) -> DataFrame:
    return selection(epochs, mode, min_delta, None, by).drop("stop_epoch")


def early_stop(
    epochs: DataFrame, patience: int, mode: str = "max", min_delta: float = 0.0, by: Sequence[str] = ("run", "seed")
) -> DataFrame:
    """Epochs up to and including the one at which ``patience`` epochs brought no improvement."""
    by = list(by)
    stops = selection(epochs, mode, min_delta, patience, by).select(*by, "stop_epoch")
    return epochs.join(stops, by).filter(
        F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))
    ).drop("stop_epoch")


def seed_summary(runs: DataFrame, by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Mean and sample std over seeds."""
    return runs.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n_seeds")
    )


def leaderboard(runs: DataFrame, metric: str, n: int = 3, descending: bool = True) -> DataFrame:
    """Best ``n`` configurations by a metric; missing metrics last."""
    order = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return runs.orderBy(order, *[c for c in runs.columns if c != metric]).limit(n)
