"""Scoring predictor vectors and a linear per-pixel baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.missing import finite
from pixelloom.functions.vectors import dot, sanitise_vector
from pixelloom.operators.masks import predictor_validity
from pixelloom.operators.ranking import null_safe_join


def score_batch(
    df: DataFrame, model: Callable[[np.ndarray], np.ndarray] | Sequence[float], intercept: float = 0.0,
    vec: str = "vec", out: str = "score", mode: str = "min_fraction", min_ratio: float = 0.2,
) -> DataFrame:
    """Score sanitised vectors, missing where the pixel is invalid.

    Coefficients stay a column expression; an opaque model runs on Arrow batches and is shipped once
    per task.
    """
    checked = predictor_validity(df, vec, mode, min_ratio, "__ok").withColumn(
        "__clean", sanitise_vector(F.col(vec))
    )
    if not callable(model):
        weights = F.array(*[F.lit(float(w)) for w in model])
        score = dot(F.col("__clean"), weights) + F.lit(float(intercept))
        return checked.withColumn(out, F.when(F.col("__ok"), score)).drop("__ok", "__clean")

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if len(vectors):
                yield pd.Series(np.asarray(model(np.stack(vectors.to_numpy())), dtype=float).reshape(-1))
            else:
                yield pd.Series([], dtype=float)

    return checked.withColumn(out, F.when(F.col("__ok"), run("__clean"))).drop("__ok", "__clean")


def linear_baseline(
    train: DataFrame, features: str | Sequence[str], label: str = "y", weight: str | None = None,
    reg: float = 0.0,
) -> LinearRegressionModel:
    """Per-pixel linear model with source weights, fitted by MLlib's distributed normal equations."""
    if isinstance(features, str):
        data = train.withColumn("features", array_to_vector(sanitise_vector(F.col(features)).cast("array<double>")))
    else:
        data = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(train)
    data = data.filter(F.col(label).isNotNull())
    lr = LinearRegression(labelCol=label, regParam=reg, solver="normal")
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(data)


def _normal_sums(batch: pa.RecordBatch, keys: Sequence[str], n: int) -> dict[tuple, np.ndarray]:
    """Per group, the weighted outer product of (1, features, label) with itself, summed over the rows."""
    columns = [batch.column(c).to_pylist() for c in keys]
    group = np.zeros(batch.num_rows, np.int64)
    number: dict[tuple, int] = {}
    for i, key in enumerate(zip(*columns) if keys else [()] * batch.num_rows):
        group[i] = number.setdefault(key, len(number))
    values = np.column_stack([np.ones(batch.num_rows), *(batch.column(f"x{i}").to_numpy() for i in range(n)), batch.column("y").to_numpy()])
    weighted = values * batch.column("w").to_numpy()[:, None]
    return {key: weighted[group == k].T @ values[group == k] for key, k in number.items()}


def linear_baselines(
    train: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = None, by: Sequence[str] = ("trait",),
    reg: float = 0.0,
) -> DataFrame:
    """``by, total_weight, intercept, coefficients``: a weighted least-squares fit of every group.

    A task adds up one matrix of outer products a group and batch, these are added up per group, and each group's normal
    equations are solved from the Cholesky factor of its centred matrix. So the rows are read once and what is shuffled
    does not grow with them. ``reg`` is added to the mean square of each centred feature. Rows with a missing or non-finite
    value are left out; a group whose features depend on each other has NULL coefficients.
    """
    keys, n = list(by), len(features)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    used = train.select(*keys, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"), w.alias("w"))
    for c in [*(f"x{i}" for i in range(n)), "y", "w"]:
        used = used.filter(finite(F.col(c)).isNotNull())
    kinds = "".join(f"`{c}` {train.schema[c].dataType.simpleString()}, " for c in keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            schema = batch.schema
            for key, m in _normal_sums(batch, keys, n).items():
                held[key] = held[key] + m if key in held else m
        if held:
            columns = [pa.array(c, schema.field(k).type) for k, c in zip(keys, zip(*held))] if keys else []
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))], names=[*keys, "sums"])

    def solve(parts: pa.Table) -> pa.Table:
        m = np.sum([np.array(s) for s in parts.column("sums").to_pylist()], axis=0).reshape(n + 2, n + 2)
        total, means = m[0, 0], m[0] / m[0, 0]
        centred = m[1:, 1:] / total - np.outer(means[1:], means[1:])
        try:
            low = np.linalg.cholesky(centred[:n, :n] + reg * np.eye(n))
            slopes = np.linalg.solve(low.T, np.linalg.solve(low, centred[:n, n]))
            found = [float(means[n + 1] - slopes @ means[1 : n + 1])], [slopes.tolist()]
        except np.linalg.LinAlgError:
            found = [None], [None]
        heads = [parts.column(c).slice(0, 1).combine_chunks() for c in keys]
        columns = [*heads, pa.array([float(total)]), pa.array(found[0], pa.float64()), pa.array(found[1], pa.list_(pa.float64()))]
        return pa.table(columns, names=[*keys, "total_weight", "intercept", "coefficients"])

    sums = used.mapInArrow(partial, kinds + "sums array<double>")
    if not keys:
        sums, kinds = sums.withColumn("__all", F.lit(0)), ""
        return sums.groupBy("__all").applyInArrow(lambda t: solve(t.drop_columns(["__all"])), "total_weight double, intercept double, coefficients array<double>")
    return sums.groupBy(*keys).applyInArrow(solve, kinds + "total_weight double, intercept double, coefficients array<double>")


def score_baselines(df: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str] = ("trait",), out: str = "score") -> DataFrame:
    """Rows with the score of their group's model; missing where a feature or the model is."""
    fitted = models.select(*by, F.col("intercept").alias("__b"), F.col("coefficients").alias("__c"))
    parts = [F.col("__c")[i] * finite(F.col(c).cast("double")) for i, c in enumerate(features)]
    return null_safe_join(df, fitted, by, "left").withColumn(out, sum(parts, F.col("__b"))).drop("__b", "__c")


def ensemble_scores(scores: DataFrame, by: Sequence[str] = ("row", "col", "trait")) -> DataFrame:
    """Mean and spread over seeds per pixel."""
    return scores.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
