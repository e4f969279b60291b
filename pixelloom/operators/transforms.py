"""Normalisation parameters joined to pixels: denormalise, fit, compare."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.missing import INF, finite, normalise_missing
from pixelloom.functions.power import (
    EPS,
    clip_inverse_domain,
    inverse_yeo_johnson,
    yeo_johnson,
    yeo_johnson_core,
)
from pixelloom.operators.ranking import exact_quantiles
from pixelloom.operators.sampling import sample_exact
from pixelloom.session import cut, small_side

LAMBDA, MEAN, SCALE = "yeo_johnson_lambda", "standardize_mean", "standardize_scale"


@dataclass(frozen=True)
class DenormOptions:
    clip_z: float | None = None
    clip_domain: bool = True
    eps: float = EPS
    ratio: float = 0.0
    abs_: float = 0.0
    cap: float | None = None

    def unclipped(self) -> "DenormOptions":
        """Options for truth: every clip off."""
        return replace(self, clip_z=None, clip_domain=False, ratio=0.0, abs_=0.0, cap=None)


def to_physical(df: DataFrame, rules: DataFrame, value: str = "v", key: str = "variable") -> DataFrame:
    """Mask nodata, apply ``v*scale+offset``, drop values outside [valid_min, valid_max].

    A rule without scale leaves values unscaled, whatever its offset.
    """
    v = F.col(value)
    nodata = F.col("nodata")
    close = F.abs(v - nodata) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(nodata)
    masked = F.when(nodata.isNull() | ~close, finite(v))
    scaled = F.when(F.col("scale").isNull(), masked).otherwise(masked * F.col("scale") + F.coalesce("offset", F.lit(0.0)))
    rule_cols = ["nodata", "scale", "offset", "valid_min", "valid_max"]
    return (
        df.join(small_side(rules.select(key, *rule_cols)), key, "left")
        .withColumn(value, scaled)
        .withColumn(
            value,
            F.when(
                F.coalesce(v >= F.col("valid_min"), F.lit(True))
                & F.coalesce(v <= F.col("valid_max"), F.lit(True)),
                v,
            ),
        )
        .drop(*rule_cols)
    )


def params_join(df: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """Attach transform parameters by trait; the parameter table is broadcast if it is small."""
    return df.join(small_side(params.select("trait", LAMBDA, MEAN, SCALE)), "trait", how)


def _clamped(v: Column, limit: float) -> Column:
    return F.when(v > limit, F.lit(float(limit))).when(v < -limit, F.lit(-float(limit))).otherwise(v)


def denormalised(df: DataFrame, value: str, o: DenormOptions, out: str) -> DataFrame:
    """Add ``out``: clip z, undo the z-score, clip to the domain, invert, cap.

    One projection per step: a single nested expression would repeat its input hundreds of times
    and outgrow generated code.
    """
    lam, y = F.col(LAMBDA), F.col("__y")
    z = finite(F.col(value))
    df = df.withColumn("__y", z)
    if o.clip_z is not None:
        df = df.withColumn("__y", _clamped(y, o.clip_z))
    df = df.withColumn("__y", y * F.col(SCALE) + F.col(MEAN))
    if o.clip_domain:
        df = df.withColumn("__y", clip_inverse_domain(y, lam, o.eps, o.ratio, o.abs_))
    df = df.withColumn("__y", inverse_yeo_johnson(y, lam))
    if o.cap is not None:
        df = df.withColumn("__y", _clamped(y, o.cap))
    return df.withColumn(out, finite(y)).drop("__y")


def denormalise(
    df: DataFrame, params: DataFrame, options: DenormOptions = DenormOptions(),
    value: str = "value", out: str = "physical",
) -> DataFrame:
    """Back to original units; a trait without parameters is an error."""
    unknown = F.raise_error(F.concat(F.lit("no transform parameters for trait "), F.col("trait")))
    known = params_join(df, params, "left").withColumn(
        LAMBDA, F.when(F.col(LAMBDA).isNull(), unknown.cast("double")).otherwise(F.col(LAMBDA))
    )
    return denormalised(known, value, options, out).drop(LAMBDA, MEAN, SCALE)


def denormalise_all(
    df: DataFrame, params: DataFrame, how: str = "keep", options: DenormOptions = DenormOptions(),
    value: str = "value", out: str = "physical",
) -> tuple[DataFrame, DataFrame]:
    """Batch form. Traits without parameters stay as NULL (``keep``, for maps) or go (``drop``, for
    metrics); the second frame lists them."""
    if how not in ("keep", "drop"):
        raise ValueError("how must be 'keep' or 'drop'")
    joined = params_join(df, params, "left" if how == "keep" else "inner")
    done = denormalised(joined, value, options, out).drop(LAMBDA, MEAN, SCALE)
    missing = df.select("trait").distinct().join(params.select("trait"), "trait", "left_anti")
    return done, missing


def denormalise_pair(
    df: DataFrame, params: DataFrame, pred_options: DenormOptions, y: str = "y", p: str = "p"
) -> DataFrame:
    """Truth with all clips off, prediction with clips on, in one pass."""
    joined = params_join(df, params)
    with_truth = denormalised(joined, y, pred_options.unclipped(), y)
    return denormalised(with_truth, p, pred_options, p).drop(LAMBDA, MEAN, SCALE)


def fit_yeo_johnson(
    df: DataFrame, by: str, value: str = "v", lo: float = -2.0, hi: float = 4.0, steps: int = 25,
    rounds: int = 3, max_fit: int | None = None, ids: Sequence[str] = (), seed: int = 0,
) -> DataFrame:
    """Maximum-likelihood lambda per variable by a refined grid, then mean and scale.

    Every round is one scan: moments of the transformed value for all candidates, combined
    map-side, so nothing but (variables x candidates) sums is shuffled. All rows count unless
    ``max_fit`` asks for a seeded sample of that many valid rows per variable, drawn by ``ids``.
    """
    if max_fit is not None:
        valid = df.filter(finite(F.col(value).cast("double")).isNotNull())
        df = cut(sample_exact(valid, ids, n=max_fit, seed=seed, by=[by]), "fit-sample")
    data = df.select(by, finite(F.col(value).cast("double")).alias("__v")).filter("__v is not null")
    best = None
    width = (hi - lo) / (steps - 1)
    for _ in range(rounds):
        if best is None:
            rows, base = data, F.lit(lo)
        else:
            rows, base = data.join(best.select(by, "lam"), by), F.col("lam") - F.lit(width)
            width = 2 * width / (steps - 1)
        lam = base + F.col("__i") * F.lit(width)
        grid = (
            rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
            .withColumn("__lam", F.round(lam, 9))
            .groupBy(by, "__lam")
            .agg(
                F.count("__v").alias("n"),
                F.var_pop(yeo_johnson_core(F.col("__v"), F.col("__lam"))).alias("var"),
                F.sum(F.signum("__v") * F.log1p(F.abs("__v"))).alias("jac"),
            )
        )
        loglik = F.when(
            F.col("var") > 0,
            -F.col("n") / 2 * F.log("var") + (F.col("__lam") - 1) * F.col("jac"),
        )
        best = small_side(
            grid.withColumn("ll", loglik)
            .groupBy(by)
            .agg(F.max_by("__lam", F.struct("ll", -F.col("__lam"))).alias("lam"))
        )
    z = yeo_johnson_core(F.col("__v"), F.col("lam"))
    return data.join(best, by).groupBy(by).agg(
        F.first("lam").alias(LAMBDA),
        F.avg(z).alias(MEAN),
        F.stddev_pop(z).alias(SCALE),
        F.count("__v").alias("n"),
        F.min("__v").alias("v_min"), F.avg("__v").alias("v_mean"), F.max("__v").alias("v_max"),
        F.min(z).alias("t_min"), F.max(z).alias("t_max"),
    )


def normalise(df: DataFrame, params: DataFrame, value: str = "v", out: str = "z") -> DataFrame:
    """Forward transform and z-score of every row by its trait's parameters."""
    return (
        params_join(df, params)
        .withColumn(out, yeo_johnson(F.col(value), F.col(LAMBDA), F.col(MEAN), F.col(SCALE)))
        .drop(LAMBDA, MEAN, SCALE)
    )


def source_compare(df: DataFrame, params: DataFrame, value: str = "value") -> DataFrame:
    """Per source and trait: n, min, p5, median, mean, p95, max, std in original units."""
    physical = cut(denormalise(df, params, value=value).select("source", "trait", "physical"), "physical")
    return exact_quantiles(
        physical, ["source", "trait"], "physical", {"p5": 0.05, "median": 0.5, "p95": 0.95},
        [
            F.count("physical").alias("n"), F.min("physical").alias("v_min"),
            F.avg("physical").alias("v_mean"), F.max("physical").alias("v_max"),
            F.stddev_pop("physical").alias("v_std"),
        ],
    )


def trait_match(files: DataFrame, params: DataFrame) -> DataFrame:
    """Match a file stem to a parameter id: exact, else the first id (list order) inside the stem.

    ``params(trait, ord)`` is a short list, so it becomes one array literal per row: no join, no
    pairs. Unmatched stems keep a NULL trait.
    """
    ids = [r["trait"] for r in params.orderBy("ord").limit(10_001).collect()]
    if len(ids) > 10_000:
        raise ValueError("trait_match expects a short id list")
    listed = F.array(*[F.lit(i) for i in ids]) if ids else F.array().cast("array<string>")
    stem = F.col("stem")
    inside = F.filter(listed, lambda t: stem.contains(t))
    return files.withColumn(
        "trait", F.when(F.array_contains(listed, stem), stem).otherwise(F.get(inside, F.lit(0)))
    )


def check_params(params: DataFrame, key: str | Sequence[str] = ("trait", "variable")) -> DataFrame:
    """Contract of a parameter table: key column, numeric columns, unique ids without leading X."""
    keys = [key] if isinstance(key, str) else list(key)
    found = [k for k in keys if k in params.columns]
    missing = [c for c in (LAMBDA, MEAN, SCALE) if c not in params.columns]
    if not found or missing:
        raise ValueError(f"parameter table lacks {missing or keys}")
    clean = params.select(
        F.regexp_replace(F.trim(F.col(found[0])), "^X", "").alias("trait"),
        *[F.col(c).cast("double").alias(c) for c in (LAMBDA, MEAN, SCALE)],
    )
    twice = clean.groupBy("trait").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate trait ids: {[r['trait'] for r in twice]}")
    return clean


__all__ = [
    "DenormOptions", "INF", "check_params", "denormalise", "denormalise_all", "denormalise_pair",
    "denormalised", "fit_yeo_johnson", "normalise", "normalise_missing", "params_join",
    "source_compare", "to_physical", "trait_match",
]
