"""Masked regression metrics and losses from mergeable moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.missing import finite
from pixelloom.operators.transforms import DenormOptions, denormalise_pair

AUX, PRIMARY = 1, 2


def finite_pairs(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Rows where truth and prediction are both finite."""
    return df.filter(finite(F.col(y)).isNotNull() & finite(F.col(p)).isNotNull())


def _paired(y: str, p: str, valid: Column | None) -> tuple[Column, Column]:
    yt, yp = finite(F.col(y).cast("double")), finite(F.col(p).cast("double"))
    ok = yt.isNotNull() & yp.isNotNull()
    if valid is not None:
        ok = ok & valid
    return F.when(ok, yt), F.when(ok, yp)


def pair_moments(
    df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", valid: Column | None = None
) -> DataFrame:
    """Centred, mergeable moments per group: one shuffle of one row per group and task."""
    yt, yp = _paired(y, p, valid)
    err = yp - yt
    return df.groupBy(*by).agg(
        F.count(err).alias("n"), F.avg(yt).alias("y_avg"), F.avg(yp).alias("p_avg"),
        F.var_pop(yt).alias("y_var"), F.var_pop(yp).alias("p_var"), F.covar_pop(yt, yp).alias("yp_cov"),
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop(err).alias("e_var"),
        F.min(yt).alias("y_min"), F.max(yt).alias("y_max"),
    )


def _scores() -> dict[str, Column]:
    n, span = F.col("n"), F.col("y_max") - F.col("y_min")
    constant = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r = F.try_divide(F.col("yp_cov"), F.sqrt("y_var") * F.sqrt("p_var"))
    return {
        "n_valid": n,
        "rmse": F.sqrt("mse"),
        "nrmse": F.when(span > 0, F.try_divide(F.sqrt("mse"), span)),
        "r2": F.when(
            n >= 2,
            F.when(span > 0, F.lit(1.0) - F.try_divide(F.col("mse"), F.col("y_var"))).otherwise(constant),
        ),
        "pearson_r": F.when(n >= 2, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)) + r * 0),
        "mae": F.col("mae"),
    }


def trait_metrics(
    df: DataFrame, by: Sequence[str] = ("trait",), y: str = "y", p: str = "p",
    valid: Column | None = None,
) -> DataFrame:
    """n_valid, rmse, nrmse, r2, pearson_r, mae per group; a group without pairs keeps n_valid = 0.

    R2 on constant truth is 0 (1 if perfect) and missing below two pairs; NRMSE divides by the range
    of truth and is missing for range 0.
    """
    m = pair_moments(df, by, y, p, valid)
    return m.select(*by, *[c.alias(k) for k, c in _scores().items()])


def trait_metrics_denorm(
    df: DataFrame, params: DataFrame, options: DenormOptions, by: Sequence[str] = ("trait",),
    valid: Column | None = None,
) -> DataFrame:
    """Metrics in original units plus population std of residual, target and prediction."""
    m = pair_moments(denormalise_pair(df, params, options), by, valid=valid)
    return m.select(
        *by, *[c.alias(k) for k, c in _scores().items()],
        F.sqrt("e_var").alias("residual_std"), F.sqrt("y_var").alias("target_std"),
        F.sqrt("p_var").alias("prediction_std"),
    )


def _pooled_moments(m: DataFrame) -> dict[str, Column]:
    """Whole-sample moments from group moments (parallel variance rule)."""
    n = F.sum("n")

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(F.col("n") * F.col(c)), n)

    def var(v: Column, a: str, b: str) -> Column:
        within = F.try_divide(F.sum(F.col("n") * v), n)
        between = F.try_divide(F.sum(F.col("n") * F.col(a) * F.col(b)), n) - mean(a) * mean(b)
        return within + between

    return {
        "n": n, "mse": mean("mse"), "mae": mean("mae"),
        "y_var": var(F.col("y_var"), "y_avg", "y_avg"), "p_var": var(F.col("p_var"), "p_avg", "p_avg"),
        "yp_cov": var(F.col("yp_cov"), "y_avg", "p_avg"),
        "y_min": F.min("y_min"), "y_max": F.max("y_max"),
    }


def macro_metrics(
    df: DataFrame, y: str = "y", p: str = "p", valid: Column | None = None, by: str = "trait"
) -> DataFrame:
    """Global metrics over all pairs and the mean over traits of each metric, from one scan."""
    m = pair_moments(df, [by], y, p, valid)
    scores = _scores()
    names = ["rmse", "nrmse", "r2", "pearson_r", "mae"]
    both = m.withColumns({f"t_{k}": scores[k] for k in names}).agg(
        *[c.alias(k) for k, c in _pooled_moments(m).items()],
        *[F.avg(f"t_{k}").alias(f"macro_{k}") for k in names],
    )
    return both.select(
        *[c.alias(k) for k, c in scores.items()], *[f"macro_{k}" for k in names]
    )


def macro_pooled(df: DataFrame, y: str = "y", p: str = "p", by: str = "trait") -> DataFrame:
    """The other macro: r, r2, nrmse, residual_std are trait means; rmse and mae pool all samples."""
    m = pair_moments(df, [by], y, p)
    s = _scores()
    return m.withColumns(
        {"t_r": s["pearson_r"], "t_r2": s["r2"], "t_nrmse": s["nrmse"], "t_res": F.sqrt("e_var")}
    ).agg(
        F.avg("t_r").alias("pearson_r_macro"),
        F.avg("t_r2").alias("r2_macro"),
        F.avg("t_nrmse").alias("nrmse_macro"),
        F.avg("t_res").alias("residual_std_macro"),
        F.sqrt(F.try_divide(F.sum(F.col("n") * F.col("mse")), F.sum("n"))).alias("rmse_macro"),
        F.try_divide(F.sum(F.col("n") * F.col("mae")), F.sum("n")).alias("mae_macro"),
    )


def one_pass_r2(
    df: DataFrame, by: Sequence[str] = (), scale: float = 1.0, offset: float = 0.0,
    y: str = "y", p: str = "p",
) -> DataFrame:
    """Running-sum form: r2 (missing when truth is constant), rmse, bias and both means."""
    scaled = df.withColumn(p, F.col(p) * F.lit(float(scale)) + F.lit(float(offset)))
    m = pair_moments(scaled, by, y, p)
    return m.select(
        *by, "n",
        F.when(F.col("y_var") > 0, F.lit(1.0) - F.try_divide(F.col("mse"), F.col("y_var"))).alias("r2"),
        F.sqrt("mse").alias("rmse"),
        (F.col("p_avg") - F.col("y_avg")).alias("bias"),
        F.col("y_avg").alias("mean_true"), F.col("p_avg").alias("mean_pred"),
    )


def error_term(y: Column, p: Column, kind: str = "mse", beta: float = 1.0) -> Column:
    """Squared error, or smooth-L1 with transition point ``beta``."""
    d = F.abs(p - y)
    if kind == "mse":
        return d * d
    if kind in ("smooth_l1", "huber"):
        return F.when(d < F.lit(beta), F.lit(0.5) * d * d / F.lit(beta)).otherwise(d - F.lit(0.5 * beta))
    raise ValueError(f"unknown error kind {kind!r}")


def _weighted(
    w_primary: float, w_aux: float, kind: str, beta: float, sample_weight: str | None = None,
    y: str = "y", p: str = "p", code: str = "source_code",
) -> tuple[Column, Column]:
    yt, yp = _paired(y, p, F.col(code).isin(AUX, PRIMARY))
    w = F.when(F.col(code) == PRIMARY, F.lit(float(w_primary))).otherwise(F.lit(float(w_aux)))
    w = F.when(yt.isNotNull(), w)
    if sample_weight:
        w = w * F.col(sample_weight)
    return F.sum(w * error_term(yt, yp, kind, beta)), F.sum(w)


def weighted_loss(
    df: DataFrame, w_primary: float = 2.0, w_aux: float = 1.0, kind: str = "mse", beta: float = 1.0,
    sample_weight: str | None = None,
) -> DataFrame:
    """Source-weighted mean error; 0 when the total weight is 0."""
    num, den = _weighted(w_primary, w_aux, kind, beta, sample_weight)
    return df.agg(num.alias("num"), den.alias("den")).select(
        F.when(F.col("den") > 0, F.try_divide("num", "den")).otherwise(0.0).alias("loss"),
        F.coalesce("den", F.lit(0.0)).alias("weight"),
    )


def per_trait_loss(
    df: DataFrame, w_primary: float = 2.0, w_aux: float = 1.0, kind: str = "mse", beta: float = 1.0,
    eps: float = 1e-8,
) -> DataFrame:
    """The same per trait; missing where a trait has no valid pixel."""
    num, den = _weighted(w_primary, w_aux, kind, beta)
    return df.groupBy("trait").agg(num.alias("num"), den.alias("den")).select(
        "trait", F.when(F.col("den") > 0, F.try_divide(F.col("num"), F.greatest("den", F.lit(eps)))).alias("loss")
    )


def combined_loss(
    df: DataFrame, w_primary: float = 1.0, w_aux: float = 0.1, kind: str = "mse", beta: float = 1.0
) -> DataFrame:
    """``w_primary * mean error on primary + w_aux * mean error on aux``, an empty source giving 0."""
    yt, yp = _paired("y", "p", F.col("source_code").isin(AUX, PRIMARY))
    e = error_term(yt, yp, kind, beta)

    def mean_of(code: int) -> Column:
        return F.coalesce(F.avg(F.when(F.col("source_code") == code, e)), F.lit(0.0))

    return df.agg(mean_of(PRIMARY).alias("loss_primary"), mean_of(AUX).alias("loss_aux")).withColumn(
        "loss", F.lit(float(w_primary)) * F.col("loss_primary") + F.lit(float(w_aux)) * F.col("loss_aux")
    )


def source_counts(df: DataFrame, value: str = "y") -> DataFrame:
    """Valid rows per trait by source code, with a total row (trait NULL)."""
    ok = finite(F.col(value)).isNotNull()
    code = F.col("source_code")
    per_trait = df.groupBy("trait").agg(
        F.count_if(ok & (code == PRIMARY)).alias("n_primary"),
        F.count_if(ok & (code == AUX)).alias("n_aux"),
    )
    return per_trait.rollup("trait").agg(
        F.sum("n_primary").alias("n_primary"), F.sum("n_aux").alias("n_aux"),
        F.sum(F.col("n_primary") + F.col("n_aux")).alias("n_total"),
    )


def support_summary(metrics: DataFrame, threshold: int = 30) -> DataFrame:
    """Spread of n_valid over traits (one row per trait, so plain percentiles are safe)."""
    q = F.percentile("n_valid", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return metrics.agg(
        F.min("n_valid").cast("bigint").alias("n_min"),
        q.alias("q"),
        F.max("n_valid").cast("bigint").alias("n_max"),
        F.count_if(F.col("n_valid") < threshold).alias("n_below"),
    ).select(
        "n_min", F.col("q")[0].cast("bigint").alias("p25"), F.col("q")[1].cast("bigint").alias("median"),
        F.col("q")[2].cast("bigint").alias("p75"), "n_max", "n_below",
    )
