"""Transforms, metrics and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.catalog.registry import query, rounded
from pixelloom.operators import masks, merge, metrics, transforms
from pixelloom.operators.transforms import DenormOptions
from pixelloom.sources import runs_json, sinks

CLIPPED = DenormOptions(clip_z=3.0, ratio=0.05, cap=1000.0)

# Forward and inverse power transform in SQL, with lam in scope.
_YJ = """CASE WHEN {v} >= 0 THEN CASE WHEN lam = 0 THEN ln({v} + 1) ELSE (pow({v} + 1, lam) - 1) / lam END
 ELSE CASE WHEN lam = 2 THEN -ln(1 - {v}) ELSE -(pow(1 - {v}, 2 - lam) - 1) / (2 - lam) END END"""
_INV = """CASE WHEN {y} >= 0 THEN CASE WHEN lam = 0 THEN exp({y}) - 1 WHEN {y} * lam > -1 THEN pow({y} * lam + 1, 1 / lam) - 1 END
 ELSE CASE WHEN lam = 2 THEN 1 - exp(-({y})) WHEN -({y}) * (2 - lam) > -1 THEN 1 - pow(1 - (2 - lam) * ({y}), 1 / (2 - lam)) END END"""
_DOMAIN = """CASE WHEN {y} >= 0 AND lam < 0 THEN least({y}, -1 / lam - greatest(1e-6, abs(1 / lam) * {r}))
 WHEN {y} < 0 AND lam > 2 THEN greatest({y}, 1 / (2 - lam) + greatest(1e-6, abs(1 / (2 - lam)) * {r})) ELSE {y} END"""
_SCORES = """count(*) AS n_valid, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
 round(sqrt(avg((p - y) * (p - y))) / nullif(max(y) - min(y), 0), 6) AS nrmse,
 round(1 - avg((p - y) * (p - y)) / nullif(var_pop(y), 0), 6) AS r2,
 round(corr(y, p), 6) AS pearson_r, round(avg(abs(p - y)), 6) AS mae"""
_CTE = {
    "zpairs": "SELECT row, col, trait, (" + _YJ.format(v="y") + " - m) / s AS y, (" + _YJ.format(v="p")
    + " - m) / s AS p FROM pairs JOIN params USING (trait)",
    "zclip": "SELECT *, y * s + m AS yy, greatest(least(p, 3), -3) * s + m AS pp FROM zpairs JOIN params USING (trait)",
    "zdom": "SELECT *, " + _DOMAIN.format(y="pp", r="0.05::double") + " AS pd FROM zclip",
    "phys": "SELECT row, col, trait, " + _INV.format(y="yy") + " AS y, greatest(least("
    + _INV.format(y="pd") + ", 1000), -1000) AS p FROM zdom",
}


@query("A17_trait_metrics", f"SELECT trait, {_SCORES} FROM pairs GROUP BY trait")
def _(t):
    return rounded(metrics.trait_metrics(t.pairs))


@query("A17_trait_metrics_by_source", f"""
SELECT trait, {_SCORES} FROM coded_pairs WHERE source_code = 2 GROUP BY trait""")
def _(t):
    return rounded(metrics.trait_metrics(t.coded_pairs, valid=F.col("source_code") == 2))


@query("P1_finite_pairs", "SELECT row, col, trait, round(y, 8) AS y, round(p, 8) AS p FROM pairs")
def _(t):
    both = t.two_sides.select("row", "col", "trait", F.col("s.mean").alias("y"), F.col("g.mean").alias("p"))
    return rounded(metrics.finite_pairs(both), 8)


@query("F1_yeo_johnson", "SELECT row, col, trait, source, round((" + _YJ.format(v="mean")
       + " - m) / s, 6) AS z FROM target JOIN params USING (trait)")
def _(t):
    return rounded(transforms.normalise(t.target, t.params, "mean").select("row", "col", "trait", "source", "z"))


@query("F2_inverse_yeo_johnson", "SELECT row, col, trait, source, round(" + _INV.format(y="z")
       + ", 7) AS v FROM (SELECT *, " + _YJ.format(v="mean") + " AS z FROM target JOIN params USING (trait))")
def _(t):
    from pixelloom.functions import inverse_yeo_johnson, yeo_johnson_core

    lam = F.col(transforms.LAMBDA)
    df = transforms.params_join(t.target, t.params).withColumn("z", yeo_johnson_core(F.col("mean"), lam))
    return rounded(df.select("row", "col", "trait", "source", inverse_yeo_johnson(F.col("z"), lam).alias("v")), 7)


@query("F3_clip_inverse_domain", "SELECT row, col, trait, source, round("
       + _DOMAIN.format(y="z", r="0.05::double")
       + ", 8) AS y FROM (SELECT *, mean - 2 AS z FROM target JOIN params USING (trait))")
def _(t):
    from pixelloom.functions import clip_inverse_domain

    df = transforms.params_join(t.target, t.params)
    y = clip_inverse_domain(F.col("mean") - 2, F.col(transforms.LAMBDA), ratio=0.05)
    return rounded(df.select("row", "col", "trait", "source", y.alias("y")), 8)


@query("F4_denormalise", "SELECT row, col, trait, round(p, 7) AS physical FROM phys", _CTE)
def _(t):
    out = transforms.denormalise(t.z_pairs, t.params, CLIPPED, value="p")
    return rounded(out.select("row", "col", "trait", "physical"), 7)


@query("F5_denormalise_all", """
SELECT z.row, z.col, z.trait, round(CASE WHEN z.trait <> 'X3' THEN p.p END, 7) AS physical
FROM zpairs z JOIN phys p ON p.row = z.row AND p.col = z.col AND p.trait = z.trait""", _CTE)
def _(t):
    known = t.params.filter("trait <> 'X3'")
    out, _missing = transforms.denormalise_all(t.z_pairs, known, "keep", CLIPPED, value="p")
    return rounded(out.select("row", "col", "trait", "physical"), 7)


@query("F5_missing_traits", "SELECT DISTINCT trait FROM zpairs WHERE trait NOT IN ('X1', 'X2', 'X4')", _CTE)
def _(t):
    known = t.params.filter("trait <> 'X3'")
    return transforms.denormalise_all(t.z_pairs, known, "drop", CLIPPED, value="p")[1]


@query("F6_denormalise_pair", "SELECT row, col, trait, round(y, 7) AS y, round(p, 7) AS p FROM phys", _CTE)
def _(t):
    return rounded(transforms.denormalise_pair(t.z_pairs, t.params, CLIPPED).select("row", "col", "trait", "y", "p"), 7)


@query("F7_fit_yeo_johnson", f"""
SELECT trait, round(lam, 6) AS yeo_johnson_lambda, round(avg(z), 5) AS standardize_mean, round(stddev_pop(z), 5) AS standardize_scale,
       count(*) AS n, round(min(v), 5) AS v_min, round(avg(v), 5) AS v_mean, round(max(v), 5) AS v_max,
       round(min(z), 4) AS t_min, round(max(z), 4) AS t_max
FROM (SELECT b.trait, b.lam, o.v, {_YJ.format(v='o.v').replace('lam', 'b.lam')} AS z
      FROM obs o JOIN (
        SELECT trait, max_by(lam, ll) AS lam FROM (
          SELECT trait, lam, -count(*) / 2.0::double * ln(var_pop({_YJ.format(v='v')})) + (lam - 1) * sum(sign(v) * ln(1 + abs(v))) AS ll
          FROM obs, (SELECT -2.0::double + i * 0.25::double AS lam FROM range(25) g(i)) GROUP BY trait, lam)
        GROUP BY trait) b ON b.trait = o.trait)
GROUP BY trait, lam""")
def _(t):
    fit = transforms.fit_yeo_johnson(t.obs, "trait", lo=-2.0, hi=4.0, steps=25, rounds=1)
    coarse = rounded(fit, 5).withColumns(
        {c: F.round(c, 4) for c in ("t_min", "t_max")}
    )
    return coarse


@query("J3_params_join", """
SELECT row, col, trait, source, lam AS yeo_johnson_lambda, m AS standardize_mean, s AS standardize_scale
FROM target JOIN params USING (trait)""")
def _(t):
    return transforms.params_join(t.target, t.params).drop("mean", "std", "count")


@query("A10_source_compare", """
SELECT source, trait, count(v) AS n, round(min(v), 5) AS v_min, round(avg(v), 5) AS v_mean, round(max(v), 5) AS v_max,
       round(stddev_pop(v), 5) AS v_std, round(quantile_cont(v, 0.05), 5) AS p5,
       round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.95), 5) AS p95
FROM (SELECT source, trait, """ + _INV.format(y="yy") + """ AS v FROM
  (SELECT *, z * s + m AS yy FROM (SELECT *, (""" + _YJ.format(v="mean") + """ - m) / s AS z FROM target JOIN params USING (trait))))
GROUP BY source, trait""")
def _(t):
    z = transforms.normalise(t.target, t.params, "mean").select("source", "trait", F.col("z").alias("value"))
    return rounded(transforms.source_compare(z, t.params), 5)


@query("A18_trait_metrics_denorm", f"""
SELECT trait, {_SCORES}, round(stddev_pop(p - y), 6) AS residual_std, round(stddev_pop(y), 6) AS target_std,
       round(stddev_pop(p), 6) AS prediction_std FROM phys GROUP BY trait""", _CTE)
def _(t):
    return rounded(metrics.trait_metrics_denorm(t.z_pairs, t.params, CLIPPED))


_PER_TRAIT = """SELECT trait, sqrt(avg((p - y) * (p - y))) AS rmse,
 sqrt(avg((p - y) * (p - y))) / nullif(max(y) - min(y), 0) AS nrmse,
 1 - avg((p - y) * (p - y)) / nullif(var_pop(y), 0) AS r2, corr(y, p) AS r, avg(abs(p - y)) AS mae,
 stddev_pop(p - y) AS res FROM pairs GROUP BY trait"""


@query("A19_macro_metrics", f"""
SELECT g.*, m.* FROM (SELECT {_SCORES} FROM pairs) g,
(SELECT round(avg(rmse), 6) AS macro_rmse, round(avg(nrmse), 6) AS macro_nrmse, round(avg(r2), 6) AS macro_r2,
        round(avg(r), 6) AS macro_pearson_r, round(avg(mae), 6) AS macro_mae FROM per_trait) m""",
       {"per_trait": _PER_TRAIT})
def _(t):
    return rounded(metrics.macro_metrics(t.pairs))


@query("A20_macro_pooled", """
SELECT round(avg(r), 6) AS pearson_r_macro, round(avg(r2), 6) AS r2_macro, round(avg(nrmse), 6) AS nrmse_macro,
       round(avg(res), 6) AS residual_std_macro,
       (SELECT round(sqrt(avg((p - y) * (p - y))), 6) FROM pairs) AS rmse_macro,
       (SELECT round(avg(abs(p - y)), 6) FROM pairs) AS mae_macro FROM per_trait""", {"per_trait": _PER_TRAIT})
def _(t):
    return rounded(metrics.macro_pooled(t.pairs))


@query("A21_one_pass_r2", """
SELECT trait, count(*) AS n, round(1 - sum((q - y) * (q - y)) / (sum(y * y) - count(*) * avg(y) * avg(y)), 6) AS r2,
       round(sqrt(avg((q - y) * (q - y))), 6) AS rmse, round(avg(q) - avg(y), 6) AS bias,
       round(avg(y), 6) AS mean_true, round(avg(q), 6) AS mean_pred
FROM (SELECT trait, y, p * 1.1::double + 0.01::double AS q FROM pairs) GROUP BY trait""")
def _(t):
    return rounded(metrics.one_pass_r2(t.pairs, ["trait"], scale=1.1, offset=0.01))


_ERR = {"err": """SELECT *, CASE WHEN abs(p - y) < 0.5 THEN 0.5::double * (p - y) * (p - y) / 0.5::double ELSE abs(p - y) - 0.25::double END AS e1,
 (p - y) * (p - y) AS e2, CASE WHEN source_code = 2 THEN 2.0::double ELSE 1.0::double END AS wt FROM coded_pairs"""}


@query("A22_weighted_loss", """
SELECT round(sum(wt * e1) / sum(wt), 6) AS loss, round(sum(wt), 6) AS weight FROM err""", _ERR)
def _(t):
    return rounded(metrics.weighted_loss(t.coded_pairs, 2.0, 1.0, "smooth_l1", 0.5))


@query("A23_per_trait_loss", "SELECT trait, round(sum(wt * e2) / sum(wt), 6) AS loss FROM err GROUP BY trait", _ERR)
def _(t):
    return rounded(metrics.per_trait_loss(t.coded_pairs, 2.0, 1.0))


@query("A24_combined_loss", """
SELECT round(avg(e2) FILTER (source_code = 2), 6) AS loss_primary, round(avg(e2) FILTER (source_code = 1), 6) AS loss_aux,
       round(avg(e2) FILTER (source_code = 2) + 0.1::double * avg(e2) FILTER (source_code = 1), 6) AS loss FROM err""", _ERR)
def _(t):
    return rounded(metrics.combined_loss(t.coded_pairs, 1.0, 0.1))


@query("A26_source_counts", """
SELECT trait, count(*) FILTER (source_code = 2) AS n_primary, count(*) FILTER (source_code = 1) AS n_aux,
       count(*) AS n_total FROM coded_pairs GROUP BY ROLLUP (trait)""")
def _(t):
    return metrics.source_counts(t.coded_pairs)


@query("A27_support_summary", """
SELECT min(n) AS n_min, floor(quantile_cont(n, 0.25))::bigint AS p25, floor(quantile_cont(n, 0.5))::bigint AS median,
       floor(quantile_cont(n, 0.75))::bigint AS p75, max(n) AS n_max, count(*) FILTER (n < 30) AS n_below
FROM (SELECT trait, source_code, count(*) AS n FROM coded_pairs GROUP BY ALL)""")
def _(t):
    return metrics.support_summary(metrics.trait_metrics(t.coded_pairs, ["trait", "source_code"]), 30)


@query("P11_default_source_code", """
SELECT row, col, trait, source, CASE WHEN std IS NULL OR std = 0 THEN 0 WHEN source = 'primary' THEN 2 ELSE 1 END AS source_code
FROM target""")
def _(t):
    y = F.when(F.col("std") > 0, F.col("std"))
    return t.target.select("row", "col", "trait", "source", masks.default_source_code(y, F.col("source")).alias("source_code"))


@query("IO9_metrics_sink", f"SELECT trait, {_SCORES} FROM pairs GROUP BY trait")
def _(t):
    path = sinks.metrics_sink(metrics.trait_metrics(t.pairs))(t.spark)
    return rounded(sinks.read_metrics(t.spark, path))


@query("IO10_metrics_json_scan", """
SELECT trait, round(max(CASE WHEN l_linestatus = 'F' THEN r END), 6) AS run_f,
       round(max(CASE WHEN l_linestatus = 'O' THEN r END), 6) AS run_o,
       round(max(CASE WHEN l_linestatus = 'O' THEN r END) - max(CASE WHEN l_linestatus = 'F' THEN r END), 6) AS diff
FROM (SELECT l_linestatus, l_returnflag AS trait, sqrt(avg((l_quantity - l_extendedprice / 2100) * (l_quantity - l_extendedprice / 2100))) AS r
      FROM lineitem GROUP BY ALL) GROUP BY trait""")
def _(t):
    li = t.read("lineitem").select(
        F.col("l_linestatus").alias("run"), F.col("l_returnflag").alias("trait"),
        F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2100).alias("p"))
    docs = runs_json.to_metrics_json(metrics.trait_metrics(li, ["run", "trait"]))
    rows = runs_json.metrics_json_scan(docs, "doc")
    wide = runs_json.compare_runs(rows, "rmse", ["F", "O"])
    return rounded(wide.select("trait", F.col("F").alias("run_f"), F.col("O").alias("run_o"), (F.col("O") - F.col("F")).alias("diff")))


@query("J17_trait_meta_join", """
SELECT p_brand AS display, p_type AS unit, v.row AS trait, v.measure, v.n_valid, v.mae
FROM (SELECT row, trait AS measure, count(*) AS n_valid, round(avg(abs(p - y)), 8) AS mae FROM pairs GROUP BY row, trait) v
JOIN part ON p_partkey = v.row""")
def _(t):
    m = metrics.trait_metrics(t.pairs, ["row", "trait"]).select(F.col("row").alias("trait"), F.col("trait").alias("measure"), "n_valid", "mae")
    meta = t.read("part").select(F.col("p_partkey").cast("int").alias("trait"), F.col("p_brand").alias("display"), F.col("p_type").alias("unit"))
    return rounded(merge.trait_meta_join(m, meta, t.primary.select(F.col("row").alias("trait"))), 8)


@query("M3_ensemble_scores", """
SELECT row, col, trait, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std
FROM (SELECT row, col, trait, unnest([y, p]) AS v FROM pairs) GROUP BY ALL""")
def _(t):
    from pixelloom.operators.score import ensemble_scores

    scores = t.pairs.unpivot(["row", "col", "trait"], ["y", "p"], "seed", "score")
    return rounded(ensemble_scores(scores), 9)

