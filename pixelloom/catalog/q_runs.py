"""Run tables and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.catalog.registry import query, rounded
from pixelloom.operators import profile, runs
from pixelloom.session import cut
from pixelloom.sources import rasters

_SEL = {
    "ordered_e": "SELECT *, row_number() OVER (PARTITION BY run, seed ORDER BY epoch) AS i FROM epochs",
    "sel": """SELECT run, seed, 0::bigint AS i, 0 AS epoch, '-infinity'::double AS best, 0 AS best_epoch, 0 AS wait, 0 AS stop
       FROM (SELECT DISTINCT run, seed FROM epochs)
     UNION ALL
     SELECT run, seed, i, epoch, CASE WHEN better THEN value ELSE best END, CASE WHEN better THEN epoch ELSE best_epoch END,
       CASE WHEN better THEN 0 ELSE wait + 1 END, CASE WHEN NOT better AND wait + 1 >= {patience} THEN epoch ELSE 0 END
     FROM (SELECT s.run, s.seed, o.i, o.epoch, o.value, s.best, s.best_epoch, s.wait, o.value > s.best + 0.5 AS better
           FROM sel s JOIN ordered_e o ON o.run = s.run AND o.seed = s.seed AND o.i = s.i + 1 WHERE s.stop = 0)""",
}


def _with_patience(p: int) -> dict[str, str]:
    return {k: v.replace("{patience}", str(p)) for k, v in _SEL.items()}


@query("W4_best_checkpoint", """
SELECT run, seed, round(max_by(best, i), 6) AS best_value, max_by(best_epoch, i)::int AS best_epoch FROM sel GROUP BY run, seed""", _with_patience(10**6))
def _(t):
    return rounded(runs.best_checkpoint(t.epochs, "max", 0.5))


@query("W5_early_stop", """
SELECT s.run, s.seed, s.epoch::int AS epoch, o.value FROM sel s JOIN ordered_e o ON o.run = s.run AND o.seed = s.seed AND o.i = s.i""", _with_patience(6))
def _(t):
    return runs.early_stop(t.epochs, 6, "max", 0.5)


@query("A37_seed_summary", """
SELECT run AS model, epoch AS metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n_seeds FROM epochs GROUP BY ALL""")
def _(t):
    return rounded(runs.seed_summary(t.epochs.select(F.col("run").alias("model"), F.col("epoch").alias("metric"), "value")))


@query("T4_leaderboard", """
SELECT run, seed, round(max(value), 6) AS score FROM epochs GROUP BY run, seed ORDER BY score DESC, run, seed LIMIT 3""")
def _(t):
    scores = t.epochs.groupBy("run", "seed").agg(F.max("value").alias("score"))
    return rounded(runs.leaderboard(scores, "score", 3))


@query("A8_describe", """
SELECT trait, count(v) AS n, round(min(v), 6) AS v_min, round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS v_mean,
       round(max(v), 6) AS v_max, round(stddev_pop(v), 6) AS v_std
FROM (SELECT trait, CASE WHEN v > 0 THEN v END AS v FROM obs) GROUP BY trait""")
def _(t):
    df = t.obs.select("trait", F.when(F.col("v") > 0, F.col("v")).alias("value"))
    return rounded(profile.describe(df, ["trait"]))


@query("A9_raster_summary", """
SELECT source || '_' || trait AS file, count(v) AS n_valid, count(*) - count(v) AS n_nodata, round(min(v), 6) AS v_min, round(max(v), 6) AS v_max,
       round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.99), 6) AS p99
FROM (SELECT source, trait, CASE WHEN v > 0 THEN v END AS v FROM obs) GROUP BY source, trait""")
def _(t):
    df = t.obs.select(F.concat_ws("_", "source", "trait").alias("file"), F.when(F.col("v") > 0, F.col("v")).alias("value"))
    return rounded(profile.raster_summary(df))


@query("P19_unrealistic_filter", """
SELECT row, col, n, round(v_max, 4) AS v_max, round(v_min, 8) AS v_min FROM (
 SELECT row, col, count(mean) AS n, max(mean) * 20000 AS v_max, min(mean) AS v_min FROM target GROUP BY row, col) WHERE v_max > 1e6""")
def _(t):
    from pixelloom.operators.masks import unrealistic_filter

    stats = t.target.groupBy("row", "col").agg(
        F.count("mean").alias("n"), (F.max("mean") * 20000).alias("v_max"), F.min("mean").alias("v_min")
    )
    return unrealistic_filter(stats).select("row", "col", "n", F.round("v_max", 4).alias("v_max"), F.round("v_min", 8).alias("v_min"))


@query("A35_seasonal_mean", """
SELECT month(o_orderdate)::int AS month, o_orderpriority AS band, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS n FROM orders GROUP BY ALL""")
def _(t):
    df = t.read("orders").select(F.month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("band"), F.col("o_totalprice").alias("value"))
    return rounded(profile.seasonal_mean(df, ["month", "band"]), 4)


@query("A36_name_parse", """
SELECT name, split_part(stem, '_', 1) AS property, split_part(stem, '_', 2) AS depth, split_part(stem, '_', 3) AS stat
FROM (SELECT name, regexp_replace(name, '\\.tif$', '') AS stem FROM (SELECT replace(p_name, ' ', '-') || '_' || p_size || 'cm_' || p_type || '.tif' AS name FROM part))""")
def _(t):
    return rasters.name_parse(_names(t))


def _names(t):
    return t.read("part").select(
        F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("_"), F.col("p_size").cast("string"), F.lit("cm_"), F.col("p_type"), F.lit(".tif")).alias("name")
    )


@query("A36_name_inventory", """
SELECT array_to_string(list_sort(list(DISTINCT replace(p_name, ' ', '-'))), ',') AS propertys, array_to_string(list_sort(list(DISTINCT p_size || 'cm')), ',') AS depths,
       array_to_string(list_sort(list(DISTINCT p_type)), ',') AS stats, count(*) AS n_files FROM part""")
def _(t):
    inv = profile.name_parse_inventory(rasters.name_parse(_names(t)))
    return inv.select(*[F.concat_ws(",", c).alias(c) for c in ("propertys", "depths", "stats")], "n_files")


@query("A40_histogram_pair", """
SELECT trait, sample, bin::int AS bin, n, round(n / (sum(n) OVER (PARTITION BY trait, sample) * width), 6) AS density, round(lo + bin * width, 6) AS left_edge
FROM (SELECT b.trait, sample, least(floor((value - lo) / width), 36)::int AS bin, lo, width, count(*)::bigint AS n
      FROM both_s b JOIN (SELECT trait, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi, (quantile_cont(value, 0.99) - quantile_cont(value, 0.01)) / 37 AS width FROM both_s GROUP BY trait) e
        ON e.trait = b.trait
      WHERE value BETWEEN lo AND hi GROUP BY ALL)""",
       {"both_s": """SELECT trait, 'truth' AS sample, y + row * 1e-7::double + col * 1e-10::double AS value FROM pairs
        UNION ALL SELECT trait, 'pred', p + row * 1e-7::double + col * 1e-10::double FROM pairs"""})
def _(t):
    # a little is added to each value, since means of two-digit numbers lie on the edges of bins and rounding would decide
    df = t.pairs.select("trait", F.inline(F.array(
        F.struct(F.lit("truth").alias("sample"), (F.col("y") + F.col("row") * F.lit(1e-7) + F.col("col") * F.lit(1e-10)).alias("value")),
        F.struct(F.lit("pred").alias("sample"), (F.col("p") + F.col("row") * F.lit(1e-7) + F.col("col") * F.lit(1e-10)).alias("value")))))
    return rounded(profile.histogram_pair(cut(df), 37, by=["trait"]))


@query("A41_box_stats", """
SELECT b.*, round(min(o.v), 6) AS whisker_lo, round(max(o.v), 6) AS whisker_hi FROM
 (SELECT source, trait, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3 FROM obs GROUP BY source, trait) b
JOIN (SELECT source, trait, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS c FROM obs GROUP BY source, trait) e ON e.source = b.source AND e.trait = b.trait
JOIN obs o ON o.source = b.source AND o.trait = b.trait AND o.v BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) GROUP BY ALL""")
def _(t):
    return rounded(profile.box_stats(t.obs, ["source", "trait"], "v"))


@query("A41_log_histogram", """
SELECT l_returnflag AS source, floor(log10(l_extendedprice) * 4)::int AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL""")
def _(t):
    df = t.read("lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_extendedprice").alias("px"))
    return profile.log_histogram(df, ["source"], "px")


@query("W7_grid_infer", """
SELECT trait, f.row - (SELECT min(row) FROM folds) AS row, f.col - (SELECT min(col) FROM folds) AS col, fold FROM folds f""")
def _(t):
    return profile.grid_infer(cut(t.folds))[1].select("trait", "row", "col", "fold")


@query("W8_cdf", """
SELECT px, n, round(sum(n) OVER (ORDER BY px)::double / sum(n) OVER (), 9) AS cum_share FROM (
 SELECT px, count(*) AS n FROM (SELECT l_orderkey, count(*) AS px FROM lineitem GROUP BY l_orderkey) GROUP BY px)""")
def _(t):
    sizes = t.read("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("px"))
    return rounded(profile.cdf(sizes, "px"), 9)


@query("W8_deciles", "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 6) AS p{p}" for p in range(10, 100, 10)) + " FROM lineitem")
def _(t):
    return rounded(profile.deciles(t.read("lineitem"), "l_extendedprice"))
