"""Scans, snapping, cleaning, parameters and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.catalog.registry import query, rounded
from pixelloom.catalog.tables import PIXEL_M, TRAITS
from pixelloom.operators import profile, quality, sampling, transforms
from pixelloom.session import scratch_path
from pixelloom.sources import params as param_files
from pixelloom.sources import rasters


@query("IO1_scan_predictors", "SELECT l_partkey AS x, l_suppkey AS y, l_tax, l_discount FROM lineitem")
def _(t):
    return rasters.scan_predictors(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_tax", "l_discount"], "l_partkey", "l_suppkey")


_POINTS = {
    "pts2": """SELECT (l_suppkey + 0.5::double + (l_tax - 0.04) * 5) * 22000 AS x, (h - l_partkey - 0.5::double + (l_discount - 0.05) * 4) * 22000 AS y,
       l_orderkey, l_linenumber, l_quantity AS v, h, w FROM (SELECT *, h::double - 3 AS hh FROM lineitem, dims)""",
    "snapped": """SELECT round_even((h * 22000 - y) / 22000 - 0.5, 0)::int AS row, round_even(x / 22000 - 0.5, 0)::int AS col, l_orderkey, l_linenumber, v, h, w FROM pts2""",
}


def _points(t):
    g = t.grid
    return t.read("lineitem").select(
        ((F.col("l_suppkey") + 0.5 + (F.col("l_tax") - 0.04) * 5) * PIXEL_M).alias("x"),
        ((F.lit(float(g.height)) - F.col("l_partkey") - 0.5 + (F.col("l_discount") - 0.05) * 4) * PIXEL_M).alias("y"),
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"),
    )


@query("IO2_grid_snap", """
SELECT row, col, max_by(v, (l_orderkey, l_linenumber, v)) AS v FROM snapped WHERE row BETWEEN 0 AND h - 1 AND col BETWEEN 0 AND w - 1 GROUP BY row, col""", _POINTS)
def _(t):
    points = _points(t).withColumn("o3", F.col("v"))
    return rasters.grid_snap(points, t.grid, ordinal=["l_orderkey", "l_linenumber", "o3"])[0]


@query("IO2_grid_snap_dropped", """
SELECT count(*) FILTER (NOT (row BETWEEN 0 AND h - 5 AND col BETWEEN 0 AND w - 5)) AS n_dropped, count(*) AS n_points FROM snapped""", _POINTS)
def _(t):
    from dataclasses import replace

    smaller = replace(t.grid, height=t.grid.height - 4, width=t.grid.width - 4)
    return rasters.grid_snap(_points(t), smaller)[1]


@query("IO3_predictor_route", """
SELECT CASE WHEN l_shipdate_m LIKE 'm0%' THEN 'first' WHEN l_shipdate_m LIKE 'm1%' THEN 'last' ELSE 'other' END AS grp, count(*) AS n
FROM (SELECT strftime(l_shipdate, 'm%m') AS l_shipdate_m FROM lineitem) GROUP BY grp""")
def _(t):
    df = t.read("lineitem").select(F.date_format("l_shipdate", "'m'MM").alias("variable"))
    return rasters.predictor_route(df, {"m0": "first", "m1": "last"}, "other").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("IO4_nodata_normalise", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity NOT IN (1, 50) THEN l_quantity END AS v FROM lineitem""")
def _(t):
    df = t.read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"))
    return rasters.nodata_normalise(df, "v", [1.0, 50.0])


_RULES = [("X1", 50.0, 0.5, 1.0, 2.0, 24.0), ("X2", None, 10.0, None, None, 900.0), ("X3", 0.0, None, None, None, None)]


@query("IO5_to_physical", """
SELECT row, col, source, trait, count(*) AS n, round(sum(p), 6) AS v FROM (SELECT *, CASE trait
 WHEN 'X1' THEN CASE WHEN v <> 50 AND v * 0.5::double + 1 BETWEEN 2 AND 24 THEN v * 0.5::double + 1 END
 WHEN 'X2' THEN CASE WHEN v * 10 <= 900 THEN v * 10 END WHEN 'X3' THEN CASE WHEN abs(v) > 1e-8 THEN v END ELSE v END AS p FROM obs) GROUP BY row, col, source, trait""")
def _(t):
    rules = t.spark.createDataFrame(
        _RULES, "trait string, nodata double, scale double, offset double, valid_min double, valid_max double"
    )
    out = transforms.to_physical(t.obs, rules, key="trait")
    # the four rows of an observation meet in one before they are shuffled
    mine = {x: F.col("trait") == x for x in TRAITS}
    sums = [F.struct(F.count_if(mine[x]).alias("n"), F.sum(F.when(mine[x], F.col("v"))).alias("v")).alias(x) for x in TRAITS]
    wide = out.groupBy("row", "col", "source").agg(*sums)
    each = F.array(*[F.struct(F.lit(x).alias("trait"), F.col(x)["n"].alias("n"), F.col(x)["v"].alias("v")) for x in TRAITS])
    return rounded(wide.select("row", "col", "source", F.inline(each)).filter("n > 0"))


@query("IO6_band_reorder", "SELECT row, col, source, trait, count, round(mean, 8) AS mean, round(std, 8) AS std FROM target")
def _(t):
    return rounded(rasters.band_reorder(t.target, ["Count", "MEAN", "std"], ["row", "col", "source", "trait"]), 8)


@query("IO6_band_array", """
SELECT row, col, source, trait, round(std, 8) AS first_band, round(mean, 8) AS second_band FROM target""")
def _(t):
    df = t.target.select("row", "col", "source", "trait", F.array(F.lit("Mean"), F.lit("STD")).alias("names"), F.array("mean", "std").alias("vals"))
    out = rasters.band_array(df, "names", "vals", ["std", "mean"])
    return rounded(out.select("row", "col", "source", "trait", F.col("bands")[0].alias("first_band"), F.col("bands")[1].alias("second_band")), 8)


@query("IO7_params_load", """
SELECT right(trait, 1) AS trait, 1.0::double AS yeo_johnson_lambda, round(avg(v), 6) AS standardize_mean, round(stddev_pop(v), 6) AS standardize_scale FROM obs GROUP BY trait""")
def _(t):
    fitted = t.obs.groupBy("trait").agg(
        F.lit(1.0).alias(transforms.LAMBDA), F.avg("v").alias(transforms.MEAN), F.stddev_pop("v").alias(transforms.SCALE)
    )
    path = scratch_path(t.spark, "params")
    param_files.params_save(fitted, path)
    return rounded(param_files.params_load(t.spark, path))


def _fold_files(t):
    root = scratch_path(t.spark, "folds")
    for trait in ("X1", "X2", "X3", "X4"):
        t.folds.filter(F.col("trait") == trait).select("x", "y", "fold").write.parquet(f"{root}/{trait}.parquet")
    return f"{root}/*.parquet"


@query("IO8_folds_scan", "SELECT trait, x, y, fold FROM folds")
def _(t):
    return param_files.folds_scan(t.spark, _fold_files(t))


@query("IO8_folds_shape", "SELECT trait, count(*) AS n_rows, count(DISTINCT fold) AS n_folds FROM folds GROUP BY trait")
def _(t):
    return param_files.folds_shape(param_files.folds_scan(t.spark, _fold_files(t)))


@query("IO14_dataset_inventory", """
SELECT source AS dataset, count(DISTINCT row // 16 * 100000 + col // 16) AS n_chips, count(DISTINCT trait) AS n_channels,
       array_to_string(list_sort(list(DISTINCT trait)), ',') AS bands FROM target GROUP BY source""")
def _(t):
    df = t.target.select(
        F.col("source").alias("dataset"), (F.floor(F.col("row") / 16) * 100000 + F.floor(F.col("col") / 16)).alias("chip_id"), F.col("trait").alias("band")
    )
    return profile.dataset_inventory(df).withColumn("bands", F.concat_ws(",", "bands"))


@query("IO15_run_summary", "SELECT source, count(*) AS n_files FROM documents GROUP BY source")
def _(t):
    return profile.run_summary(t.read("documents").select("source"), "source")


@query("T3_first_n", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 LIMIT 2)""")
def _(t):
    return sampling.first_n(t.read("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 2)


_IDS = ["STANDARD", "ECONOMY", "Brand#1", "Brand#2"]
_MATCH = {"stems": "SELECT p_partkey, p_type || '_' || p_brand AS stem FROM part UNION ALL SELECT p_partkey, p_type FROM part",
    "ids": "SELECT * FROM (VALUES ('STANDARD', 0), ('ECONOMY', 1), ('Brand#1', 2), ('Brand#2', 3)) v(trait, ord)",
    "matched": """SELECT s.p_partkey, s.stem, min_by(i.trait, CASE WHEN i.trait = s.stem THEN -1 ELSE i.ord END) AS trait
       FROM stems s LEFT JOIN ids i ON contains(s.stem, i.trait) GROUP BY s.p_partkey, s.stem"""}


def _matched(t):
    part = t.read("part")
    stems = part.select("p_partkey", F.concat_ws("_", "p_type", "p_brand").alias("stem")).unionByName(
        part.select("p_partkey", F.col("p_type").alias("stem"))
    )
    ids = t.spark.createDataFrame([(v, i) for i, v in enumerate(_IDS)], "trait string, ord int")
    return transforms.trait_match(stems, ids)


@query("J4_trait_match", "SELECT p_partkey, stem, trait FROM matched", _MATCH)
def _(t):
    return _matched(t)


@query("Q4_trait_coverage", "SELECT p_partkey, stem FROM matched WHERE trait IS NULL", _MATCH)
def _(t):
    return quality.trait_coverage(_matched(t))
