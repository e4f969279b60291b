"""Chips, supervision, sampling, scoring and score mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.catalog.q_metrics import _SCORES
from pixelloom.catalog.registry import query, rounded
from pixelloom.catalog.tables import PATCH, STRIDE
from pixelloom.operators import chips, masks, metrics, quality, sampling, score
from pixelloom.session import scratch_path
from pixelloom.sources import sinks

_PX = "row, col, trait, chip_row, chip_col, chip_id, dr, dc"


def _cols(df, *extra):
    return df.select(*[c.strip() for c in _PX.split(",")], *extra)


@query("J7_pixel_to_chip", f"SELECT {_PX} FROM chip_pixels")
def _(t):
    return _cols(t.chip_pixels)


@query("J8_chip_splits", """
SELECT chip_row, chip_col, chip_id, pixel_split AS split, count(DISTINCT dr * 16 + dc) AS n_pixels FROM chip_pixels GROUP BY ALL""")
def _(t):
    return chips.chip_splits(t.chip_pixels)


@query("J8_overlap_report", """
SELECT n_splits, count(*) AS n_chips FROM (SELECT chip_id, count(DISTINCT pixel_split) AS n_splits FROM chip_pixels GROUP BY chip_id) GROUP BY n_splits""")
def _(t):
    return chips.overlap_report(chips.chip_splits(t.chip_pixels))


# a target counts as finite here where the primary mean is at least 10
_STRICT = {"verdict": """SELECT chip_id, split, bool_or(pixel_split = split AND y >= 10) AS keep FROM chips GROUP BY ALL"""}


def _strict(t):
    return t.chips.withColumn("y", F.when(F.col("y") >= 10, F.col("y")))


@query("J9_require_valid_target", """
SELECT c.chip_id, c.split, c.row, c.col, c.trait FROM chips c JOIN verdict v ON v.chip_id = c.chip_id AND v.split = c.split WHERE v.keep""", _STRICT)
def _(t):
    return chips.require_valid_target(_strict(t))[0].select("chip_id", "split", "row", "col", "trait")


@query("J9_valid_target_report", """
SELECT split, count(*) FILTER (keep) AS n_kept, count(*) FILTER (NOT keep) AS n_skipped FROM verdict GROUP BY split""", _STRICT)
def _(t):
    return chips.require_valid_target(_strict(t))[1]


@query("P8_split_mask", f"""
SELECT {_PX}, split, round(CASE WHEN pixel_split = split THEN y END, 6) AS y, round(CASE WHEN pixel_split = split THEN pred END, 6) AS pred FROM chips""")
def _(t):
    return rounded(_cols(masks.split_mask(t.chips), "split", "y", "pred"))


@query("Q2_split_leakage", """
SELECT split, 0::bigint AS n_leaked, count(*) FILTER (pixel_split = split) AS n_kept FROM chips GROUP BY split""")
def _(t):
    return quality.split_leakage(masks.split_mask(t.chips))


@query("P9_supervision_slice", f"SELECT {_PX} FROM chip_pixels WHERE dr BETWEEN 4 AND 11 AND dc BETWEEN 4 AND 11")
def _(t):
    return _cols(masks.supervision_slice(t.chip_pixels, "center_crop", PATCH, 8))


@query("P9_supervision_center_pixel", f"SELECT {_PX} FROM chip_pixels WHERE dr = 7 AND dc = 7")
def _(t):
    return _cols(masks.supervision_slice(t.chip_pixels, "center_pixel", PATCH))


@query("P10_mask_by_validity", """
SELECT row, col, trait, source_code, round(CASE WHEN pred >= 0.05::double THEN y END, 6) AS y FROM (SELECT row, col, trait, source_code, y, p AS pred FROM coded_pairs)""")
def _(t):
    df = t.coded_pairs.withColumn("valid", F.col("p") >= 0.05)
    return rounded(masks.mask_by_validity(df).select("row", "col", "trait", "source_code", "y"))


@query("IO11_chip_sink", f"SELECT {_PX}, split, round(y, 6) AS y FROM chips")
def _(t):
    path = scratch_path(t.spark, "chips")
    sinks.chip_sink(t.chips, path)
    return rounded(_cols(t.spark.read.parquet(path), "split", "y"))


@query("IO11_chip_arrays", """
SELECT split, chip_id, trait, count(*) AS n_valid, 256 AS n_slots, round(avg(y::float), 4) AS mean FROM (SELECT DISTINCT split, chip_id, trait, dr, dc, y FROM chips) GROUP BY ALL""")
def _(t):
    packed = chips.chip_arrays(t.chips, PATCH)
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))
    n = F.size(F.filter("data", lambda v: v.isNotNull()))
    return rounded(
        packed.select("split", "chip_id", "trait", n.cast("bigint").alias("n_valid"), F.size("data").alias("n_slots"), (total / n).alias("mean")), 4)


@query("IO12_chip_bounds", """
SELECT DISTINCT chip_row, chip_col, chip_id, chip_col * 176000.0::double AS xmin, h * 22000.0::double - chip_row * 176000.0::double - 352000 AS ymin,
       chip_col * 176000.0::double + 352000 AS xmax, h * 22000.0::double - chip_row * 176000.0::double AS ymax FROM chip_pixels, dims""")
def _(t):
    distinct = t.chip_pixels.select("chip_row", "chip_col", "chip_id").distinct()
    return chips.chip_bounds(distinct, t.grid, PATCH, STRIDE)


_SCORED = {
    "scored": "SELECT chip_row, chip_col, trait, dr, dc, pred + 0.1::double * (chip_row % 3) AS score FROM chip_pixels",
    "placed": """SELECT (chip_row * 8 + dr)::int AS row, (chip_col * 8 + dc)::int AS col, trait, score AS v,
      pow(least(dr + 1, 16 - dr) * least(dc + 1, 16 - dc), 2) AS wt FROM scored""",
    "mosaic": "SELECT row, col, trait, sum(wt * v) / sum(wt) AS value FROM placed GROUP BY ALL",
}


def _scores(t):
    return t.chip_pixels.select(
        "chip_row", "chip_col", "trait", "dr", "dc", (F.col("pred") + F.lit(0.1) * (F.col("chip_row") % 3)).alias("score")
    )


@query("A31_mosaic_weighted", "SELECT row, col, trait, round(value, 6) AS value FROM mosaic", _SCORED)
def _(t):
    return rounded(chips.mosaic_weighted(_scores(t), t.grid, PATCH, STRIDE))


@query("A31_mosaic_cropped", """
SELECT (chip_row * 8 + dr)::int AS row, (chip_col * 8 + dc)::int AS col, trait,
       round(sum(pow(least(dr - 3, 12 - dr) * least(dc - 3, 12 - dc), 2) * score) / sum(pow(least(dr - 3, 12 - dr) * least(dc - 3, 12 - dc), 2)), 6) AS value
FROM scored WHERE dr BETWEEN 4 AND 11 AND dc BETWEEN 4 AND 11 GROUP BY ALL""", _SCORED)
def _(t):
    inner = _scores(t).filter("dr between 4 and 11 and dc between 4 and 11")
    inner = inner.withColumns({"dr": F.col("dr") - 4, "dc": F.col("dc") - 4})
    return rounded(chips.mosaic_weighted(inner, t.grid, PATCH, STRIDE, crop=8))


@query("A17_dense_supervision", """
SELECT split, trait, count(*) AS n_valid, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(corr(y, pred), 6) AS pearson_r
FROM chips WHERE pixel_split = split GROUP BY ALL""")
def _(t):
    m = metrics.trait_metrics(masks.split_mask(t.chips), ["split", "trait"], p="pred")
    return rounded(m.select("split", "trait", "n_valid", "rmse", "pearson_r"))


_W1 = """SELECT chip_id, chip_row, chip_col FROM (
 SELECT *, row_number() OVER (ORDER BY md5('11:' || chip_id), chip_id) AS rn, count(*) OVER () AS n FROM one_chip)
 WHERE rn <= greatest(1, round_even(n * 0.3::double, 0))"""
_ONE = {"one_chip": "SELECT DISTINCT chip_id, chip_row, chip_col FROM chip_pixels"}


def _one_chip(t):
    return t.chip_pixels.select("chip_id", "chip_row", "chip_col").distinct()


@query("W1_sample_exact", _W1, _ONE)
def _(t):
    return sampling.sample_exact(_one_chip(t), ["chip_id"], fraction=0.3, seed=11)


_W2 = {**_ONE,
    "ext": "SELECT min(chip_col) AS x0, max(chip_col) AS x1, min(chip_row) AS y0, max(chip_row) AS y1 FROM one_chip",
    "binned": """SELECT chip_id, (CASE WHEN y1 > y0 THEN least(floor((chip_row - y0) / ((y1 - y0)::double / 4)), 3) ELSE 3 END * 4
       + CASE WHEN x1 > x0 THEN least(floor((chip_col - x0) / ((x1 - x0)::double / 4)), 3) ELSE 3 END)::bigint AS bin FROM one_chip, ext""",
    "sizes": "SELECT bin, count(*) AS size, count(*) OVER () AS cells, sum(count(*)) OVER () AS n_all FROM binned GROUP BY bin",
    "base": """SELECT *, (size - 1) * ((100 - cells)::double / (n_all - cells)) AS expected,
       least(floor((size - 1) * ((100 - cells)::double / (n_all - cells))), size - 1) AS extra FROM sizes""",
    "quota2": """SELECT bin, size, (1 + extra + CASE WHEN size - 1 - extra > 0 AND row_number() OVER (
         ORDER BY CASE WHEN size - 1 - extra > 0 THEN 0 ELSE 1 END, round(expected - extra, 12) DESC, md5('13:' || bin), bin)
         <= 100 - cells - sum(extra) OVER () THEN 1 ELSE 0 END)::bigint AS quota FROM base""",
}


def _centred(t):
    return _one_chip(t).select("chip_id", F.col("chip_col").alias("cx"), F.col("chip_row").alias("cy"))


@query("W2_spatial_quota", "SELECT bin, size, quota FROM quota2", _W2)
def _(t):
    binned = sampling.spatial_bins(_centred(t), 4)
    return sampling.spatial_quota(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("size")), 100, 13)


@query("W2_sample_spatial_grid", """
SELECT chip_id, bin FROM (SELECT b.*, quota, row_number() OVER (PARTITION BY b.bin ORDER BY md5('13:' || chip_id), chip_id) AS rn
 FROM binned b JOIN quota2 q ON q.bin = b.bin) WHERE rn <= quota""", _W2)
def _(t):
    return sampling.sample_spatial_grid(_centred(t), 100, 4, 13).select("chip_id", "bin")


@query("W3_cap_per_channel", """
SELECT split, chip_id, trait, dr, dc, round(CASE WHEN rn <= 2 THEN y END, 6) AS y, CASE WHEN rn <= 2 THEN source_code ELSE 0 END AS source_code
FROM (SELECT *, row_number() OVER (PARTITION BY split, chip_id, trait ORDER BY md5('5:' || dr || ':' || dc), dr, dc) AS rn FROM chips)""")
def _(t):
    out = sampling.cap_per_channel(t.chips, 2, 5)
    return rounded(out.select("split", "chip_id", "trait", "dr", "dc", "y", "source_code"))


# ---- predictor vectors -------------------------------------------------------------------------

_SHARE = {"shares": """SELECT *, coalesce(len(list_filter(vec, lambda v: v IS NOT NULL)), 0)::double / 64 AS share,
  list_transform(vec, lambda v: CASE WHEN v IS NULL THEN 0 ELSE greatest(least(v, 0.2::float), -0.2::float) END) AS clean FROM predictor"""}


@query("P4_predictor_validity", "SELECT vec_id, share >= 0.7::double AS valid FROM shares", _SHARE)
def _(t):
    return masks.predictor_validity(t.predictor, "vec", "min_fraction", 0.7).select("vec_id", "valid")


@query("P4_predictor_validity_all_any", "SELECT vec_id, share >= 1 AS all_valid, share > 0 AS any_valid FROM shares", _SHARE)
def _(t):
    df = masks.predictor_validity(t.predictor, "vec", "all", out="all_valid")
    return masks.predictor_validity(df, "vec", "any", out="any_valid").select("vec_id", "all_valid", "any_valid")


@query("P5_sanitise_vector", """
SELECT vec_id, pos::int AS pos, round(clean[pos]::double, 6) AS v FROM shares, range(1, 65) g(pos)""", _SHARE)
def _(t):
    from pixelloom.functions import sanitise_vector

    out = t.predictor.select("vec_id", F.posexplode(sanitise_vector(F.col("vec"), -0.2, 0.2)).alias("pos", "v"))
    return rounded(out.select("vec_id", (F.col("pos") + 1).alias("pos"), F.col("v").cast("double").alias("v")))


_WEIGHTS = [round((i % 7 - 3) / 10, 1) for i in range(64)]


@query("M1_score_batch", f"""
SELECT vec_id, round(CASE WHEN share >= 0.2::double THEN
  list_sum(list_transform(list_zip(list_transform(vec, lambda v: coalesce(v, 0)::double), {_WEIGHTS}::double[]), lambda z: z[1] * z[2])) + 0.5::double END, 6) AS score FROM shares""", _SHARE)
def _(t):
    return rounded(score.score_batch(t.predictor, _WEIGHTS, 0.5).select("vec_id", "score"))


@query("M1_score_batch_opaque", f"""
SELECT vec_id, round(CASE WHEN share >= 0.2::double THEN
  list_sum(list_transform(list_zip(list_transform(vec, lambda v: coalesce(v, 0)::double), {_WEIGHTS}::double[]), lambda z: z[1] * z[2])) + 0.5::double END, 6) AS score FROM shares""", _SHARE)
def _(t):
    import numpy as np

    weights = np.array(_WEIGHTS)

    def model(batch):
        return batch.astype(float) @ weights + 0.5

    return rounded(score.score_batch(t.predictor, model).select("vec_id", "score"))


@query("M2_linear_baseline", f"""
SELECT trait, {_SCORES} FROM (SELECT f.trait, f.y, m.b0 + m.b1 * f.p + m.b2 * f.north AS p FROM fit_rows f JOIN fitted m ON m.trait = f.trait WHERE f.part = 'test') GROUP BY trait""", {
    "fit_rows": """SELECT trait, y, p, row / 1000.0::double AS north, CASE WHEN source_code = 2 THEN 2.0::double ELSE 1.0::double END AS wt,
 CASE WHEN row // ((h + 19) // 20) < 14 THEN 'train' WHEN row // ((h + 19) // 20) < 17 THEN 'val' ELSE 'test' END AS part FROM coded_pairs, dims""",
    "fit_means": """SELECT trait, sum(wt) AS sw, sum(wt * p) / sum(wt) AS mp, sum(wt * north) / sum(wt) AS mn, sum(wt * y) / sum(wt) AS my
 FROM fit_rows WHERE part = 'train' GROUP BY trait""",
    "fit_moments": """SELECT f.trait, any_value(mp) AS mp, any_value(mn) AS mn, any_value(my) AS my, sum(wt * (p - mp) * (p - mp)) AS pp, sum(wt * (p - mp) * (north - mn)) AS pn,
 sum(wt * (north - mn) * (north - mn)) AS nn, sum(wt * (p - mp) * (y - my)) AS py, sum(wt * (north - mn) * (y - my)) AS ny
 FROM fit_rows f JOIN fit_means m ON m.trait = f.trait WHERE part = 'train' GROUP BY f.trait""",
    "fitted": """SELECT trait, b1, b2, my - b1 * mp - b2 * mn AS b0 FROM (SELECT *, (py * nn - ny * pn) / (pp * nn - pn * pn) AS b1, (ny * pp - py * pn) / (pp * nn - pn * pn) AS b2 FROM fit_moments)""",
})
def _(t):
    """Weighted linear fit of truth on prediction and northing in the train rows of every trait, evaluated on the test rows."""
    df = t.coded_pairs.withColumns(
        {"split": t.pixel_split, "w": F.when(F.col("source_code") == 2, 2.0).otherwise(1.0), "north": F.col("row") / F.lit(1000.0)}
    )
    models = score.linear_baselines(df.filter("split = 'train'"), ["p", "north"], "y", "w")
    scored = score.score_baselines(df.filter("split = 'test'"), models, ["p", "north"])
    return rounded(metrics.trait_metrics(scored, p="score"))
