"""Missing values, transforms, projections, masks, metrics and losses on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom import GridSpec, grid_offset
from pixelloom.functions import (
    clip_inverse_domain,
    colour_index,
    from_6933,
    inverse_yeo_johnson,
    normalise_missing,
    sanitise_vector,
    to_6933,
    yeo_johnson_core,
)
from pixelloom.operators import masks, merge, metrics, profile, quality, score, transforms
from pixelloom.operators.transforms import DenormOptions
from pixelloom.sources import rasters

NAN, INF = float("nan"), float("inf")
PARAMS = "trait string, yeo_johnson_lambda double, standardize_mean double, standardize_scale double"


def pairs(spark, rows):
    return spark.createDataFrame(rows, "trait string, y double, p double")


def test_missing_rule(spark):
    df = spark.createDataFrame([(NAN,), (INF,), (-INF,), (-9999.0,), (255.0,), (None,), (1.5,)], "v double")
    got = [r[0] for r in df.select(normalise_missing(F.col("v"), [-9999.0, 255.0])).collect()]
    assert got == [None] * 6 + [1.5]
    near = spark.createDataFrame([(-9999.01,), (-9990.0,)], "v double")
    assert [r[0] for r in near.select(normalise_missing(F.col("v"), [-9999.0])).collect()] == [None, -9990.0]
    assert [r[0] for r in near.select(normalise_missing(F.col("v"), [-9999.0], False)).collect()] == [-9999.01, -9990.0]


def test_inverse_undoes_forward(spark):
    rows = [(v, lam) for v in (-3.0, -0.5, 0.0, 0.2, 7.0) for lam in (-0.3, 0.0, 0.7, 2.0, 2.6)]
    df = spark.createDataFrame(rows, "v double, lam double").withColumn("t", yeo_johnson_core(F.col("v"), F.col("lam")))
    for r in df.withColumn("back", inverse_yeo_johnson(F.col("t"), F.col("lam"))).collect():
        assert r.back == pytest.approx(r.v, abs=1e-9)
        if r.v >= 0:
            want = math.log1p(r.v) if r.lam == 0 else ((r.v + 1) ** r.lam - 1) / r.lam
        else:
            two = 2 - r.lam
            want = -math.log1p(-r.v) if two == 0 else -((1 - r.v) ** two - 1) / two
        assert r.t == pytest.approx(want, abs=1e-9)


def test_domain_clip(spark):
    df = spark.createDataFrame([(9.0, -0.5), (-9.0, 3.0), (1.0, 1.0), (-1.0, -0.5)], "y double, lam double")
    got = [r[0] for r in df.select(clip_inverse_domain(F.col("y"), F.col("lam"), ratio=0.1)).collect()]
    assert got == pytest.approx([2.0 - 0.2, -1.0 + 0.1, 1.0, -1.0])


def test_denormalise_rules(spark):
    params = spark.createDataFrame([("X1", 1.0, 2.0, 3.0)], PARAMS)
    df = spark.createDataFrame([("X1", 5.0), ("X1", None), ("X1", NAN)], "trait string, value double")
    got = [r.physical for r in transforms.denormalise(df, params, DenormOptions(clip_z=2.0)).collect()]
    assert got == [pytest.approx(8.0), None, None]
    capped = transforms.denormalise(df, params, DenormOptions(cap=4.0)).collect()
    assert capped[0].physical == 4.0
    other = spark.createDataFrame([("X7", 1.0)], "trait string, value double")
    with pytest.raises(Exception, match="no transform parameters"):
        transforms.denormalise(other, params).collect()
    kept, missing = transforms.denormalise_all(df.unionByName(other), params, "keep")
    assert kept.count() == 4 and [r.trait for r in missing.collect()] == ["X7"]
    assert transforms.denormalise_all(df.unionByName(other), params, "drop")[0].count() == 3


def test_params_contract(spark):
    ok = spark.createDataFrame([("X1", 1.0, 0.0, 1.0), ("2", 1.0, 0.0, 1.0)], PARAMS)
    assert sorted(r.trait for r in transforms.check_params(ok).collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="duplicate"):
        transforms.check_params(ok.unionByName(spark.createDataFrame([("1", 1.0, 0.0, 1.0)], PARAMS)))
    with pytest.raises(ValueError, match="lacks"):
        transforms.check_params(ok.drop("standardize_scale"))


def test_fit_recovers_lambda(spark):
    rng = np.random.default_rng(1)
    lam = 0.4
    z = rng.normal(1.0, 0.3, 4000)
    v = (z * lam + 1) ** (1 / lam) - 1
    df = spark.createDataFrame([("a", float(x)) for x in v], "variable string, v double")
    r = transforms.fit_yeo_johnson(df, "variable").first()
    assert r.yeo_johnson_lambda == pytest.approx(lam, abs=0.15)
    assert r.standardize_scale == pytest.approx(0.3, abs=0.1) and r.n == 4000
    sampled = transforms.fit_yeo_johnson(df.withColumn("i", F.monotonically_increasing_id()), "variable", max_fit=3000, ids=["i"]).first()
    assert sampled.n == 3000 and sampled.yeo_johnson_lambda == pytest.approx(lam, abs=0.2)


def test_trait_match_takes_exact_then_first_substring(spark):
    files = spark.createDataFrame([("X46",), ("X4_mean",), ("other",)], "stem string")
    params = spark.createDataFrame([("X4", 0), ("X46", 1)], "trait string, ord int")
    got = {r.stem: r.trait for r in transforms.trait_match(files, params).collect()}
    assert got == {"X46": "X46", "X4_mean": "X4", "other": None}
    only = spark.createDataFrame([("X4", 0)], "trait string, ord int")
    assert transforms.trait_match(files, only).filter("stem = 'X46'").first().trait == "X4"


def test_projection_constants_and_inverse(spark):
    df = spark.createDataFrame([(180.0, 90.0), (-75.3, -41.2), (0.0, 0.0), (12.0, 63.5)], "lon double, lat double")
    x, y = to_6933(F.col("lon"), F.col("lat"))
    rows = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    first = rows.first()
    assert first.x == pytest.approx(17_367_530.45, abs=0.01) and first.y == pytest.approx(7_342_230.14, abs=0.01)
    lon, lat = from_6933(F.col("x"), F.col("y"))
    for r in rows.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=1e-9) and r.lat2 == pytest.approx(r.lat, abs=2e-6)
    assert masks.project_6933(-75.3, -41.2) == pytest.approx((rows.collect()[1].x, rows.collect()[1].y))


def test_colour_and_vectors(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (9.0,)], "v double")
    assert [r[0] for r in df.select(colour_index(F.col("v"), F.lit(0.0), F.lit(1.0))).collect()] == [None, 0, 127, 255]
    one = spark.createDataFrame([([NAN, INF, None, 3.0, 2e4],)], "vec array<double>")
    assert one.select(sanitise_vector(F.col("vec"))).first()[0] == [0.0, 0.0, 0.0, 3.0, 1e4]
    assert masks.predictor_validity(one, mode="min_fraction", min_ratio=0.4).first().valid is True
    assert masks.predictor_validity(one, mode="all").first().valid is False


def test_grid_snap_rounds_half_even_and_last_wins(spark):
    g = GridSpec("EPSG:4326", 1.0, 0.0, -1.0, 3.0, 3, 3)
    pts = spark.createDataFrame([(0.4, 2.6, 0, 1.0), (0.6, 2.4, 1, 2.0), (9.0, 1.0, 2, 3.0), (1.0, 2.5, 3, 4.0)], "x double, y double, o int, v double")
    kept, dropped = rasters.grid_snap(pts, g, ordinal="o")
    # 1.0 lies between columns 0 and 1: half-even gives column 0
    assert {(r.row, r.col): r.v for r in kept.collect()} == {(0, 0): 4.0}
    assert dropped.first().n_dropped == 1
    assert grid_offset(GridSpec("c", 1.0, 2.0, -1.0, 1.0, 1, 1), g) == (2, 2)
    with pytest.raises(ValueError):
        grid_offset(GridSpec("c", 1.0, 2.5, -1.0, 1.0, 1, 1), g)


def test_band_reorder_reports_missing(spark):
    df = spark.createDataFrame([(1, 2)], "Mean int, STD int")
    assert rasters.band_reorder(df, ["std", "mean"]).columns == ["std", "mean"]
    with pytest.raises(ValueError):
        rasters.band_reorder(df, ["median"])


def test_r2_rules(spark):
    df = pairs(spark, [("c", 2.0, 2.0), ("c", 2.0, 3.0), ("p", 2.0, 2.0), ("p", 2.0, 2.0), ("one", 1.0, 1.5), ("none", None, 1.0), ("none", NAN, 1.0)])
    got = {r.trait: r for r in metrics.trait_metrics(df).collect()}
    assert got["c"].r2 == 0.0 and got["p"].r2 == 1.0 and got["one"].r2 is None
    assert got["none"].n_valid == 0 and got["none"].rmse is None
    assert got["c"].nrmse is None and got["c"].pearson_r is None
    other = {r.trait: r.r2 for r in metrics.one_pass_r2(df, ["trait"]).collect()}
    assert other["c"] is None and other["p"] is None


def test_two_meanings_of_macro_rmse(spark):
    df = pairs(spark, [("a", 0.0, 1.0), ("a", 1.0, 2.0), ("b", 0.0, 3.0)])
    macro, pooled = metrics.macro_metrics(df).first(), metrics.macro_pooled(df).first()
    assert macro.macro_rmse == pytest.approx(2.0) and macro.n_valid == 3
    assert pooled.rmse_macro == pytest.approx(math.sqrt(11 / 3)) == pytest.approx(macro.rmse)


def test_global_metrics_equal_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(5, 2, 400), rng.normal(5, 2, 400)
    df = pairs(spark, [("ab"[i % 2], float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))])
    r = metrics.macro_metrics(df).first()
    assert r.pearson_r == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert r.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_losses(spark):
    rows = [("a", 0.0, 2.0, 2), ("a", 0.0, 1.0, 1), ("a", 0.0, 9.0, 0), ("b", None, 1.0, 2)]
    df = spark.createDataFrame(rows, "trait string, y double, p double, source_code int")
    assert metrics.weighted_loss(df, 2.0, 1.0).first().loss == pytest.approx((2 * 4 + 1) / 3)
    assert metrics.weighted_loss(df.filter("source_code = 0")).first().loss == 0.0
    per = {r.trait: r.loss for r in metrics.per_trait_loss(df).collect()}
    assert per["a"] == pytest.approx(3.0) and per["b"] is None
    assert metrics.combined_loss(df.filter("source_code = 2"), 1.0, 0.1).first().loss == pytest.approx(4.0)


def test_two_merges_differ(spark):
    schema = "row int, col int, trait string, mean double, std double"
    aux = spark.createDataFrame([(0, 0, "t", 1.0, 1.0), (0, 1, "t", None, 5.0), (0, 2, "t", 3.0, 3.0)], schema)
    primary = spark.createDataFrame([(0, 0, "t", None, 9.0), (0, 2, "t", 7.0, None)], schema)
    first = {r.col: r for r in merge.merge_priority(aux, primary, ["mean", "std"]).collect()}
    band = {r.col: r for r in merge.merge_priority_per_band(aux, primary, ["mean", "std"]).collect()}
    assert (first[0].mean, first[0].std, first[0].source_code) == (1.0, 1.0, 1)
    assert (band[0].mean, band[0].std, band[0].source_code) == (1.0, 9.0, 2)
    assert first[1].source_code is None and band[1].source_code == 1
    assert (first[2].mean, first[2].std) == (7.0, None) and band[2].std == 3.0


def test_summary_invariant(spark):
    schema = "row int, col int, trait string, mean double"
    aux = spark.createDataFrame([(0, 0, "t", 1.0), (0, 1, "t", 1.0)], schema)
    primary = spark.createDataFrame([(0, 1, "t", 2.0), (1, 1, "u", 2.0)], schema)
    grid = GridSpec("c", 1.0, 0.0, -1.0, 4.0, 4, 5)
    for r in merge.merge_summary(merge.merge_priority_per_band(aux, primary, ["mean"]), grid).collect():
        assert r.n_aux_only + r.n_primary == r.n_total and r.n_total + r.n_no_data == 20


def test_quality(spark):
    df = spark.createDataFrame([(0, 0, "t", None, 2), (0, 1, "t", 5.0, 1)], "row int, col int, trait string, mean double, source_code int")
    r = quality.merge_sanity(df, bands=["mean"]).first()
    assert r.status == "FAIL" and not r.empty_ok and r.codes_ok
    bad = {(x.check, x.subject): x.n_bad for x in quality.table_contract(df, {"row": "int", "zzz": "int"}, ["row"]).collect()}
    assert bad[("missing_column", "zzz")] == 1 and bad[("duplicate_key", "row")] == 1


def test_water_mask_outside_extent_stays(spark):
    dem = spark.createDataFrame([(r, c, 1.0) for r in range(2) for c in range(2)], "row int, col int, value double")
    mask = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "row int, col int, land int")
    got = {(r.row, r.col): r.value for r in masks.apply_water_mask(dem, mask, (0, 1, 0, 2)).collect()}
    assert got == {(0, 0): None, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 1.0}
    # a pixel inside the extent but absent from the sparse mask is nodata
    got = {(r.row, r.col): r.value for r in masks.apply_water_mask(dem, mask, (0, 2, 0, 2)).collect()}
    assert got[(1, 0)] is None


def test_bad_arguments(spark):
    df = spark.createDataFrame([(0, 0)], "dr int, dc int")
    with pytest.raises(ValueError):
        masks.supervision_slice(df, "center_crop", 4, 9)
    with pytest.raises(ValueError):
        masks.predictor_validity(df, mode="most")
    with pytest.raises(ValueError):
        metrics.error_term(F.col("a"), F.col("b"), "l4")


def test_both_sources_equal_the_join_of_two_tables(spark):
    rows = [(r % 3, r % 5, "aux" if r % 4 else "primary", None if r % 7 == 0 else float(r), None if r < 30 else r / 2.0) for r in range(60)]
    rows += [(9, 9, "aux", None, None), (None, 1, "primary", 1.0, 2.0)]
    obs = spark.createDataFrame(rows, "row int, col int, source string, a double, b double")
    sides = merge.both_sources(obs, ["a", "b"])
    bands = ["mean", "std", "count"]
    table = merge.band_moments(obs, ["a", "b"])
    part = lambda s: table.filter(F.col("source") == s).drop("source")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in merge.by_priority(sides, bands).collect()}
    want = {tuple(r)[:3]: tuple(r)[3:] for r in merge.merge_priority(part("aux"), part("primary"), bands).collect()}
    assert set(got) == set(want) and (9, 9, "a") not in got and (None, 1, "b") in got
    for key, values in got.items():
        assert values == pytest.approx(want[key])
    pairs = {tuple(r)[:3] for r in merge.source_pairs(sides).collect()}
    assert pairs == {k for k in got if table.filter((F.col("row") == k[0]) & (F.col("col") == k[1]) & (F.col("trait") == k[2])).count() == 2}


def test_linear_fits_equal_least_squares(spark):
    rng = np.random.default_rng(4)
    rows = []
    for trait in ("a", "b", None):
        x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) + 5
        y = x @ rng.normal(size=3) + 2 + rng.normal(size=200)
        rows += [(trait, *map(float, r), float(v), float(w)) for r, v, w in zip(x, y, rng.integers(1, 4, 200))]
    good = list(rows)
    rows += [("a", None, 1.0, 1.0, 1.0, 1.0), ("a", 1.0, float("nan"), 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0, None, 1.0)]
    # features that depend on each other
    rows += [("c", float(i), 2.0 * i, 1.0, 1.0 * i, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "trait string, u double, v double, t double, y double, w double").repartition(5)
    models = score.linear_baselines(df, ["u", "v", "t"], "y", "w")
    got = {r.trait: r for r in models.collect()}
    assert set(got) == {"a", "b", None, "c"} and got["c"].coefficients is None
    for trait in ("a", "b", None):
        m = np.array([r[1:] for r in good if r[0] == trait])
        root = np.sqrt(m[:, 4:])
        want = np.linalg.lstsq(np.column_stack((np.ones(200), m[:, :3])) * root, m[:, 3] * root[:, 0], rcond=None)[0]
        assert [got[trait].intercept, *got[trait].coefficients] == pytest.approx(want) and got[trait].total_weight == m[:, 4].sum()
    scored = score.score_baselines(df, models, ["u", "v", "t"])
    assert scored.count() == len(rows)
    assert scored.filter("score is null").count() == 2 + 9
    whole = score.linear_baselines(df.filter("trait = 'a'"), ["u", "v", "t"], "y", "w", by=[]).first()
    assert whole.coefficients == pytest.approx(got["a"].coefficients)
    assert score.linear_baselines(df.limit(0), ["u"], "y").count() == 0


def test_histogram_pair_per_group(spark):
    rng = np.random.default_rng(1)
    rows = [(g, s, float(v)) for g in ("a", None) for s in ("truth", "pred") for v in rng.normal(size=300)] + [("flat", "truth", 1.0)] * 5
    df = spark.createDataFrame(rows, "g string, sample string, value double")
    got = {(r.g, r.sample, r.bin): r.n for r in profile.histogram_pair(df, 7, by=["g"]).collect()}
    for g in ("a", None):
        v = np.array([x for k, _, x in rows if k == g])
        lo, hi = np.quantile(v, [0.01, 0.99])
        for s in ("truth", "pred"):
            mine = np.array([x for k, t, x in rows if (k, t) == (g, s)])
            want = np.histogram(mine, np.linspace(lo, hi, 8))[0]
            assert [got.get((g, s, b), 0) for b in range(7)] == want.tolist()
    assert not any(k[0] == "flat" for k in got)
    alone = df.filter("g = 'a'")
    assert {(r.sample, r.bin): r.n for r in profile.histogram_pair(alone, 7).collect()} == {k[1:]: n for k, n in got.items() if k[0] == "a"}
