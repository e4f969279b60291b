"""Spread ranks and quantiles equal the one-task versions, also for one dominant group."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions import seeded_key
from pixelloom.operators import profile, scan
from pixelloom.operators.merge import band_stats
from pixelloom.operators.ranking import exact_quantiles, group_quantiles, hot_keys, spread_rank

PROBS = {"q0": 0.0, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q1": 1.0}


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in group 0, few distinct values in group 1, tiny groups beyond."""
    return spark.range(60_000).select(
        F.when(F.col("id") < 20_000, 0).when(F.col("id") < 30_000, 1).otherwise(2 + F.col("id") % 5000).cast("int").alias("g"),
        F.when((F.col("id") >= 20_000) & (F.col("id") < 30_000), F.col("id") % 3)
        .otherwise(F.abs(F.hash("id")) % 100_003 / F.lit(7.0)).cast("double").alias("v"),
        "id",
    ).cache()


def expected(rows):
    out = {}
    for g, v in rows:
        out.setdefault(g, []).append(v)
    return {g: np.percentile(v, [0, 5, 50, 95, 100]) for g, v in out.items()}


def test_exact_quantiles_of_large_and_small_groups(spark, skewed):
    want = expected([(r.g, r.v) for r in skewed.collect()])
    got = exact_quantiles(skewed, ["g"], "v", PROBS, [F.count("v").alias("n")]).collect()
    assert len(got) == len(want) and sum(r.n for r in got) == 60_000
    for r in got:
        np.testing.assert_allclose([r[k] for k in PROBS], want[r.g], rtol=1e-12)


def test_exact_quantiles_without_groups_and_values(spark, skewed):
    r = exact_quantiles(skewed, [], "v", PROBS).first()
    np.testing.assert_allclose([r[k] for k in PROBS], np.percentile([x.v for x in skewed.collect()], [0, 5, 50, 95, 100]))
    empty = skewed.withColumn("v", F.lit(None).cast("double"))
    r = exact_quantiles(empty, [], "v", {"m": 0.5}, [F.count("v").alias("n")]).first()
    assert r.n == 0 and r.m is None


def test_hot_groups_take_the_spread_path(spark, skewed):
    assert len(hot_keys(skewed, ["g"], 5_000)) == 2
    assert hot_keys(skewed, ["g"], 1_000_000) == []
    plain = {r.g: (r.q50, r.n) for r in group_quantiles(skewed, ["g"], "v", {"q50": 0.5}, extra=[F.count("v").alias("n")]).collect()}
    spread = {r.g: (r.q50, r.n) for r in group_quantiles(skewed, ["g"], "v", {"q50": 0.5}, 5_000, [F.count("v").alias("n")]).collect()}
    assert plain == spread


def test_band_stats_with_a_hot_pixel(spark):
    wide = spark.range(5000).select(
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 100).cast("int").alias("row"), F.lit(0).alias("col"),
        F.when(F.col("id") % 2 == 0, "aux").otherwise("primary").alias("source"),
        (F.abs(F.hash("id")) % 997).cast("double").alias("A"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("B"),
    )
    normal = sorted((tuple(r) for r in band_stats(wide, ["A", "B"]).collect()), key=str)
    hot = sorted((tuple(r) for r in band_stats(wide, ["A", "B"], hot_rows=500).collect()), key=str)
    assert len(normal) == len(hot)
    by_key = {r[:4]: r[4:] for r in normal}
    for r in hot:
        np.testing.assert_allclose(r[4:], by_key[r[:4]], rtol=1e-12)


def test_spread_rank_equals_row_number(skewed):
    keyed = skewed.withColumn("h", seeded_key(3, "id"))
    w = W.partitionBy("g").orderBy("h", "id")
    for prefix in (1, 4):
        ranked = spread_rank(keyed, "h", ["g"], ["id"], "rn", prefix).withColumn("want", F.row_number().over(w))
        assert ranked.filter("rn <> want").count() == 0 and ranked.count() == 60_000
    whole = spread_rank(keyed, "h", [], ["id"])
    assert whole.select("rn").distinct().count() == 60_000 and whole.agg(F.max("rn")).first()[0] == 60_000


def test_null_group_and_nan_keep_their_place(spark):
    from pyspark.sql import functions as F

    from pixelloom.operators.ranking import exact_quantiles, spread_rank

    nan = float("nan")
    df = spark.createDataFrame([(1, "X", 5.0), (2, "X", nan), (3, None, 1.0), (4, None, 2.0), (5, None, 3.0)], "id int, trait string, v double")
    ranked = spread_rank(df.withColumn("h", F.md5(F.col("id").cast("string"))), "h", ["trait"]).collect()
    assert sorted((r.trait or "", r.rn) for r in ranked) == [("", 1), ("", 2), ("", 3), ("X", 1), ("X", 2)]
    for extra in ((), (F.count(F.lit(1)).alias("n"),)):
        got = {r.trait: r.med for r in exact_quantiles(df, ["trait"], "v", {"med": 0.5}, extra).collect()}
        assert got == {None: 2.0, "X": 5.0}


@pytest.mark.parametrize("parts", [1, 6])
def test_scans_equal_one_task(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), rng.randrange(9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, n int, i int").repartition(7)
    place = lambda k: -1 if k is None else k
    for r in scan.running_sum(df, "k", "n", ["g"], parts=parts).collect():
        assert r.upto == sum(n for g, k, n, _ in rows if g == r.g and place(k) <= place(r.k))
    whole = scan.running_sum(df, "k", "n", parts=parts).collect()
    assert len(whole) == 500 and all(r.upto == sum(n for _, k, n, _ in rows if place(k) <= place(r.k)) for r in whole)
    keys = df.select("g", "k").distinct().filter("k is not null")
    got = {(r.g, r.k): r.before for r in scan.previous(keys, "k", ["g"], parts=parts).collect()}
    known = {(g, k) for g, k, _, _ in rows if k is not None}
    assert got == {(g, k): max((x for h, x in known if h == g and x < k), default=None) for g, k in known}
    assert scan.running_sum(df.limit(0), "k", "n", parts=parts).count() == 0
    shares = profile.cdf(df, "k").collect()
    assert {r.k: r.cum_share for r in shares} == {k: pytest.approx(sum(place(x) <= place(k) for _, x, _, _ in rows) / 500) for k in {r[1] for r in rows}}
