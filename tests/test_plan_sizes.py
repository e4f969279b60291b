"""What the registered queries shuffle, by their physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from pixelloom import GridSpec
from pixelloom.catalog import all_queries
from pixelloom.operators import merge, ranking, splits, zones

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_traits_are_distinct_before_they_are_compared(spark):
    """U1_trait_intersect: no pixel is shuffled, and the join sees one row a trait."""
    text = plan(spark, "U1_trait_intersect")
    assert "l_partkey" not in text
    wide = spark.range(1000).select(F.lit("X1").alias("trait"))
    text = merge.trait_intersect(wide, wide.limit(3))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Join.*?HashAggregate", text, re.S)
    assert [tuple(r) for r in merge.trait_intersect(wide, wide.limit(3)).collect()] == [("X1",)]


def test_percentiles_shuffle_values(spark):
    """A1_band_stats_long: values travel once, no partial percentiles."""
    rows = [(1, 2.0), (1, 4.0), (2, 7.0), (1, None), (3, None), (None, 1.0), (None, 3.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    out = ranking.group_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.05}, extra=[F.count("v").alias("n")])
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "percentile" not in text
    want = df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.05)).alias("q"))
    assert {r.k: (r.n, r.m, r.q and round(r.q, 12)) for r in out.collect()} == {r.k: (r.n, r.m, r.q and round(r.q, 12)) for r in want.collect()}


def test_physical_sums_unfold_after_the_exchange(spark):
    """IO5_to_physical: one shuffled row a pixel and source."""
    text = plan(spark, "IO5_to_physical")
    exchange = re.search(r"Exchange hashpartitioning\((.*?), \d+\)", text).group(1)
    assert "trait" not in exchange


def test_fold_codes_equal_lookup(spark):
    """J15_fold_source_lookup: a pixel is joined once for all traits."""
    grid = GridSpec("EPSG:6933", 10.0, 0.0, -10.0, 50.0, 5, 4)
    obs = spark.createDataFrame(
        [(0, 0, "primary", 1.0, None), (0, 0, "aux", 2.0, 3.0), (1, 2, "aux", None, 4.0), (4, 3, "primary", 5.0, 6.0)],
        "row int, col int, source string, A double, B double",
    )
    folds = spark.createDataFrame(
        [(t, x, y, 0) for t in ("A", "B", "C") for x, y in ((5.0, 45.0), (25.0, 35.0), (99.0, -9.0), (15.0, 15.0))], "trait string, x double, y double, fold int"
    )
    codes = merge.pixel_codes(obs, ["A", "B"])
    merged = merge.by_priority(merge.both_sources(obs, ["A", "B"]), ["mean", "std", "count"])
    cols = ["trait", "x", "y", "fold", "row", "col", "source_code"]
    got = merge.fold_codes(folds, codes, ["A", "B"], grid).select(cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, merge.fold_source_lookup(folds, merged, grid).select(cols).collect()))
    text = plan(spark, "J15_fold_source_lookup")
    assert not re.search(r"Exchange hashpartitioning\([^)]*trait", text)


def test_cell_union_takes_the_first_kind(spark):
    """U3_cell_union: cells of 4 x 4 pixels, so a larger grid has more of them."""
    ids = "cell_id long, parent_id long"
    p, a, v = (spark.createDataFrame(r, ids) for r in ([(1, 9), (1, 9)], [(1, 9), (2, 9)], [(2, 9), (3, 8), (1, 9)]))
    got = {tuple(r) for r in splits.cell_union_by_priority(p, a, v).collect()}
    assert got == {(1, 9, "primary"), (2, 9, "aux"), (3, 8, "none")}
    counts = [all_queries()["U3_cell_union"](spark, f"/root/testdata/{sf}").count() for sf in ("sf0.001", "sf0.01")]
    assert counts[1] > 4 * counts[0] and counts[1] > 2500


def test_zone_order_places_bare_pixels(spark):
    """T5_zone_order: no measures are aggregated for a table of pixel counts."""
    sizes = zones.zone_sizes(
        spark.createDataFrame([(0,), (0,), (2,), (-1,)], "zone_id int"),
        spark.createDataFrame([(0, 0, "A"), (1, 1, "B"), (2, 2, "N/A")], "zone_id int, ord int, name string"),
    )
    assert [tuple(r) for r in zones.zone_order(sizes).collect()] == [(0, "A", 2), (0, "B", 0), (1, "N/A", 1), (2, "TOTAL", 3)]


@pytest.mark.parametrize("name", ["U1_trait_union", "U2_trait_except"])
def test_other_trait_sets_move_no_pixels(spark, name):
    assert "l_partkey" not in plan(spark, name)


def test_declustering_of_like_cells(spark):
    """I3_decluster_invariants: where all cells are copies the distance is 0 but for rounding, which must not stop a swap."""
    key = 1 << 24
    at = [(r, c) for r in range(12) for c in range(12)]
    label = lambda r, c: 2 if r < 3 and c < 3 else 1 if r > 9 else 0
    labels = spark.createDataFrame([(c * key + r, label(r, c)) for r, c in at], "cell_id long, label int")
    counts = [5, 17, 3, 11, 29, 7, 13, 2, 19, 23, 1, 31]
    hist_rows = [(c * key + r, f, b, n * m) for r, c in at for f, m in (("a", 1), ("b", 3)) for b, n in enumerate(counts)]
    counted = spark.createDataFrame(hist_rows, "cell_id long, feature string, bin int, n long")
    edges = spark.createDataFrame([(f, 0.0, 12.0, 1.0, 12) for f in ("a", "b")], "feature string, lo double, hi double, width double, n_bins int")
    after = splits.split_decluster(labels, counted, edges, k=1, kind="square", seed=1).cache()
    bad = [splits.violations(x, "square", 1, (splits.TEST,)).count() for x in (labels, after)]
    assert bad[0] == 9 and bad[1] < bad[0]
    assert {r["label"]: r["count"] for r in after.groupBy("label").count().collect()} == {0: 111, 1: 24, 2: 9}
