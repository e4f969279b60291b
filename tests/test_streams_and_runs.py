"""Streams equal their batch twins; run tables and sinks."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pixelloom import GridSpec
from pixelloom.operators import chips, metrics, profile, runs, score
from pixelloom.session import scratch_path, small_side
from pixelloom.sources import sinks
from pixelloom.streaming import incremental

GRID = GridSpec("c", 1.0, 0.0, -1.0, 40.0, 40, 40)


def test_metrics_stream_final_state_is_the_batch_result(spark):
    df = spark.range(300).select(
        F.concat(F.lit("X"), (F.col("id") % 3).cast("string")).alias("trait"), (F.col("id") % 17).cast("double").alias("y"),
        ((F.col("id") * 7) % 23).cast("double").alias("p"),
    )
    src, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    df.repartition(5).write.parquet(src)
    stream = incremental.read_stream(spark, src, df.schema, files_per_batch=1)
    incremental.metrics_stream(stream, out, f"{out}-ck").awaitTermination()
    got = {r.trait: r for r in spark.read.parquet(out).collect()}
    for r in metrics.one_pass_r2(df, ["trait"]).collect():
        assert got[r.trait].n == r.n and got[r.trait].r2 == pytest.approx(r.r2) and got[r.trait].bias == pytest.approx(r.bias)


def test_mosaic_stream_equals_batch_and_resumes(spark):
    px = spark.range(400).select((F.col("id") % 20).cast("int").alias("row"), F.expr("cast(id div 20 as int)").alias("col"), F.lit("t").alias("trait"))
    scores = chips.pixel_to_chip(px, GRID, 8, 4).withColumn("score", (F.col("chip_id") % 5).cast("double"))
    scores = scores.select("chip_row", "chip_col", "dr", "dc", "trait", "score")
    src, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    scores.repartition(3).write.parquet(src)
    run = lambda: incremental.mosaic_stream(incremental.read_stream(spark, src, scores.schema, 1), out, f"{out}-ck", GRID, 8, 4).awaitTermination()
    run()
    run()
    want = {(r.row, r.col): r.value for r in chips.mosaic_weighted(scores, GRID, 8, 4).collect()}
    got = {(r.row, r.col): r.value for r in incremental.mosaic_result(spark, out).collect()}
    assert set(want) == set(got) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_ingest_takes_new_files_once(spark):
    src, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    schema = "tile_id bigint, ts timestamp"
    run = lambda: incremental.ingest_resume(spark, src, schema, out, f"{out}-ck").awaitTermination()
    stored = lambda: sorted((-1 if r.tile_id is None else r.tile_id) for r in spark.read.parquet(out).collect())

    def arrive(ids, day):
        ts = datetime.fromisoformat(day)
        spark.createDataFrame([(i, ts) for i in ids], schema).write.mode("append").parquet(src)
        run()

    arrive([0, 1, 2, 3, 4, None], "2024-02-01")
    # a month late, with two repeats and a repeated NULL
    arrive([3, 4, 5, 6, 7, 8, 9, None], "2024-01-01")
    run()
    assert stored() == list(range(-1, 10))
    arrive(range(5, 15), "2025-01-01")
    assert stored() == list(range(-1, 15))


def test_selection_rules(spark):
    values = [None, 1.0, 1.05, 0.5, 3.0, float("nan"), 3.0, 2.0]
    df = spark.createDataFrame([("r", 0, i + 1, v) for i, v in enumerate(values)], "run string, seed int, epoch int, value double")
    r = runs.best_checkpoint(df, "max", 0.1).first()
    assert (r.best_value, r.best_epoch) == (3.0, 5)
    assert runs.best_checkpoint(df, "min").first().best_epoch == 4
    s = runs.selection(df, "max", 0.1, patience=2).first()
    assert (s.best_epoch, s.stop_epoch) == (2, 4)
    assert runs.early_stop(df, 2, "max", 0.1).count() == 4
    assert runs.early_stop(df, 50, "max", 0.1).count() == 8
    with pytest.raises(ValueError):
        runs.selection(df, "best")


def test_small_side_gives_up_on_large_tables(spark):
    big = small_side(spark.range(50), max_rows=10)
    assert big.count() == 50
    assert small_side(spark.range(5), max_rows=10).count() == 5


def test_trait_order_and_chip_sink(spark):
    df = spark.createDataFrame([("X10",), ("X9",), ("zeta",), ("X1",)], "trait string")
    assert [r.trait for r in df.orderBy(*sinks.by_trait_number()).collect()] == ["X1", "X9", "X10", "zeta"]
    chip = spark.createDataFrame([("train", 0, 0, 1.0), ("val", 0, 1, 2.0)], "split string, chip_row int, chip_col int, y double")
    path = scratch_path(spark, "chips")
    sinks.chip_sink(chip, path)
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.chip_sink(chip, path)
    sinks.chip_sink(chip, path, overwrite=True)
    assert spark.read.parquet(path).filter("split = 'val'").count() == 1


def test_grid_infer(spark):
    pts = [(5.0 + 2 * c, 100.0 - 3 * r) for r in (0, 1, 2, 4) for c in (0, 1, 2, 6)]
    grid, placed = profile.grid_infer(spark.createDataFrame(pts, "x double, y double"))
    assert (grid.a, grid.e, grid.width, grid.height) == (2.0, -3.0, 7, 5)
    assert {(r.row, r.col) for r in placed.collect()} == {(r, c) for r in (0, 1, 2, 4) for c in (0, 1, 2, 6)}


def test_linear_baseline_recovers_weights(spark):
    df = spark.range(200).select(
        F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("vec"),
        (2.0 * (F.col("id") % 7) - 0.5 * (F.col("id") % 11) + 3).alias("y"),
    )
    model = score.linear_baseline(df, "vec")
    assert list(model.coefficients) == pytest.approx([2.0, -0.5]) and model.intercept == pytest.approx(3.0)
    scored = score.score_batch(df, list(map(float, model.coefficients)), float(model.intercept))
    assert scored.filter("abs(score - y) > 1e-6").count() == 0
    bad = spark.createDataFrame([([None, None],)], "vec array<double>")
    assert score.score_batch(bad, [1.0, 1.0]).first().score is None
