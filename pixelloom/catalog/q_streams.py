"""Streams over the given tables, compared with their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.catalog.registry import query, rounded
from pixelloom.catalog.tables import PATCH, STRIDE
from pixelloom.session import scratch_path
from pixelloom.streaming import incremental


def _glob(t, name):
    """A glob that finds the table whether it is one file or a folder of files."""
    return f"{t.sf_dir}/{name}.parque[t]"


def _line_stream(t):
    return incremental.read_stream(t.spark, _glob(t, "lineitem"), t.read("lineitem").schema, 100)


@query("X1_metrics_stream", """
SELECT l_returnflag AS trait, count(*) AS n, round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) AS r2, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
       round(avg(p) - avg(y), 6) AS bias, round(avg(y), 6) AS mean_true, round(avg(p), 6) AS mean_pred
FROM (SELECT l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 2.1::double AS p FROM lineitem) GROUP BY l_returnflag""")
def _(t):
    rows = _line_stream(t).select(
        F.col("l_returnflag").alias("trait"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("p")
    )
    out = scratch_path(t.spark, "metrics-stream")
    incremental.metrics_stream(rows, out, f"{out}-checkpoint", scale=2.1).awaitTermination()
    return rounded(t.spark.read.parquet(out))


@query("X2_mosaic_stream", """
SELECT (chip_row * 8 + dr)::int AS row, (chip_col * 8 + dc)::int AS col, trait, round(sum(wt * v) / sum(wt), 6) AS value FROM (
  SELECT l_partkey // 16 AS chip_row, l_suppkey // 16 AS chip_col, l_partkey % 16 AS dr, l_suppkey % 16 AS dc, l_returnflag AS trait, l_quantity AS v,
    pow(least(l_partkey % 16 + 1, 16 - l_partkey % 16) * least(l_suppkey % 16 + 1, 16 - l_suppkey % 16), 2) AS wt FROM lineitem) GROUP BY ALL""")
def _(t):
    """Chips laid out with overlap: pixel blocks of 16 are placed every 8 pixels."""
    scores = _line_stream(t).select(
        F.floor(F.col("l_partkey") / PATCH).cast("int").alias("chip_row"),
        F.floor(F.col("l_suppkey") / PATCH).cast("int").alias("chip_col"),
        (F.col("l_partkey") % PATCH).cast("int").alias("dr"), (F.col("l_suppkey") % PATCH).cast("int").alias("dc"),
        F.col("l_returnflag").alias("trait"), F.col("l_quantity").alias("score"),
    )
    out = scratch_path(t.spark, "mosaic-stream")
    incremental.mosaic_stream(scores, out, f"{out}-checkpoint", t.grid, PATCH, STRIDE).awaitTermination()
    return rounded(incremental.mosaic_result(t.spark, out))


@query("X3_ingest_resume", "SELECT DISTINCT o_custkey FROM orders")
def _(t):
    """Newer orders arrive first; older ones come late and repeat customers; a third run finds nothing new."""
    src, out = scratch_path(t.spark, "arriving"), scratch_path(t.spark, "ingest")
    orders = t.read("orders")
    newer = F.coalesce(F.year("o_orderdate") >= 1995, F.lit(False))
    for part in (orders.filter(newer), orders.filter(~newer), None):
        if part is not None:
            part.write.mode("append").parquet(src)
        incremental.ingest_resume(t.spark, src, orders.schema, out, f"{out}-checkpoint", ["o_custkey"]).awaitTermination()
    return t.spark.read.parquet(out).select("o_custkey")
