"""Streams: running metrics, running mosaics, and resumable ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pixelloom.functions.missing import finite
from pixelloom.grid import GridSpec
from pixelloom.operators.chips import placed_scores, weighted_mean, weighted_sums
from pixelloom.operators.metrics import one_pass_r2


def read_stream(
    spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1
) -> DataFrame:
    """Parquet files as they arrive; finished files are remembered by the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def metrics_stream(
    stream: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("trait",), scale: float = 1.0,
    offset: float = 0.0,
) -> StreamingQuery:
    """Running n, r2, rmse, bias per group over arriving (y, p) rows.

    State is one row of moments per group, so it does not grow with the data. Every batch replaces
    the result table under ``path``; the last state equals the batch operator.
    """
    result = one_pass_r2(stream, by, scale, offset)

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        result.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .trigger(availableNow=True)
        .start()
    )


def mosaic_stream(
    stream: DataFrame, path: str, checkpoint: str, grid: GridSpec, patch: int, stride: int, crop: int | None = None
) -> StreamingQuery:
    """Append each batch's weighted sums per pixel; :func:`mosaic_result` adds them up.

    Sums and weights are additive, so no state is kept in memory whatever the map's size. A batch
    writes its own folder by overwriting it, so a repeated batch counts once.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        part = weighted_sums(placed_scores(batch, grid, patch, stride, crop))
        part.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(append)
        .trigger(availableNow=True)
        .start()
    )


def mosaic_result(spark: SparkSession, path: str) -> DataFrame:
    """Current mosaic from the batch sums."""
    sums = spark.read.parquet(path).groupBy("row", "col", "trait").agg(
        F.sum("sum_wv").alias("sum_wv"), F.sum("sum_w").alias("sum_w")
    )
    return sums.filter(F.col("sum_w") > 0).select("row", "col", "trait", weighted_mean().alias("value"))


def ingest_resume(
    spark: SparkSession, source: str, schema: StructType | str, path: str, checkpoint: str,
    keys: Sequence[str] = ("tile_id",), files_per_batch: int = 100, value: str | None = None,
) -> StreamingQuery:
    """Each arriving key once, however late it comes or how often it is repeated.

    Finished files are skipped and unfinished batches repeated. A batch stores the keys that no
    earlier batch holds; the stored keys themselves are the state, so nothing expires and no
    executor has to keep them. A repeated batch overwrites its own folder and compares itself with
    the batches before it only. NULL is a key like any other; rows whose ``value`` is missing are skipped.
    """
    stream = read_stream(spark, source, schema, files_per_batch)
    if value:
        stream = stream.filter(finite(F.col(value)).isNotNull())

    def store(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(list(keys))
        if batch_id > 0:
            held = batch.sparkSession.read.parquet(path).filter(F.col("batch") < batch_id)
            held = held.select(*[F.col(k).alias(f"__held{i}") for i, k in enumerate(keys)])
            new = new.join(held, [F.col(k).eqNullSafe(F.col(f"__held{i}")) for i, k in enumerate(keys)], "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .trigger(availableNow=True)
        .start()
    )
