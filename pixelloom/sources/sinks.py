"""Writers: metrics, chips, split tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.session import scratch_path

METRIC_SCHEMA = (
    "trait string, n_valid bigint, rmse double, nrmse double, r2 double, pearson_r double, mae double"
)


def by_trait_number(trait: str = "trait") -> list:
    """Numeric trait ids in numeric order, other names last."""
    digits = F.regexp_extract(F.col(trait), r"^X?([0-9]+)$", 1)
    return [F.when(digits != "", digits.cast("int")).asc_nulls_last(), F.col(trait)]


def metrics_sink(df: DataFrame, path: str | None = None) -> Callable[[SparkSession], str]:
    """Write per-trait CSV in trait order and a JSON summary; returns where they are.

    One row per trait: the order is kept across part files.
    """

    def write(spark: SparkSession) -> str:
        target = path or scratch_path(spark, "metrics")
        df.orderBy(*by_trait_number()).write.option("header", True).csv(f"{target}/traits")
        rows = df.select(F.to_json(F.struct("*")).alias("value"))
        rows.write.text(f"{target}/summary")
        return target

    return write


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).option("header", True).csv(f"{path}/traits")


def chip_sink(chips: DataFrame, path: str, overwrite: bool = False) -> None:
    """Chips by split; an existing store is refused unless ``overwrite``.

    Rows are spread by (split, chip) so that a dominant split is written by many tasks, and row
    groups hold many chips.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    (
        chips.repartition("split", "chip_row", "chip_col")
        .sortWithinPartitions("split", "chip_row", "chip_col")
        .write.partitionBy("split")
        .mode(mode)
        .parquet(path)
    )


def split_table(cells: DataFrame, counts: DataFrame, traits: list[str], sources: list[str]) -> DataFrame:
    """Cell, split, source, number of traits, and one count column per trait and source."""
    columns = [
        F.coalesce(
            F.sum(F.when((F.col("trait") == t) & (F.col("source") == s), F.col("n"))), F.lit(0)
        ).cast("bigint").alias(f"{t}_{s}")
        for t in traits
        for s in sources
    ]
    wide = counts.groupBy("cell_id").agg(
        F.count_distinct(F.when(F.col("n") > 0, F.col("trait"))).alias("n_traits"), *columns
    )
    names = [f"{t}_{s}" for t in traits for s in sources]
    return cells.join(wide, "cell_id", "left").na.fill(0, ["n_traits", *names])


def split_sink(cells: DataFrame, counts: DataFrame, traits: list[str], sources: list[str], path: str) -> None:
    split_table(cells, counts, traits, sources).write.parquet(path)
