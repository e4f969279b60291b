"""Seeded sampling without replacement: exact counts, spatial quotas, caps per channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions.seeded import seeded_key
from pixelloom.operators.ranking import spread_rank
from pixelloom.session import cut, small_side


def sample_size(n_total: int, fraction: float) -> int:
    """``max(1, round(n * fraction))`` with half-even rounding."""
    return max(1, round(n_total * fraction))


def sample_exact(
    df: DataFrame, ids: Sequence[str], fraction: float | None = None, n: int | None = None,
    seed: int = 0, by: Sequence[str] = (),
) -> DataFrame:
    """Exactly ``n`` rows (per ``by`` group), or ``fraction`` of all rows, in seeded order.

    The rank is spread over hash prefixes, so a group of any size is sampled without one big sort.
    """
    if n is None:
        n = sample_size(df.count(), fraction)
    ranked = spread_rank(df.withColumn("__h", seeded_key(seed, *ids)), "__h", by, ids, "__rn")
    return ranked.filter(F.col("__rn") <= n).drop("__h", "__rn")


def spatial_bins(chips: DataFrame, g: int) -> DataFrame:
    """Cell of a g x g grid over the extent of chip centres (``cx``, ``cy``); edges belong to the right cell."""
    e = chips.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()

    def bin_of(c: str, lo: float, hi: float):
        if lo is None or hi <= lo:
            # all inner edges coincide with the value, and an edge belongs to the right cell
            return F.lit(g - 1).cast("bigint")
        step = (hi - lo) / g
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(step)), F.lit(g - 1))

    return chips.withColumn(
        "bin", (bin_of("cy", e[2], e[3]) * g + bin_of("cx", e[0], e[1])).cast("bigint")
    )


def spatial_quota(sizes: DataFrame, n: int, seed: int) -> DataFrame:
    """Quota per bin: one each, then the rest in proportion to what is left, by largest remainder.

    With fewer wanted rows than bins, ``n`` bins drawn by seed get one row. ``sizes(bin, size)`` has
    at most g*g rows, so one window over it is bounded.
    """
    everything = W.partitionBy(F.lit(0))
    total = sizes.agg(F.count(F.lit(1)).alias("cells"), F.sum("size").alias("rows")).first()
    cells, rows = total["cells"], total["rows"] or 0
    key = seeded_key(seed, "bin")
    if n < cells:
        order = everything.orderBy(key, "bin")
        return sizes.withColumn("quota", F.when(F.row_number().over(order) <= n, 1).otherwise(0).cast("bigint"))
    left, room = n - cells, rows - cells
    share = F.lit(left / room if room > 0 else 0.0)
    free = F.col("size") - 1
    base = sizes.withColumn("expected", free * share).withColumn(
        "extra", F.least(F.floor("expected"), free)
    ).withColumn("remainder", F.col("expected") - F.col("extra"))
    has_room = (free - F.col("extra")) > 0
    order = everything.orderBy(F.when(has_room, 0).otherwise(1), F.round("remainder", 12).desc(), key, "bin")
    still = F.lit(left) - F.sum("extra").over(everything)
    ranked = base.withColumn("__r", F.row_number().over(order)).withColumn("__left", still)
    plus = F.when((F.col("__r") <= F.col("__left")) & has_room, 1).otherwise(0)
    return ranked.select("bin", "size", (F.lit(1) + F.col("extra") + plus).cast("bigint").alias("quota"))


def sample_spatial_grid(
    chips: DataFrame, n: int, g: int, seed: int, ids: Sequence[str] = ("chip_id",)
) -> DataFrame:
    """Spatially balanced sample of ``n`` chips by the quotas above, seeded draw inside each bin.

    The chip table is read several times, so it is written out once first.
    """
    binned = spatial_bins(cut(chips, "chips"), g)
    quota = small_side(
        spatial_quota(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("size")), n, seed).select("bin", "quota")
    )
    ranked = spread_rank(binned.withColumn("__h", seeded_key(seed, *ids)), "__h", ["bin"], ids, "__rn")
    return ranked.join(quota, "bin").filter(F.col("__rn") <= F.col("quota")).drop("__h", "__rn", "quota")


def cap_per_channel(df: DataFrame, max_pixels: int, seed: int) -> DataFrame:
    """At most ``max_pixels`` supervised pixels per chip and trait; the others lose value and code.

    A group holds one chip's pixels, so its size is bounded by the patch area.
    """
    if max_pixels < 1:
        raise ValueError("max_pixels must be at least 1")
    supervised = F.col("y").isNotNull() & (F.coalesce("source_code", F.lit(0)) > 0)
    key = seeded_key(seed, "dr", "dc")
    order = W.partitionBy("split", "chip_id", "trait").orderBy(F.when(supervised, 0).otherwise(1), key, "dr", "dc")
    keep = supervised & (F.row_number().over(order) <= max_pixels)
    return df.withColumn("__keep", keep).select(
        *[c for c in df.columns if c not in ("y", "source_code")],
        F.when(F.col("__keep"), F.col("y")).alias("y"),
        F.when(F.col("__keep"), F.col("source_code")).otherwise(0).cast("int").alias("source_code"),
    )


def top_overlap(
    pairs: DataFrame, n: int = 9, min_pairs: int = 10, max_pairs: int | None = None, seed: int = 0
) -> DataFrame:
    """Traits with most overlap and the correlation of all their pairs.

    Moments combine before the shuffle, so all pairs cost less than a sample; ``max_pairs`` asks for a seeded one.
    """
    from pixelloom.operators.metrics import trait_metrics

    counts = pairs.groupBy("trait").agg(F.count(F.lit(1)).alias("n_overlap"))
    top = small_side(counts.orderBy(F.desc("n_overlap"), "trait").limit(n).filter(F.col("n_overlap") >= min_pairs))
    used = pairs.join(top, "trait")
    if max_pairs is not None:
        used = sample_exact(used, ["row", "col"], n=max_pairs, seed=seed, by=["trait"])
    return trait_metrics(used, ["trait", "n_overlap"]).select(
        "trait", "n_overlap", F.col("n_valid").alias("n_used"), "pearson_r"
    )


def first_n(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows of the first ``n`` distinct names (debug subset)."""
    names = small_side(df.select(by).distinct().orderBy(by).limit(n))
    return df.join(names, by, "left_semi")
