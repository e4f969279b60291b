"""Priority merge of a primary and an auxiliary source, and summaries of the merged labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.grid import GridSpec
from pixelloom.operators.ranking import HOT_ROWS, exact_quantiles, group_quantiles, hot_keys

KEY = ["row", "col", "trait"]
BANDS = ["mean", "std", "median", "q05", "q95", "count"]
# Source codes of merged labels.
NONE, AUX, PRIMARY = 0, 1, 2


def _moment_columns(v: str) -> list[Column]:
    return [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("count")]


def trait_points(obs: DataFrame, traits: Sequence[str]) -> DataFrame:
    """``row, col, trait`` of the pixels that have an observation of the trait, without their bands."""
    wide = obs.groupBy("row", "col").agg(*[F.count(t).alias(t) for t in traits])
    return wide.select("row", "col", F.explode(F.array(*[F.when(F.col(t) > 0, t) for t in traits])).alias("trait")).filter("trait is not null")


def _unpivot_structs(df: DataFrame, by: Sequence[str], traits: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("s")) for t in traits])
    return (
        df.select(*by, F.explode(rows).alias("r"))
        .select(*by, "r.trait", "r.s.*")
        .filter(F.col("count") > 0)
    )


def band_moments(obs: DataFrame, traits: Sequence[str] | None = None) -> DataFrame:
    """Mean, std and count bands; algebraic, so map-side combining absorbs hot pixels.

    With ``traits`` the observations are wide (one column per trait) and are unpivoted after the
    aggregation: one shuffled row per pixel and source instead of one per trait.
    """
    by = ["row", "col", "source"]
    if traits is None:
        return obs.groupBy(*by, "trait").agg(*_moment_columns("v"))
    wide = obs.groupBy(*by).agg(*[F.struct(*_moment_columns(t)).alias(t) for t in traits])
    return _unpivot_structs(wide, by, traits)


MOMENTS = ["mean", "std", "count"]
QUANTILES = {"median": 0.5, "q05": 0.05, "q95": 0.95}


def band_stats(
    obs: DataFrame, traits: Sequence[str] | None = None, hot_rows: int = HOT_ROWS, bands: Sequence[str] = BANDS
) -> DataFrame:
    """The target ``bands`` (all six) per pixel, source and trait in one shuffle.

    Wide observations (``traits`` given) shuffle one row per observation whatever the number of
    traits. Pixels with very many observations leave the per-pixel percentile for the spread path.
    """
    by = ["row", "col", "source"]
    if traits is None:
        keys = [*by, "trait"]
        moments = [c for n, c in zip(MOMENTS, _moment_columns("v")) if n in bands]
        probs = {n: p for n, p in QUANTILES.items() if n in bands}
        return group_quantiles(obs.select(*keys, "v"), keys, "v", probs, hot_rows, extra=moments).select(*keys, *bands)
    hot = hot_keys(obs, by, hot_rows)
    is_hot = F.xxhash64(*by).isin(hot)
    probs = F.array(*[F.lit(p) for p in QUANTILES.values()])
    wide = (obs.filter(~is_hot) if hot else obs).groupBy(*by).agg(
        *[F.struct(*_moment_columns(t), F.percentile(t, probs).alias("q")).alias(t) for t in traits]
    )
    out = _unpivot_structs(wide, by, traits).select(
        *by, "trait", "mean", "std", *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)], "count"
    ).select(*by, "trait", *bands)
    if not hot:
        return out
    long = obs.filter(is_hot).unpivot(by, list(traits), "trait", "v").filter(F.col("v").isNotNull())
    spread = exact_quantiles(long, [*by, "trait"], "v", QUANTILES, _moment_columns("v"))
    return out.unionByName(spread.select(*out.columns))


def paired_means(obs: DataFrame, traits: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Pixels with both sources straight from wide observations: one conditional aggregation, no join.

    ``n_primary`` counts the observations behind the truth.
    """
    by = ["row", "col"]
    is_primary = F.col("source") == "primary"
    wide = obs.groupBy(*by).agg(
        *[
            F.struct(
                F.avg(F.when(is_primary, F.col(t))).alias(y), F.avg(F.when(~is_primary, F.col(t))).alias(p),
                F.count(F.when(is_primary, F.col(t))).alias("n_primary"),
            ).alias(t)
            for t in traits
        ]
    )
    rows = F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("s")) for t in traits])
    return (
        wide.select(*by, F.explode(rows).alias("r"))
        .select(*by, "r.trait", "r.s.*")
        .filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    )


def both_sources(obs: DataFrame, traits: Sequence[str]) -> DataFrame:
    """``row, col, trait`` with the mean, std and count bands of the auxiliary (``g``) and primary (``s``) source as structs.

    Straight from wide observations: one scan and one conditional aggregation, one shuffled row per pixel and task
    whatever the number of traits. A source without an observation is a NULL struct; traits unfold last.
    """
    is_primary = F.col("source") == "primary"

    def side(t: str, ours: Column) -> Column:
        return F.struct(*_moment_columns(F.when(ours, F.col(t))))

    wide = obs.groupBy("row", "col").agg(
        *[F.struct(side(t, ~is_primary).alias("g"), side(t, is_primary).alias("s")).alias(t) for t in traits]
    )
    rows = F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t)["g"].alias("g"), F.col(t)["s"].alias("s")) for t in traits])
    long = wide.select("row", "col", F.inline(rows))
    return long.filter((F.col("g.count") > 0) | (F.col("s.count") > 0)).select(
        *KEY, *[F.when(F.col(f"{x}.count") > 0, F.col(x)).alias(x) for x in ("g", "s")]
    )


def join_sources(aux: DataFrame, primary: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """The same from two tables of bands; (row, col, trait) is unique per side, so the join key cannot be hot."""
    g = aux.select(*KEY, F.struct(*bands).alias("g"))
    s = primary.select(*KEY, F.struct(*bands).alias("s"))
    return g.join(s, KEY, "full_outer")


def by_priority(sides: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """Primary replaces aux where its first band is valid; code NULL where no first band is valid."""
    first = bands[0]
    use_primary = F.col(f"s.{first}").isNotNull()
    return sides.select(
        *KEY,
        *[F.when(use_primary, F.col(f"s.{b}")).otherwise(F.col(f"g.{b}")).alias(b) for b in bands],
        F.when(use_primary, PRIMARY)
        .when(F.col(f"g.{first}").isNotNull(), AUX)
        .cast("tinyint")
        .alias("source_code"),
    )


def by_band(sides: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """Band-by-band merge; the code looks at any band and is 0 where nothing is valid.

    Also keeps ``in_aux`` and ``in_primary`` (any band valid), which the summaries count.
    """

    def any_band(side: str) -> Column:
        return reduce(lambda p, q: p | q, [F.col(f"{side}.{b}").isNotNull() for b in bands])

    return sides.select(
        *KEY,
        *[F.coalesce(f"s.{b}", f"g.{b}").alias(b) for b in bands],
        F.when(any_band("s"), PRIMARY).when(any_band("g"), AUX).otherwise(NONE)
        .cast("tinyint").alias("source_code"),
        any_band("g").alias("in_aux"),
        any_band("s").alias("in_primary"),
    )


def merge_priority(aux: DataFrame, primary: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """:func:`by_priority` of two tables."""
    return by_priority(join_sources(aux, primary, bands), bands)


def merge_priority_per_band(aux: DataFrame, primary: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """:func:`by_band` of two tables."""
    return by_band(join_sources(aux, primary, bands), bands)


def merge_summary(merged: DataFrame, grid: GridSpec) -> DataFrame:
    """Per trait of a :func:`by_band` merge: which sources exist, pixels by source, overlap, empty pixels and shares."""
    code = F.col("source_code")
    counts = merged.groupBy("trait").agg(
        F.bool_or("in_aux").alias("has_aux"),
        F.bool_or("in_primary").alias("has_primary"),
        F.count_if(code == AUX).alias("n_aux_only"),
        F.count_if(code == PRIMARY).alias("n_primary"),
        F.count_if(F.col("in_aux") & F.col("in_primary")).alias("n_both"),
    )
    total = F.col("n_aux_only") + F.col("n_primary")

    def pct(part: str) -> Column:
        return F.when(F.col("n_total") > 0, F.bround(F.try_divide(F.col(part) * 100.0, F.col("n_total")), 1)).otherwise(0.0)

    return (
        counts.withColumn("n_total", total)
        .withColumn("n_no_data", F.lit(grid.height * grid.width).cast("bigint") - F.col("n_total"))
        .withColumn("pct_primary", pct("n_primary"))
        .withColumn("pct_aux_only", pct("n_aux_only"))
    )


def merge_summary_total(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("n_traits"),
        F.count_if("has_aux").alias("n_traits_aux"),
        F.count_if("has_primary").alias("n_traits_primary"),
        F.avg("n_primary").alias("mean_primary"),
        F.avg("n_aux_only").alias("mean_aux_only"),
        F.avg("n_both").alias("mean_both"),
        F.avg("pct_primary").alias("mean_pct_primary"),
    )


def best_source_map(merged: DataFrame) -> DataFrame:
    """Best source per pixel over all traits; 0 becomes missing."""
    return merged.groupBy("row", "col").agg(
        F.nullif(F.max("source_code").cast("int"), F.lit(NONE)).alias("best_source")
    )


def best_source_counts(merged: DataFrame, grid: GridSpec) -> DataFrame:
    """Class counts of the best-source map over the whole grid."""
    best = F.col("best_source")
    counted = best_source_map(merged).agg(
        F.count_if(best == PRIMARY).alias("n_primary"), F.count_if(best == AUX).alias("n_aux")
    )
    cells = F.lit(grid.height * grid.width).cast("bigint")
    return counted.withColumn("n_no_data", cells - F.col("n_primary") - F.col("n_aux"))


def source_pairs(sides: DataFrame, band: str = "mean", y: str = "y", p: str = "p") -> DataFrame:
    """Pixels where both sources have the band: ``y`` from primary, ``p`` from aux."""
    return sides.select(*KEY, F.col(f"s.{band}").alias(y), F.col(f"g.{band}").alias(p)).filter(
        F.col(y).isNotNull() & F.col(p).isNotNull()
    )


def trait_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("trait").union(b.select("trait")).distinct()


def trait_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct before anything is joined: a trait of a large table is one row a task."""
    return a.select("trait").distinct().intersect(b.select("trait").distinct())


def trait_except(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Requested traits that are not available."""
    return wanted.select("trait").distinct().join(have.select("trait").distinct(), "trait", "left_anti")


def placed_folds(folds: DataFrame, grid: GridSpec) -> DataFrame:
    """Fold points with their pixel; coordinates are truncated and clipped to the grid."""

    def clipped(v: Column, n: int) -> Column:
        return F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(n - 1))

    return folds.select(
        "trait", "x", "y", "fold",
        clipped(grid.fractional_row("y"), grid.height).alias("row"),
        clipped(grid.fractional_col("x"), grid.width).alias("col"),
    )


def fold_source_lookup(folds: DataFrame, merged: DataFrame, grid: GridSpec) -> DataFrame:
    """Source code under each fold point."""
    return placed_folds(folds, grid).join(merged.select(*KEY, "source_code"), KEY, "left")


def pixel_codes(obs: DataFrame, traits: Sequence[str]) -> DataFrame:
    """``row, col`` and a column per trait with its :func:`by_priority` source code, straight from wide observations."""
    code = F.when(F.col("source") == "primary", PRIMARY).otherwise(AUX)
    best = [F.max(F.when(F.col(t).isNotNull(), code)).cast("tinyint").alias(t) for t in traits]
    return obs.groupBy("row", "col").agg(*best)


def fold_codes(folds: DataFrame, codes: DataFrame, traits: Sequence[str], grid: GridSpec) -> DataFrame:
    """:func:`fold_source_lookup` in the codes of :func:`pixel_codes`: a pixel is joined once for all its traits."""
    each = F.coalesce(*[F.when(F.col("trait") == t, F.col(f"__{t}")) for t in traits])
    named = codes.select("row", "col", *[F.col(t).alias(f"__{t}") for t in traits])
    return placed_folds(folds, grid).join(named, ["row", "col"], "left").select("trait", "x", "y", "fold", "row", "col", each.alias("source_code"))


def fold_counts(lookup: DataFrame, folds: Sequence[int] = range(5)) -> DataFrame:
    """Primary-source pixels per trait and fold."""
    counted = (
        lookup.filter(F.col("source_code") == PRIMARY).groupBy("trait").pivot("fold", list(folds)).count()
    )
    return counted.select(
        "trait", *[F.coalesce(F.col(str(f)), F.lit(0)).cast("bigint").alias(f"fold_{f}") for f in folds]
    )


def fold_consistency(counts: DataFrame, folds: Sequence[int] = range(5), limit: float = 100.0) -> DataFrame:
    """Spread of each fold's count over traits; ``consistent`` where the sample std stays small."""
    pairs = ", ".join(f"{f}, fold_{f}" for f in folds)
    long = counts.select(F.expr(f"stack({len(list(folds))}, {pairs}) as (fold, n)"))
    return long.groupBy("fold").agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.stddev_samp("n").alias("n_std")
    ).withColumn("consistent", F.col("n_std") < F.lit(limit))


def trait_meta_join(metrics: DataFrame, meta: DataFrame, predicted: DataFrame) -> DataFrame:
    """Attach display name and unit, keep predicted traits, sort by display name."""
    return (
        metrics.join(meta, "trait")
        .join(predicted.select("trait").distinct(), "trait", "left_semi")
        .orderBy("display", "trait")
    )
