"""Ranks and exact quantiles that hold when one group owns a large part of all rows.

A plain window or ``percentile`` puts each group into one task. The functions here spread a group
over many tasks: ranks by prefix of a uniform key, quantiles by a sketch that brackets the wanted
order statistic and an exact count inside the bracket. Results equal the one-task versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions.missing import finite
from pixelloom.session import small_side

# Rows of one key from which the key is treated as hot, and how many keys the sketch follows.
HOT_ROWS = 1_000_000
TRACKED_KEYS = 10_000
MAX_HOT_KEYS = 1_000
# The bracketing sketch errs by at most n / ACCURACY ranks; the bracket reaches SLACK times as far.
ACCURACY = 50_000
SLACK = 4


def null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, by, how)`` where NULL keys match each other."""
    renamed = right.withColumnsRenamed({c: f"__by{i}" for i, c in enumerate(by)})
    match = [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
    return left.join(renamed, match, how).drop(*[f"__by{i}" for i in range(len(by))])


def spread_rank(
    df: DataFrame, key: str, by: Sequence[str] = (), tie: Sequence[str] = (), out: str = "rn",
    prefix: int = 4,
) -> DataFrame:
    """``row_number() over (partition by <by> order by <key>, <tie>)`` for a hexadecimal hash ``key``.

    The group is cut by the first ``prefix`` digits of the key (65,536 even parts); ranks inside a
    part are shifted by the number of rows in the parts before it, a table of at most 16**prefix
    rows per group.
    """
    by, part, shift, size = list(by), "__part", "__shift", "__size"
    df = df.withColumn(part, F.substring(key, 1, prefix))
    sizes = df.groupBy(*by, part).agg(F.count(F.lit(1)).alias(size))
    before = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = before.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *by, part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(shift)
    )
    local = W.partitionBy(*by, part).orderBy(key, *tie)
    return (
        null_safe_join(df.withColumn(out, F.row_number().over(local)), shifts, [*by, part])
        .withColumn(out, (F.col(out) + F.col(shift)).cast("bigint"))
        .drop(part, shift)
    )


def hot_keys(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of keys with at least ``hot_rows`` rows, at most MAX_HOT_KEYS of them.

    One scan of the key columns with a mergeable heavy-hitter sketch. The answer only steers how
    work is spread, never what is computed, so the sketch's error is harmless.
    """
    top = df.agg(
        F.expr(
            f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in by)}), {MAX_HOT_KEYS}, {TRACKED_KEYS})"
        ).alias("t")
    ).first()["t"]
    return [r["item"] for r in top or [] if r["count"] >= hot_rows]


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], extra: Sequence[Column] = ()
) -> DataFrame:
    """Exact linear-interpolated quantiles of large groups (per trait, source, file ...).

    ``extra`` holds further algebraic aggregates; they ride on pass 1. A group without values keeps
    its row, with NULL quantiles. The input is read twice: :func:`pixelloom.session.cut` it first
    if it is expensive.

    Pass 1 takes count and sketched brackets ``[lo, hi]`` around every wanted rank (map-side
    combined). Pass 2 counts what lies below each bracket and pulls only the distinct values inside
    it, about ``2 * SLACK / ACCURACY`` of a group (all of it up to ACCURACY rows). A bracket that missed its rank raises instead of guessing.
    """
    by, extra = list(by), list(extra)
    df = df.withColumn("__v", finite(F.col(value).cast("double")))
    slack = SLACK / ACCURACY
    edges = [max(p - slack, 0.0) for p in probs.values()] + [min(p + slack, 1.0) for p in probs.values()]
    k = len(probs)
    stats = df.groupBy(*by).agg(
        F.count("__v").alias("__n"),
        F.percentile_approx("__v", [float(e) for e in edges], ACCURACY).alias("__e"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        *[c.alias(f"__x{i}") for i, c in enumerate(extra)],
    )
    names = extra_names(df, extra)
    carried = [f"__x{i}" for i in range(len(extra))]
    tiny = F.col("__n") <= ACCURACY
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (F.lit(float(p)) * (F.col("__n") - 1)).alias("pos"),
                F.when(F.lit(p <= slack) | tiny, F.col("__min")).otherwise(F.col("__e")[i]).alias("lo"),
                F.when(F.lit(p >= 1 - slack) | tiny, F.col("__max")).otherwise(F.col("__e")[k + i]).alias("hi"),
            )
            for i, (name, p) in enumerate(probs.items())
        ]
    )
    found = small_side(stats.select(*by, "__n", wanted.alias("__w"), *carried))
    brackets = found.drop(*carried)
    values = df.select(*by, "__v")
    rows = null_safe_join(values, brackets, by) if by else _attach_single(values, brackets)
    # one row per value becomes one row per (bracket, value-or-"below") and is combined map-side
    hits = (
        rows.select(*by, "__v", F.explode("__w").alias("w"))
        .filter(F.col("__v") <= F.col("w.hi"))
        .select(
            *by, F.col("w.name").alias("__q"), F.col("w.pos").alias("__pos"),
            F.when(F.col("__v") >= F.col("w.lo"), F.col("__v")).alias("__v"),
        )
        .groupBy(*by, "__q", "__pos", "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    run = W.partitionBy(*by, "__q").orderBy(F.col("__v").asc_nulls_first())
    ranked = hits.withColumn("__upto", F.sum("__c").over(run))
    before = F.col("__upto") - F.col("__c")
    lo_rank, hi_rank = F.floor("__pos"), F.ceil("__pos")

    def at(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < F.col("__upto")), F.struct(F.col("__v").alias("v"))))

    picked = ranked.groupBy(*by, "__q", "__pos").agg(at(lo_rank).alias("a"), at(hi_rank).alias("b"))
    share = F.col("__pos") - F.floor("__pos")
    low, high = F.col("a.v"), F.col("b.v")
    exact = F.when(
        low.isNull() | high.isNull(), F.raise_error(F.lit("quantile bracket missed its rank"))
    ).otherwise(low * (F.lit(1.0) - share) + high * share)
    wide = picked.groupBy(*by).pivot("__q", list(probs)).agg(F.first(exact.cast("double")))
    if not extra:
        return wide
    kept = found.select(*by, *[F.col(c).alias(n) for c, n in zip(carried, names)])
    if by:
        return null_safe_join(kept, wide, by, "left")
    return kept.withColumn("__k", F.lit(1)).join(wide.withColumn("__k", F.lit(1)), "__k", "left").drop("__k")


def extra_names(df: DataFrame, extra: Sequence[Column]) -> list[str]:
    """Output names of aliased aggregates."""
    return df.agg(*extra).columns if extra else []


def _attach_single(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a one-row table by a constant equi-key."""
    return (
        df.withColumn("__k", F.lit(1)).join(F.broadcast(one.withColumn("__k", F.lit(1))), "__k").drop("__k")
    )


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], hot_rows: int = HOT_ROWS,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles of many, mostly small groups (per pixel); hot groups take the spread path.

    ``extra`` holds further algebraic aggregates, computed in the same pass.
    """
    by, extra = list(by), list(extra)
    hot = hot_keys(df, by, hot_rows)
    is_hot = F.xxhash64(*by).isin(hot)
    # a percentile's partial results are larger than the values, and few rows share a key: values are dealt and sorted
    rest = (df.filter(~is_hot) if hot else df).repartition(*by)
    v = F.col(value).cast("double")
    group = W.partitionBy(*by)
    ranked = rest.withColumns(
        {"__rn": F.row_number().over(group.orderBy(v.asc_nulls_last())) - 1, "__n": F.count(v).over(group)}
    )
    wanted = []
    for p in probs.values():
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        at = [F.max(F.when((F.col("__rn") == place) & (F.col("__n") > 0), v)) for place in (F.floor(pos), F.ceil(pos))]
        share = F.max(pos - F.floor(pos))
        wanted.append(F.when(share == 0, at[0]).otherwise(at[0] * (F.lit(1.0) - share) + at[1] * share))
    names = extra_names(df, extra)
    plain = ranked.groupBy(*by).agg(*extra, *[q.alias(n) for n, q in zip(probs, wanted)]).select(*by, *names, *probs)
    if not hot:
        return plain
    return plain.unionByName(exact_quantiles(df.filter(is_hot), by, value, probs, extra))
