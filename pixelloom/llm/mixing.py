"""Mixing sources to target weights by entropy balancing.

Documents get rates that differ least, in relative entropy, from one each, while every source's tokens meet its target and
no rate exceeds a bound. The dual of this convex problem has one multiplier a source; its solution is the exponentially
tilted rate ``min(bound, exp(multiplier * size))``, so a document's rate depends on its source and size alone. Newton
iterations run over the table of (source, size, count), which Spark aggregates once from all documents: each one sums tokens
and their derivative by source and moves the multipliers, kept between a lower and an upper bound.

Rates become whole copies by systematic rounding: along each source's documents, largest first, a document gets one copy
for each half-integer that the running sum of rates passes. Running sums are per (source, size) cell plus a rank within the
cell, which is counted in hashed parts; no source is put into one task. The error of a source stays below half its largest
document. Everything is DataFrame functions.

Defined cases: null and empty texts have size 0 and are taken 0 words of; a null source is a source of its own, the last
one; repeated rows are rounded one by one; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
BOUND = 3.0
TOLERANCE = 1e-9
#: Parts of a cell for ranks: a row's rank is counted within its part.
PART_ROWS = 4096


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, bound: float = BOUND) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares by weight of all tokens, at most ``bound`` times the size.

    What a source can't take is reshared by weight. That ends where every source gets ``min(bound * size, level * weight)``
    with one level for all, found from running sums in the order in which sources reach their bound.
    """
    # one row a source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sources.withColumn("weight", cycle).withColumn("most", F.col("source_size") * F.lit(bound))
    reach = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before, after = reach.rowsBetween(Window.unboundedPreceding, -1), reach.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = named.withColumn("level", level).withColumn("place", F.row_number().over(reach)).withColumn("free", F.col("level") * F.col("weight") <= F.col("most"))
    # the first source in that order that stays below its bound sets the level
    common = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(whole)["level"]
    return ranked.withColumn("common", common).select(
        "source", "source_size", F.when(F.col("common").isNull(), F.col("most")).otherwise(F.least("most", F.col("common") * F.col("weight"))).alias("target")
    )


def balance(cells: DataFrame, targets: DataFrame, bound: float = BOUND) -> DataFrame:
    """(source, multiplier, unit, full): multipliers of size / unit that meet the targets; full sources take ``bound`` of all."""
    start = cut(
        cells.where("size > 0")
        .groupBy("source")
        .agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("unit"), F.min("size").alias("least"))
        .join(targets, "source")
        .select(
            "source",
            "target",
            "unit",
            (F.col("target") >= F.col("source_size") * F.lit(bound * (1 - TOLERANCE))).alias("full"),
            F.lit(0.0).alias("multiplier"),
            # lower and upper bound: below 1 the multiplier is negative, above it positive
            F.when(F.col("target") <= F.col("source_size"), F.lit(float("-inf"))).otherwise(0.0).alias("low"),
            F.when(F.col("target") <= F.col("source_size"), F.lit(0.0)).otherwise(F.log(F.lit(bound)) * F.col("unit") / F.col("least")).alias("high"),
        ),
        "multipliers",
    )
    state = start
    while True:
        joined = cells.where("size > 0").join(state.where("NOT full AND target > 0"), "source")
        rate = F.exp(F.col("multiplier") * F.col("size") / F.col("unit"))
        tokens = F.col("n") * F.col("size")
        sums = (
            joined.withColumn("rate", F.least(rate, F.lit(bound)))
            .groupBy("source")
            .agg(
                F.sum(tokens * F.col("rate")).alias("taken"),
                F.sum(F.when(F.col("rate") < bound, tokens * F.col("rate") * F.col("size") / F.col("unit")).otherwise(0.0)).alias("slope"),
            )
        )
        met = state.join(sums, "source", "left")
        # Newton's step on log(taken) - log(target), inside the bounds; halving where it leaves them
        off = F.log(F.col("taken") / F.col("target"))
        low = F.when(off < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") - off * F.try_divide(F.col("taken"), F.col("slope"))
        moved = met.select("source", "target", "unit", "full", "multiplier", low.alias("low"), high.alias("high"), step.alias("step"), F.abs(off).alias("off"))
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        half = F.when(F.col("low") == float("-inf"), 2 * F.col("high") - 1).otherwise((F.col("low") + F.col("high")) / 2)
        settled = F.col("off").isNull() | (F.col("off") <= TOLERANCE) | (F.col("high") - F.col("low") <= 1e-13 * F.abs("high"))
        following = moved.withColumn("multiplier", F.when(settled, F.col("multiplier")).when(inside, F.col("step")).otherwise(half))
        state = cut(following.withColumn("settled", settled), "multipliers")
        if state.where("NOT settled").isEmpty():
            return state.select("source", "multiplier", "unit", "full", "target")
        state = state.drop("step", "off", "settled")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), one row for each row of ``docs``."""
    key = F.col(source_col).cast("string")
    sized = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            # a null source has a key of its own, so that joins and groups need no null-safe keys
            F.when(key.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), key)).alias("source"),
            word_count(F.col(text_col).cast("string")).alias("size"),
        ),
        "sizes",
    )
    cells = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = cut(source_targets(sizes), "targets")
    found = balance(cells, targets)
    rate = F.when(F.col("full"), F.lit(BOUND)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.least(F.lit(BOUND), F.exp(F.col("multiplier") * F.col("size") / F.col("unit"))))
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rated = (
        cells.join(found, "source", "left")
        .withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate))
        .withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(larger), F.lit(0.0)))
        .withColumn("parts", F.ceil(F.col("n") / F.lit(PART_ROWS)))
        .select("source", "size", "rate", "before", "parts")
    )
    rated = cut(rated, "rates")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    placed = sized.join(rated, ["source", "size"]).withColumn("part", part)
    counts = placed.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("source", "size", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")), "offsets")
    within = Window.partitionBy("source", "size", "part").orderBy("doc_id")
    ranked = placed.withColumn("rank", F.row_number().over(within)).join(offsets, ["source", "size", "part"])
    upto = lambda k: F.floor(F.col("before") + F.col("rate") * k + F.lit(0.5))
    rank = F.col("offset") + F.col("rank")
    copies = upto(rank) - upto(rank - 1)
    return (
        ranked.select("doc_id", "source", "size", "rate", copies.alias("copies"))
        .join(targets, "source")
        .select(
            "doc_id",
            F.when(F.col("source") == "1", F.lit(None)).otherwise(F.substring("source", 2, 1 << 30)).alias("source"),
            "size",
            "source_size",
            "target",
            "rate",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it has copies, with their columns as they were."""
    held = docs.withColumnsRenamed({c: f"_own_{i}" for i, c in enumerate(docs.columns)})
    own = dict(zip(docs.columns, held.columns))
    keys = ["_id", "_source", "_size"]
    text = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    mixed = mix(docs).select(text.alias("_id"), source.alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    taken = cut(mixed, "taken")
    keyed = (
        held.withColumn("_id", F.coalesce(F.concat(F.lit("="), F.col(own["doc_id"]).cast("string")), F.lit("null")))
        .withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col(own["source"]).cast("string")), F.lit("null")))
        .withColumn("_size", word_count(F.col(own["text"]).cast("string")))
    )
    # as a rule a key names one row; rows with equal keys are matched by rank
    repeated = cut(taken.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").select(*keys), "repeated")
    if repeated.isEmpty():
        out = keyed.join(taken.where("_copies > 0"), keys)
    else:
        once = keyed.join(taken.where("_copies > 0").join(repeated, keys, "left_anti"), keys)
        among = Window.partitionBy(*keys)
        rows = keyed.join(repeated, keys).withColumn("_rank", F.row_number().over(among.orderBy(F.xxhash64(own["text"]))))
        ranks = taken.join(repeated, keys).withColumn("_rank", F.row_number().over(among.orderBy(F.desc("_copies"))))
        out = once.unionByName(rows.join(ranks.where("_copies > 0"), [*keys, "_rank"]).drop("_rank"))
    copies = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return copies.select(*[F.col(v).alias(k) for k, v in own.items()])


def mixing_report(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
