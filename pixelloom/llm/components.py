"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.session import cut, discard


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest node in reach.

    Large-star moves the larger neighbours, small-star the smaller ones and the node itself. A node's neighbours are never
    gathered: their minimum is an aggregate that combines before the shuffle, and a join hands it back to them. The minima
    are written first, so that the join shuffles both sides itself and may split the partition of a hub. The result is written,
    and the minima go.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")), "least")
        out = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = cut(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = down.join(least, "a").select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    found = cut(out.where("a <> b").distinct(), "edges")
    discard(least, edges)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node that it reaches.

    Rounds go on until an edge table no longer changes; it then is a star around each root. Every step is written to the
    shared folder, so a lost executor costs one step, and deleted after the next one. The result is such a table as well.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        edges = _stars(_stars(edges, large=True), large=False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
    roots = cut(roots, "roots")
    discard(edges)
    return roots
