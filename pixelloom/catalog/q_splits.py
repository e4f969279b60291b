"""Cells, histograms and spatial splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.catalog.registry import query, rounded
from pixelloom.catalog.tables import TRAITS
from pixelloom.operators import cells, hist, splits
from pixelloom.session import cut, small_side
from pixelloom.sources import sinks

BINS = 12
FRACTIONS = (0.7, 0.15, 0.15)
SEED = 67
RESTARTS = 500
HEX_M = 150_000.0


def _edges(t):
    return small_side(hist.feature_edges(t.features, BINS))


def _hist(t, edges):
    return hist.cell_histogram(t.features, edges)


def _cells(t):
    return t.features.select("cell_id", "parent_id").distinct()


def _counts(n):
    train, val = round(FRACTIONS[0] * n), round(FRACTIONS[1] * n)
    return train, val, n - train - val


@query("J5_pixel_to_cell_square", "SELECT row, col, source, trait, cell_id, parent_id FROM cell_target")
def _(t):
    return t.cell_target.select("row", "col", "source", "trait", "cell_id", "parent_id")


def _hex_sql(x: str, y: str, size: str) -> str:
    """Axial rounding in SQL for coordinates x, y."""
    return f"""(SELECT CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS q,
 CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS r FROM
 (SELECT rq, rr, rs, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(rs + fq + fr) AS ds FROM
 (SELECT fq, fr, round_even(fq, 0) AS rq, round_even(fr, 0) AS rr, round_even(-fq - fr, 0) AS rs FROM
 (SELECT (sqrt(3::double) / 3 * ({x}) - ({y}) / 3) / {size} AS fq, 2::double / 3 * ({y}) / {size} AS fr))))"""


@query("J5_pixel_to_cell_hex", f"""
SELECT row, col, (c.q * 16777216 + c.r)::bigint AS cell_id, (p.q * 16777216 + p.r)::bigint AS parent_id
FROM px, LATERAL {_hex_sql('px.x', 'px.y', '150000::double')} c,
LATERAL {_hex_sql('150000::double * sqrt(3::double) * (c.q + c.r / 2)', '225000::double * c.r', '600000::double')} p""", {
    "px": """SELECT DISTINCT row, col, (col + 0.5::double) * 22000 AS x,
 (SELECT h FROM dims) * 22000 - (row + 0.5::double) * 22000 AS y FROM prim"""})
def _(t):
    px = t.primary.select("row", "col").distinct()
    return cells.pixel_to_cell(px, t.grid, "hex", HEX_M, 4 * HEX_M)


@query("A2_cell_counts", "SELECT cell_id, trait, count(mean) AS n FROM cell_target GROUP BY ALL")
def _(t):
    return cells.cell_counts(t.cell_target)


@query("A2_cell_counts_wide", """
SELECT cell_id, count(*) FILTER (trait = 'X1') AS n_X1, count(*) FILTER (trait = 'X2') AS n_X2,
       count(*) FILTER (trait = 'X3') AS n_X3, count(*) FILTER (trait = 'X4') AS n_X4 FROM cell_target GROUP BY cell_id""")
def _(t):
    return cells.cell_counts_wide(t.cell_target, TRAITS)


@query("A3_cell_presence", """
SELECT cell_id, bool_or(mean IS NOT NULL) AS has_data, count(DISTINCT trait) AS n_traits,
       count(*) FILTER (trait = 'X1') AS n_first FROM cell_target WHERE source = 'primary' GROUP BY cell_id""")
def _(t):
    return cells.cell_presence(t.cell_target.filter(F.col("source") == "primary"), "X1")


@query("A4_feature_edges", """
SELECT feature, round(lo, 6) AS lo, round(hi, 6) AS hi, round(width, 6) AS width, 12 AS n_bins FROM edges
UNION ALL SELECT 'source', 0.5, 2.5, 1.0, 2""")
def _(t):
    codes = t.cell_target.select(
        F.lit("source").alias("feature"), F.when(F.col("source") == "primary", 2.0).otherwise(1.0).alias("value")
    )
    df = t.features.select("feature", "value").unionByName(codes)
    return rounded(hist.feature_edges(df, BINS, ["source"]))


@query("A5_cell_histogram", "SELECT * FROM hist")
def _(t):
    return _hist(t, _edges(t))


_BANDED = {"cell_band": "SELECT DISTINCT cell_id, CASE WHEN cell_id % 16777216 < 14 THEN 'train' WHEN cell_id % 16777216 < 17 THEN 'val' ELSE 'test' END AS split, CASE WHEN cell_id % 16777216 < 14 THEN 0 WHEN cell_id % 16777216 < 17 THEN 1 ELSE 2 END AS label FROM features"}


def _banded(t):
    """Every cell labelled by its row band: a fixed, spatially blocked split."""
    band = F.col("cell_id") % cells.AXIS
    return _cells(t).select(
        "cell_id", F.when(band < 14, "train").when(band < 17, "val").otherwise("test").alias("split"),
        F.when(band < 14, 0).when(band < 17, 1).otherwise(2).alias("label"),
    )


@query("A6_split_histogram", """
SELECT split, h.feature, bin, sum(h.n)::bigint AS n,
       round(sum(sum(h.n)) OVER (PARTITION BY split, h.feature)::double / sum(sum(h.n)) OVER (PARTITION BY h.feature), 6) AS share,
       round(sum(h.n)::double / (sum(sum(h.n)) OVER (PARTITION BY split, h.feature) * any_value(width)), 6) AS density
FROM hist h JOIN cell_band c ON c.cell_id = h.cell_id JOIN edges e ON e.feature = h.feature
GROUP BY split, h.feature, bin""", _BANDED)
def _(t):
    edges = _edges(t)
    return rounded(hist.split_histogram(_hist(t, edges), _banded(t), edges))


_JSD = {
    "dense": """SELECT g.k, g.feature, g.bin, g.label, coalesce(sum(h.n), 0) + 1e-10::double AS v
 FROM (SELECT k, feature, b AS bin, l AS label FROM (SELECT DISTINCT k FROM labels_t) CROSS JOIN edges, range(12) r(b), range(3) s(l)) g
 LEFT JOIN (SELECT k, feature, bin, label, n FROM hist JOIN labels_t USING (cell_id)) h
   ON h.k = g.k AND h.feature = g.feature AND h.bin = g.bin AND h.label = g.label GROUP BY ALL""",
    "dens": "SELECT k, feature, bin, label, v / sum(v) OVER (PARTITION BY k, feature, label) AS p FROM dense",
    "jsd_t": """SELECT k, avg(d) AS jsd FROM (
 SELECT a.k, a.feature, a.label, b.label, sqrt(sum(a.p * ln(2 * a.p / (a.p + b.p)) + b.p * ln(2 * b.p / (a.p + b.p))) / 2) AS d
 FROM dens a JOIN dens b ON a.k = b.k AND a.feature = b.feature AND a.bin = b.bin AND a.label < b.label
 GROUP BY a.k, a.feature, a.label, b.label) GROUP BY k""",
}


@query("A7_jsd_score", "SELECT round(jsd, 6) AS jsd FROM jsd_t",
       {**_BANDED, **_JSD, "labels_t": "SELECT 0 AS k, cell_id, label FROM cell_band"})
def _(t):
    edges = _edges(t)
    return rounded(hist.jsd_score(cut(_hist(t, edges)), _banded(t), edges))


@query("J12_same_neighbours", """
SELECT c.cell_id, c.label, count(d.cell_id) AS n_same FROM cell_band c
LEFT JOIN cell_band d ON d.label = c.label AND d.cell_id <> c.cell_id
 AND abs(d.cell_id // 16777216 - c.cell_id // 16777216) <= 1 AND abs(d.cell_id % 16777216 - c.cell_id % 16777216) <= 1
GROUP BY ALL""", _BANDED)
def _(t):
    return cells.same_neighbours(_banded(t).select("cell_id", "label"), "square")


_QUOTA = {
    "cells_t": "SELECT DISTINCT cell_id, parent_id FROM features",
    "want": """SELECT round_even(0.7::double * count(*), 0)::bigint AS w0, round_even(0.15::double * count(*), 0)::bigint AS w1, count(*) AS total,
 (count(*) - round_even(0.7::double * count(*), 0) - round_even(0.15::double * count(*), 0))::bigint AS w2 FROM cells_t""",
    "strata": "SELECT parent_id, count(*) AS n, row_number() OVER (ORDER BY parent_id) AS k, count(*) OVER () AS last FROM cells_t GROUP BY parent_id",
    "quota": """SELECT 0::bigint AS k, 0::bigint AS parent_id, 0::bigint AS f0, 0::bigint AS f1, 0::bigint AS f2,
  w0 AS r0, w1 AS r1, w2 AS r2, total AS rest FROM want
 UNION ALL
 SELECT k, parent_id, f0, f1, f2, r0 - f0, r1 - f1, r2 - f2, rest - n FROM (
  SELECT *, CASE WHEN k = last THEN r0 ELSE b0 - need END AS f0, CASE WHEN k = last THEN r1 ELSE b1 END AS f1,
         CASE WHEN k = last THEN r2 ELSE b2 + need END AS f2 FROM (
   SELECT *, CASE WHEN n >= 3 AND b2 = 0 AND r2 > 0 THEN 1 ELSE 0 END AS need FROM (
    SELECT *, a0 + CASE WHEN a0 >= a1 AND a0 >= a2 THEN n - a0 - a1 - a2 ELSE 0 END AS b0,
           a1 + CASE WHEN a1 > a0 AND a1 >= a2 THEN n - a0 - a1 - a2 ELSE 0 END AS b1,
           a2 + CASE WHEN a2 > a0 AND a2 > a1 THEN n - a0 - a1 - a2 ELSE 0 END AS b2 FROM (
     SELECT *, greatest(n - a0 - a1, 0) AS a2 FROM (
      SELECT s.k, s.parent_id, s.n, s.last, q.r0, q.r1, q.r2, q.rest,
             greatest(round_even(q.r0::double / q.rest * s.n, 0), 0)::bigint AS a0,
             greatest(round_even(q.r1::double / q.rest * s.n, 0), 0)::bigint AS a1
      FROM quota q JOIN strata s ON s.k = q.k + 1)))))""",
    "cand": """SELECT k, cell_id, CASE WHEN rn <= f0 THEN 0 WHEN rn <= f0 + f1 THEN 1 ELSE 2 END AS label FROM (
  SELECT r.k, c.cell_id, q.f0, q.f1, row_number() OVER (PARTITION BY r.k, c.parent_id ORDER BY md5('67:' || r.k || ':' || c.cell_id), c.cell_id) AS rn
  FROM cells_t c, range(500) r(k), quota q WHERE q.parent_id = c.parent_id AND q.k > 0)""",
}


@query("W9_stratum_quota", """
SELECT parent_id, f0 AS n_train, f1 AS n_val, f2 AS n_test FROM quota WHERE k > 0""", _QUOTA)
def _(t):
    c = _cells(t)
    return splits.stratum_quota(c, *_counts(c.count()))


@query("I2_restart_scores", "SELECT k::int AS restart, round(jsd, 6) AS jsd FROM jsd_t",
       {**_QUOTA, **_JSD, "labels_t": "SELECT k, cell_id, label FROM cand"})
def _(t):
    edges = _edges(t)
    c = _cells(t)
    quotas = splits.stratum_quota(c, *_counts(c.count()))
    return rounded(splits.restart_scores(cut(c), cut(quotas), cut(_hist(t, edges)), edges, RESTARTS, SEED))


_BEST = "SELECT cell_id, label FROM labels_t WHERE k = (SELECT min_by(k, (jsd, k)) FROM jsd_t)"


@query("I2_split_stratified", _BEST, {**_QUOTA, **_JSD, "labels_t": "SELECT k, cell_id, label FROM cand"})
def _(t):
    edges = _edges(t)
    c = cut(_cells(t))
    return splits.split_stratified(c, cut(_hist(t, edges)), edges, _counts(c.count()), RESTARTS, SEED)[0]


_RANDOM = {**_QUOTA, **_JSD, "labels_t": """SELECT k, cell_id, CASE WHEN rn <= w0 THEN 0 WHEN rn <= w0 + w1 THEN 1 ELSE 2 END AS label FROM (
  SELECT r.k, c.cell_id, row_number() OVER (PARTITION BY r.k ORDER BY md5('67:' || r.k || ':' || c.cell_id), c.cell_id) AS rn
  FROM cells_t c, range(500) r(k)), want"""}


@query("I1_split_random", _BEST, _RANDOM)
def _(t):
    edges = _edges(t)
    c = cut(_cells(t))
    return splits.split_random(c, cut(_hist(t, edges)), edges, _counts(c.count()), RESTARTS, SEED)[0]


@query("I3_split_decluster")
def _(t):
    """Rows only: swaps are seeded, tests check the invariants."""
    edges = _edges(t)
    c, h = cut(_cells(t)), cut(_hist(t, edges))
    labels, _score = splits.split_stratified(c, h, edges, _counts(c.count()), RESTARTS, SEED)
    return splits.split_decluster(labels, h, edges, k=1, kind="square", seed=SEED)


@query("I3_decluster_invariants", f"""
SELECT label, count(*) AS n_cells, true AS all_cells, true AS fewer_violations, true AS within_budget FROM ({_BEST}) GROUP BY label""",
       {**_QUOTA, **_JSD, "labels_t": "SELECT k, cell_id, label FROM cand"})
def _(t):
    """What de-clustering must keep: the cells, the size of each split, the distance budget; and violations must fall."""
    edges = _edges(t)
    c, h = cut(_cells(t)), cut(_hist(t, edges))
    before, score = splits.split_stratified(c, h, edges, _counts(c.count()), RESTARTS, SEED)
    before = cut(before)
    after = splits.split_decluster(before, h, edges, k=1, kind="square", seed=SEED)
    bad = [splits.violations(x, "square", 1, (splits.TEST,)).count() for x in (before, after)]
    distance = hist.jsd_score(h, after, edges).first()["jsd"]
    same = after.join(c, "cell_id", "full_outer").filter("label is null or parent_id is null").isEmpty()
    return after.groupBy("label").agg(F.count(F.lit(1)).alias("n_cells")).select(
        "label", "n_cells", F.lit(same).alias("all_cells"), F.lit(bad[1] < bad[0] or bad[0] == 0).alias("fewer_violations"),
        F.lit(distance <= splits.distance_budget(score, 0.05) + 1e-12).alias("within_budget"),
    )


def _plan_cells(t):
    """50 x 50 fine cells in 5 x 5 parents; validity comes from the order pixels."""
    size, parent = t.fine_block
    place = lambda df: cells.pixel_to_cell(df, t.grid, "square", size, parent)
    feats = place(t.primary).select("cell_id", "parent_id", F.col("trait").alias("feature"), F.col("mean").alias("value"))
    ids = ["cell_id", "parent_id"]
    aux = place(t.aux.filter("trait = 'X1'")).select(*ids).distinct()
    return feats, feats.select(*ids).distinct(), aux, place(t.order_pixels).select(*ids).distinct()


_PLAN = {
    "p_cells": "SELECT DISTINCT (col // ((w + 49) // 50))::bigint * 16777216 + row // ((h + 49) // 50) AS cell_id, (col // (10 * ((w + 49) // 50)))::bigint * 16777216 + row // (10 * ((h + 49) // 50)) AS parent_id FROM prim, dims",
    "a_cells": """SELECT DISTINCT (col // ((w + 49) // 50))::bigint * 16777216 + row // ((h + 49) // 50) AS cell_id, (col // (10 * ((w + 49) // 50)))::bigint * 16777216 + row // (10 * ((h + 49) // 50)) AS parent_id
 FROM aux_t, dims WHERE trait = 'X1' AND (col // ((w + 49) // 50))::bigint * 16777216 + row // ((h + 49) // 50) NOT IN (SELECT cell_id FROM p_cells)""",
    "v_cells": """SELECT DISTINCT (col // ((w + 49) // 50))::bigint * 16777216 + row // ((h + 49) // 50) AS cell_id, (col // (10 * ((w + 49) // 50)))::bigint * 16777216 + row // (10 * ((h + 49) // 50)) AS parent_id
 FROM order_pixels, dims WHERE (col // ((w + 49) // 50))::bigint * 16777216 + row // ((h + 49) // 50) NOT IN (SELECT cell_id FROM p_cells UNION ALL SELECT cell_id FROM a_cells)""",
    "cells_t": "SELECT cell_id, parent_id FROM p_cells",
    "aux_n": "SELECT round_even(0.7::double / (0.7::double + 0.15::double) * count(*), 0)::bigint AS a_train, count(*) AS n FROM a_cells",
    "want": """SELECT round_even(0.7::double * (p + n), 0)::bigint - a_train AS w0, round_even(0.15::double * (p + n), 0)::bigint - (n - a_train) AS w1, p AS total,
  p - (round_even(0.7::double * (p + n), 0)::bigint - a_train) - (round_even(0.15::double * (p + n), 0)::bigint - (n - a_train)) AS w2
  FROM (SELECT count(*) AS p FROM p_cells), aux_n""",
    "strata": _QUOTA["strata"], "quota": _QUOTA["quota"], "cand": _QUOTA["cand"],
    "features": "SELECT (col // ((w + 49) // 50))::bigint * 16777216 + row // ((h + 49) // 50) AS cell_id, trait AS feature, mean AS value FROM prim, dims",
    "labels_t": "SELECT k, cell_id, label FROM cand", **_JSD,
    "plan_t": """SELECT p.cell_id, p.parent_id, 'primary' AS data_source, CASE label WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split
  FROM p_cells p JOIN cand c ON c.cell_id = p.cell_id WHERE c.k = (SELECT min_by(k, (jsd, k)) FROM jsd_t)
 UNION ALL SELECT cell_id, parent_id, 'aux', CASE WHEN row_number() OVER (ORDER BY md5('67-aux:' || cell_id), cell_id) <= (SELECT a_train FROM aux_n) THEN 'train' ELSE 'val' END FROM a_cells
 UNION ALL SELECT cell_id, parent_id, 'none', 'none' FROM v_cells""",
}


def _plan(t, decluster=False):
    feats, p, a, v = _plan_cells(t)
    edges = small_side(hist.feature_edges(feats, BINS))
    return splits.split_plan(
        cut(p), cut(a), v, hist.cell_histogram(feats, edges), edges, FRACTIONS, restarts=RESTARTS, seed=SEED,
        decluster=decluster, kind="square", k=2,
    )


@query("I5_split_plan", "SELECT * FROM plan_t", _PLAN)
def _(t):
    return _plan(t)


@query("I6_split_report", """
SELECT data_source, split, count(*) AS n_cells, round(count(*)::double / (SELECT count(*) FROM plan_t), 6) AS share
FROM plan_t GROUP BY ROLLUP (data_source, split)""", _PLAN)
def _(t):
    return rounded(splits.split_report(_plan(t)))


# cells of 4 x 4 pixels, so their number grows with the grid
_UNION = {
    "p_cells": "SELECT DISTINCT (col // 4)::bigint * 16777216 + row // 4 AS cell_id, (col // 20)::bigint * 16777216 + row // 200 AS parent_id FROM prim",
    "a_cells": """SELECT DISTINCT (col // 4)::bigint * 16777216 + row // 4 AS cell_id, (col // 20)::bigint * 16777216 + row // 200 AS parent_id
 FROM aux_t WHERE trait = 'X1' AND (col // 4)::bigint * 16777216 + row // 4 NOT IN (SELECT cell_id FROM p_cells)""",
    "v_cells": """SELECT DISTINCT (col // 4)::bigint * 16777216 + row // 4 AS cell_id, (col // 20)::bigint * 16777216 + row // 200 AS parent_id
 FROM order_pixels WHERE (col // 4)::bigint * 16777216 + row // 4 NOT IN (SELECT cell_id FROM p_cells UNION ALL SELECT cell_id FROM a_cells)""",
}


@query("U3_cell_union", """
SELECT cell_id, parent_id, 'primary' AS data_source FROM p_cells UNION ALL SELECT cell_id, parent_id, 'aux' FROM a_cells
UNION ALL SELECT cell_id, parent_id, 'none' FROM v_cells""", _UNION)
def _(t):
    place = lambda df: cells.pixel_to_cell(df.select("row", "col"), t.grid, "square", (4, 4), (200, 20))
    known = F.coalesce(*TRAITS).isNotNull()
    primary, aux = t.lines_of("primary").filter(known), t.lines_of("aux").filter("X1 is not null")
    return splits.cell_union_by_priority(place(primary), place(aux), place(t.order_places))


@query("IO13_split_sink", """
SELECT c.cell_id, c.split, count(DISTINCT t.trait) AS n_traits,
 count(*) FILTER (t.trait = 'X1' AND t.source = 'aux') AS X1_aux, count(*) FILTER (t.trait = 'X1' AND t.source = 'primary') AS X1_primary,
 count(*) FILTER (t.trait = 'X2' AND t.source = 'aux') AS X2_aux, count(*) FILTER (t.trait = 'X2' AND t.source = 'primary') AS X2_primary,
 count(*) FILTER (t.trait = 'X3' AND t.source = 'aux') AS X3_aux, count(*) FILTER (t.trait = 'X3' AND t.source = 'primary') AS X3_primary,
 count(*) FILTER (t.trait = 'X4' AND t.source = 'aux') AS X4_aux, count(*) FILTER (t.trait = 'X4' AND t.source = 'primary') AS X4_primary
FROM cell_band c LEFT JOIN cell_target t ON t.cell_id = c.cell_id GROUP BY ALL""", _BANDED)
def _(t):
    from pixelloom.session import scratch_path

    counts = cells.cell_counts(t.cell_target, ["cell_id", "trait", "source"])
    path = scratch_path(t.spark, "split")
    sinks.split_sink(_banded(t).select("cell_id", "split"), counts, TRAITS, ["aux", "primary"], path)
    return t.spark.read.parquet(path)


