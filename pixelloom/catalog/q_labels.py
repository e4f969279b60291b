"""Label construction: bands, merges, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.catalog.registry import query, rounded
from pixelloom.catalog.tables import TRAITS
from pixelloom.operators import merge, quality, sampling


@query("A1_band_stats", """
SELECT row, col, source, trait, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std,
       round(quantile_cont(v, 0.5), 8) AS median, round(quantile_cont(v, 0.05), 8) AS q05,
       round(quantile_cont(v, 0.95), 8) AS q95, count(v) AS count
FROM obs GROUP BY ALL""")
def _(t):
    return rounded(merge.band_stats(t.obs_wide, TRAITS), 8)


@query("A1_band_stats_long", """
SELECT row, col, source, trait, count, round(median, 8) AS median FROM (
  SELECT row, col, source, trait, count(v) AS count, quantile_cont(v, 0.5) AS median FROM obs GROUP BY ALL)""")
def _(t):
    return rounded(merge.band_stats(t.obs, bands=["count", "median"]), 8)


@query("J1_merge_priority", """
SELECT row, col, trait, round(mean, 8) AS mean, round(std, 8) AS std, count, source_code::int AS source_code
FROM merged""")
def _(t):
    return rounded(t.merged.withColumn("source_code", F.col("source_code").cast("int")), 8)


@query("J2_merge_priority_per_band", """
SELECT row, col, trait, round(mean, 8) AS mean, round(std, 8) AS std, count,
       coalesce(source_code, 0)::int AS source_code FROM merged""")
def _(t):
    df = t.merged_bands.drop("in_aux", "in_primary")
    return rounded(df.withColumn("source_code", F.col("source_code").cast("int")), 8)


_SUMMARY = {"summary": """
SELECT trait, bool_or(in_aux) AS has_aux, bool_or(in_primary) AS has_primary,
       count(*) FILTER (source_code = 1) AS n_aux_only, count(*) FILTER (source_code = 2) AS n_primary,
       count(*) FILTER (in_aux AND in_primary) AS n_both, count(source_code) AS n_total,
       ((SELECT h * w FROM dims) - count(source_code))::bigint AS n_no_data,
       round(100.0::double * count(*) FILTER (source_code = 2) / count(source_code), 1) AS pct_primary,
       round(100.0::double * count(*) FILTER (source_code = 1) / count(source_code), 1) AS pct_aux_only
FROM merged GROUP BY trait"""}


@query("A12_merge_summary", "SELECT * FROM summary", _SUMMARY)
def _(t):
    return merge.merge_summary(t.merged_bands, t.grid)


@query("A13_merge_summary_total", """
SELECT count(*) AS n_traits, count(*) FILTER (has_aux) AS n_traits_aux,
       count(*) FILTER (has_primary) AS n_traits_primary, round(avg(n_primary), 6) AS mean_primary,
       round(avg(n_aux_only), 6) AS mean_aux_only, round(avg(n_both), 6) AS mean_both,
       round(avg(pct_primary), 6) AS mean_pct_primary FROM summary""", _SUMMARY)
def _(t):
    return rounded(merge.merge_summary_total(merge.merge_summary(t.merged_bands, t.grid)))


@query("A14_best_source_map", """
SELECT row, col, max(source_code)::int AS best_source FROM merged GROUP BY ALL""")
def _(t):
    return merge.best_source_map(t.merged_bands)


@query("A14_best_source_counts", """
SELECT count(*) FILTER (b = 2) AS n_primary, count(*) FILTER (b = 1) AS n_aux,
       ((SELECT h * w FROM dims) - count(b))::bigint AS n_no_data FROM best""",
       {"best": "SELECT row, col, max(source_code) AS b FROM merged GROUP BY ALL"})
def _(t):
    return merge.best_source_counts(t.merged_bands, t.grid)


_LOOKUP = {"lookup": """SELECT f.trait, f.x, f.y, f.fold, f.row, f.col, m.source_code
FROM folds f JOIN merged m ON m.row = f.row AND m.col = f.col AND m.trait = f.trait"""}
_FOLDS = {**_LOOKUP, "counts": """
SELECT trait, fold, count(*) AS n FROM lookup WHERE source_code = 2 GROUP BY ALL"""}


@query("J15_fold_source_lookup", """
SELECT trait, fold, row, col, source_code::int AS source_code FROM lookup""", _LOOKUP)
def _(t):
    got = merge.fold_codes(t.folds, merge.pixel_codes(t.obs_wide, TRAITS), TRAITS, t.grid)
    return got.select("trait", "fold", "row", "col", F.col("source_code").cast("int").alias("source_code"))


@query("A15_fold_counts", """
SELECT trait, sum(CASE WHEN fold = 0 THEN n ELSE 0 END)::bigint AS fold_0,
       sum(CASE WHEN fold = 1 THEN n ELSE 0 END)::bigint AS fold_1,
       sum(CASE WHEN fold = 2 THEN n ELSE 0 END)::bigint AS fold_2,
       sum(CASE WHEN fold = 3 THEN n ELSE 0 END)::bigint AS fold_3,
       sum(CASE WHEN fold = 4 THEN n ELSE 0 END)::bigint AS fold_4 FROM counts GROUP BY trait""", _FOLDS)
def _(t):
    return merge.fold_counts(merge.fold_codes(t.folds, merge.pixel_codes(t.obs_wide, TRAITS), TRAITS, t.grid))


@query("A16_fold_consistency", """
SELECT fold, min(n)::bigint AS n_min, max(n)::bigint AS n_max, round(stddev_samp(n), 6) AS n_std,
       stddev_samp(n) < 100 AS consistent
FROM (SELECT t.trait, f.fold, coalesce(c.n, 0) AS n
      FROM (SELECT DISTINCT trait FROM counts) t CROSS JOIN (VALUES (0), (1), (2), (3), (4)) f(fold)
      LEFT JOIN counts c ON c.trait = t.trait AND c.fold = f.fold)
GROUP BY fold""", _FOLDS)
def _(t):
    counts = merge.fold_counts(merge.fold_codes(t.folds, merge.pixel_codes(t.obs_wide, TRAITS), TRAITS, t.grid))
    return rounded(merge.fold_consistency(counts))


@query("J14_source_pairs", "SELECT row, col, trait, round(y, 8) AS y, round(p, 8) AS p FROM pairs")
def _(t):
    return rounded(merge.source_pairs(t.two_sides), 8)


@query("T1_top_overlap", """
SELECT p.trait, n_overlap, count(*) AS n_used, round(corr(y, p), 6) AS pearson_r
FROM pairs p JOIN top ON top.trait = p.trait WHERE n_overlap >= 10 GROUP BY p.trait, n_overlap""", {
    "top": "SELECT trait, count(*) AS n_overlap FROM pairs GROUP BY trait ORDER BY n_overlap DESC, trait LIMIT 9"})
def _(t):
    return rounded(sampling.top_overlap(t.pairs, n=9))


@query("U1_trait_union", "SELECT trait FROM aux_t UNION SELECT trait FROM params")
def _(t):
    return merge.trait_union(t.traits_of(t.lines_of("aux")), t.params)


@query("U1_trait_intersect", "SELECT trait FROM aux_t INTERSECT SELECT trait FROM params")
def _(t):
    return merge.trait_intersect(t.traits_of(t.lines_of("aux")), t.params)


@query("U2_trait_except", "SELECT trait FROM params EXCEPT SELECT trait FROM target")
def _(t):
    return merge.trait_except(t.params, t.traits_of(t.obs_wide))


@query("Q1_merge_sanity", """
SELECT trait, bool_and(coalesce(source_code, 0) IN (0, 1, 2)) AS codes_ok,
       bool_and((mean IS NULL AND std IS NULL) = (coalesce(source_code, 0) = 0)) AS empty_ok,
       bool_and(mean > -1000 AND mean < 1000 AND std > -1000 AND std < 1000) AS range_ok,
       CASE WHEN bool_and(mean > -1000 AND mean < 1000 AND std > -1000 AND std < 1000) THEN 'PASS' ELSE 'FAIL' END AS status
FROM merged GROUP BY trait""")
def _(t):
    return quality.merge_sanity(t.merged_bands)


@query("Q5_table_contract", """
SELECT 'missing_column' AS check, c AS subject, 0::bigint AS n_bad FROM (VALUES ('l_orderkey'), ('l_tax')) v(c)
UNION ALL SELECT 'wrong_type', c, 0 FROM (VALUES ('l_orderkey'), ('l_tax')) v(c)
UNION ALL SELECT 'duplicate_key', 'l_orderkey,l_linenumber',
  (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'unknown_value', 'l_returnflag',
  (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('R', 'N'))""")
def _(t):
    return quality.table_contract(
        t.read("lineitem"), {"l_orderkey": "bigint", "l_tax": "double"},
        unique=["l_orderkey", "l_linenumber"], known={"l_returnflag": ["R", "N"]},
    )
