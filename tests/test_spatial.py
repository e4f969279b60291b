"""Cells, splits, chips, gap filling, components, zones, resampling against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom import GridSpec
from pixelloom.operators import cells, chips, components, gapfill, hist, masks, quality, resample, sampling, splits, transforms, zones
from pixelloom.session import cut

GRID = GridSpec("EPSG:6933", 10_000.0, 0.0, -10_000.0, 300_000.0, 30, 24)


def pixels(spark, seed, density, grid=GRID):
    rng = random.Random(seed)
    rows = [(r, c, rng.random()) for r in range(grid.height) for c in range(grid.width) if rng.random() < density]
    return rows, spark.createDataFrame(rows, "row int, col int, value double")


def test_hexagons_are_nearest_centres(spark):
    _rows, df = pixels(spark, 1, 1.0)
    size = 35_000.0
    got = cells.pixel_to_cell(df, GRID, "hex", size, 3 * size).collect()
    axial = lambda i: ((i + cells.AXIS // 2) // cells.AXIS, (i + cells.AXIS // 2) % cells.AXIS - cells.AXIS // 2)
    for r in got:
        x, y = 10_000 * (r.col + 0.5), 300_000 - 10_000 * (r.row + 0.5)
        q, s = axial(r.cell_id)
        def dist(q, s):
            return math.hypot(size * math.sqrt(3) * (q + s / 2) - x, size * 1.5 * s - y)
        best = min(dist(q + a, s + b) for a in (-1, 0, 1) for b in (-1, 0, 1))
        assert dist(q, s) <= best + 1e-6
    parents = {}
    for r in got:
        parents.setdefault(r.cell_id, set()).add(r.parent_id)
    assert all(len(p) == 1 for p in parents.values())


def brute_jsd(counts, labels, n_bins):
    out = []
    for f in sorted({k[1] for k in counts}):
        h = np.full((3, n_bins), 1e-10)
        for (cell, feat, b), n in counts.items():
            if feat == f:
                h[labels[cell], b] += n
        h /= h.sum(axis=1, keepdims=True)
        for i, j in ((0, 1), (0, 2), (1, 2)):
            m = (h[i] + h[j]) / 2
            out.append(math.sqrt(((h[i] * np.log(h[i] / m)).sum() + (h[j] * np.log(h[j] / m)).sum()) / 2))
    return float(np.mean(out))


def split_inputs(spark, n_side=9):
    rng = random.Random(5)
    rows = [
        (q * cells.AXIS + r, (q // 3) * cells.AXIS + r // 3, f, rng.gauss(q + r, 2.0))
        for q in range(n_side) for r in range(n_side) for f in ("a", "b") for _ in range(4)
    ]
    df = cut(spark.createDataFrame(rows, "cell_id bigint, parent_id bigint, feature string, value double"))
    edges = hist.feature_edges(df, 6)
    return df, cut(df.select("cell_id", "parent_id").distinct()), edges, cut(hist.cell_histogram(df, edges))


def test_jsd_equals_brute_force_with_empty_bins(spark):
    df, c, edges, h = split_inputs(spark)
    labels = {r.cell_id: i % 3 for i, r in enumerate(c.orderBy("cell_id").collect())}
    frame = spark.createDataFrame(list(labels.items()), "cell_id bigint, label int")
    counts = {(r.cell_id, r.feature, r.bin): r.n for r in h.collect()}
    assert sum(counts.values()) == df.count()
    assert hist.jsd_score(h, frame, edges).first().jsd == pytest.approx(brute_jsd(counts, labels, 6), abs=1e-9)
    skewed = {k: (2 if v == 2 and k % 5 == 0 else 0 if v == 2 else v) for k, v in labels.items()}
    frame = spark.createDataFrame(list(skewed.items()), "cell_id bigint, label int")
    assert hist.jsd_score(h, frame, edges).first().jsd == pytest.approx(brute_jsd(counts, skewed, 6), abs=1e-9)


def test_edges_skip_constant_and_fix_categorical(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 1.0), ("c", 1.0), ("c", 2.0), ("v", 0.0), ("v", 6.0)], "feature string, value double")
    got = {r.feature: (r.lo, r.hi, r.n_bins) for r in hist.feature_edges(df, 3, ["c"]).collect()}
    assert got == {"c": (0.5, 2.5, 2), "v": (0.0, 6.0, 3)}
    edges = hist.feature_edges(df, 3, ["c"])
    h = {(r.feature, r.bin): r.n for r in hist.cell_histogram(df.withColumn("cell_id", F.lit(1)), edges).collect()}
    assert h == {("c", 0): 1, ("c", 1): 1, ("v", 0): 1, ("v", 2): 1}


def plain_quotas(sizes, wanted):
    left, out = list(wanted), []
    for i, n in enumerate(sizes):
        take = [max(round(w / sum(sizes[i:]) * n), 0) for w in left[:2]]
        take = [*take, max(n - sum(take), 0)]
        take[take.index(max(take))] += n - sum(take)
        if n >= 3 and not take[2] and left[2] > 0:
            take = [take[0] - 1, take[1], 1]
        if i == len(sizes) - 1:
            take = left
        left = [a - b for a, b in zip(left, take)]
        out.append(tuple(take))
    return out


@pytest.mark.parametrize("strata", [1, 7, 3000])
def test_quotas_keep_totals(spark, strata):
    rng = random.Random(strata)
    sizes = [rng.randint(1, 40) for _ in range(strata)]
    rows = [(k * 1000 + j, -5 * k) for k, n in enumerate(reversed(sizes)) for j in range(n)]
    n = sum(sizes)
    train, val = round(0.7 * n), round(0.15 * n)
    cells_ = spark.createDataFrame(rows, "cell_id bigint, parent_id bigint").repartition(6)
    got = {r.parent_id: tuple(r)[1:] for r in splits.stratum_quota(cells_, train, val, n - train - val).collect()}
    assert [got[k] for k in sorted(got)] == plain_quotas(sizes, (train, val, n - train - val))
    assert [sum(got[k]) for k in sorted(got)] == sizes and tuple(map(sum, zip(*got.values()))) == (train, val, n - train - val)
    with pytest.raises(ValueError):
        splits.stratum_quota(cells_, train, val, n)


def test_stratified_split_counts_and_best_restart(spark):
    _df, c, edges, h = split_inputs(spark)
    labels, score = splits.split_stratified(c, h, edges, (57, 12, 12), 6, 3)
    got = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    assert got == {0: 57, 1: 12, 2: 12}
    quotas = splits.stratum_quota(c, 57, 12, 12)
    every = {r.restart: r.jsd for r in splits.restart_scores(c, quotas, h, edges, 6, 3, batch=4).collect()}
    assert sorted(every) == list(range(6)) and score == pytest.approx(min(every.values()))
    for k in every:
        one = splits.candidate_labels(c, quotas, [k], 3)
        assert hist.jsd_score(h, one, edges).first().jsd == pytest.approx(every[k], abs=1e-12)
    assert hist.jsd_score(h, labels, edges).first().jsd == pytest.approx(score)


def violations(labels, k, kind):
    steps = cells.neighbour_steps(kind)
    return [c for c, v in labels.items() if v == 2 and sum(labels.get(c + s) == 2 for s in steps) > k]


@pytest.mark.parametrize("kind", ["hex", "square"])
def test_decluster_invariants(spark, kind):
    _df, c, edges, h = split_inputs(spark)
    ids = sorted(r.cell_id for r in c.collect())
    before = {i: (2 if n < 8 else 1 if n % 9 == 0 else 0) for n, i in enumerate(ids)}
    frame = spark.createDataFrame(list(before.items()), "cell_id bigint, label int")
    after = {r.cell_id: r.label for r in splits.split_decluster(frame, h, edges, k=0, tol=0.5, kind=kind, seed=1, patience=3).collect()}
    assert sorted(after) == ids and sorted(after.values()) == sorted(before.values())
    assert len(violations(after, 0, kind)) < len(violations(before, 0, kind))
    start = hist.jsd_score(h, frame, edges).first().jsd
    end = hist.jsd_score(h, spark.createDataFrame(list(after.items()), "cell_id bigint, label int"), edges).first().jsd
    assert end <= start * 1.5 + 1e-12


def test_distances_after_every_prefix_of_swaps(spark):
    _df, c, edges, h = split_inputs(spark)
    ids = sorted(r.cell_id for r in c.collect())
    labels = {i: n % 3 for n, i in enumerate(ids)}
    rng = random.Random(9)
    rng.shuffle(ids)
    # the last swap is of cells that the histogram does not know
    pairs = [(a, b) for a, b in zip(ids[:40:2], ids[1:40:2]) if labels[a] != labels[b]] + [(-5, -6)]
    labels.update({-5: 0, -6: 2})
    swaps = spark.createDataFrame([(n + 1, a, b, labels[a], labels[b]) for n, (a, b) in enumerate(pairs)], "ord bigint, a bigint, b bigint, la int, lb int").repartition(3)
    frame = lambda m: spark.createDataFrame(list(m.items()), "cell_id bigint, label int")
    got = {r.ord: r.jsd for r in splits.prefix_distances(frame(labels), swaps, h, edges).collect()}
    assert sorted(got) == list(range(1, len(pairs) + 1))
    counts = {(r.cell_id, r.feature, r.bin): r.n for r in h.collect()}
    now = dict(labels)
    for n, (a, b) in enumerate(pairs, 1):
        now[a], now[b] = now[b], now[a]
        assert got[n] == pytest.approx(brute_jsd(counts, now, 6), abs=1e-9)


def test_split_plan_rules(spark):
    df, c, edges, h = split_inputs(spark)
    far = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("cell_id"), F.lit(0).cast("bigint").alias("parent_id"))
    aux = far(10**12, 10**12 + 20).unionByName(c)
    valid = far(10**12 + 10, 10**12 + 30).unionByName(c)
    plan = splits.split_plan(c, aux, valid, h, edges, (0.7, 0.15, 0.15), 2, 1, decluster=False)
    n = {(r.data_source, r.split): r["count"] for r in plan.groupBy("data_source", "split").count().collect()}
    total = c.count() + 20
    assert ("aux", "test") not in n and n[("none", "none")] == 10
    assert sum(v for (s, p), v in n.items() if p == "train") == round(0.7 * total)
    assert sum(v for (s, p), v in n.items() if p == "val") == round(0.15 * total)
    with pytest.raises(ValueError):
        splits.plan_counts(5, 1000, (0.7, 0.15, 0.15))
    with pytest.raises(ValueError):
        splits.fraction_check(0.5, 0.2, 0.2)


@pytest.mark.parametrize("patch,stride", [(5, 2), (4, 4), (3, 5), (30, 7)])
def test_windows_cover_like_brute_force(spark, patch, stride):
    rows, df = pixels(spark, 3, 0.3)
    nr, nc = chips.n_windows(GRID.height, patch, stride), chips.n_windows(GRID.width, patch, stride)
    want = {
        (r, c, i, j)
        for r, c, _v in rows for i in range(nr) for j in range(nc)
        if 0 <= r - i * stride < patch and 0 <= c - j * stride < patch
    }
    got = {(x.row, x.col, x.chip_row, x.chip_col) for x in chips.pixel_to_chip(df, GRID, patch, stride).collect()}
    assert got == want


def test_chip_goes_to_every_split_and_does_not_leak(spark):
    _rows, df = pixels(spark, 4, 0.6)
    px = df.withColumns({"pixel_split": F.when(F.col("row") < 14, "train").otherwise("test"), "trait": F.lit("t"), "y": F.col("value"), "pred": F.col("value")})
    windows = chips.pixel_to_chip(px, GRID, 8, 4)
    copies = chips.assign_chips(windows)
    n = {r.chip_row: r.n for r in copies.groupBy("chip_row").agg(F.count_distinct("split").alias("n")).collect()}
    assert n[2] == 2 and n[0] == 1
    masked = masks.split_mask(copies)
    assert quality.split_leakage(masked).filter("n_leaked > 0").count() == 0
    assert masked.filter("y is not null").count() > 0
    kept, report = chips.require_valid_target(copies.withColumn("y", F.when(F.col("row") < 5, F.col("y"))))
    r = {x.split: (x.n_kept, x.n_skipped) for x in report.collect()}
    assert r["test"][0] == 0 and kept.filter("split = 'test'").count() == 0


def test_mosaic_of_a_constant_is_the_constant(spark):
    _rows, df = pixels(spark, 6, 1.0)
    scores = chips.pixel_to_chip(df, GRID, 7, 3).withColumns({"trait": F.lit("t"), "score": F.lit(4.25)})
    out = chips.mosaic_weighted(scores, GRID, 7, 3).collect()
    assert len(out) == GRID.height * GRID.width and all(r.value == pytest.approx(4.25) for r in out)
    w = spark.createDataFrame([(0, 0), (3, 3), (6, 6)], "dr int, dc int").select(chips.triangular_weight(F.col("dr"), F.col("dc"), 7)).collect()
    assert [x[0] for x in w] == [1.0, 256.0, 1.0]


@pytest.mark.parametrize("seed", range(4))
def test_envelope_is_the_least_parabola(seed):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, 5, (40, 33)) ** 2 * 10_000 + np.arange(33)
    cost[rng.random(cost.shape) < (0.1, 0.6, 0.95, 1.0)[seed]] = -1
    got = gapfill.nearest_in_rows(cost, 10_000)
    for r in range(40):
        for c in range(33):
            known = [(10_000 * (c - j) ** 2 + cost[r, j], j) for j in range(33) if cost[r, j] >= 0]
            assert got[r, c] == (min(known)[1] if known else -1)


@pytest.mark.parametrize("max_km, cols, area", [(45.0, 128, 1 << 18), (45.0, 5, 60), (25.0, 3, 1), (None, 7, 500)])
def test_gap_fill_equals_brute_force(spark, max_km, cols, area, monkeypatch):
    monkeypatch.setattr(gapfill, "BLOCK_COLS", cols)
    monkeypatch.setattr(gapfill, "BLOCK_PIXELS", area)
    seen_rows, seen = pixels(spark, 8, 0.06)
    land_rows, land = pixels(spark, 9, 0.7)
    on_land = {(r, c) for r, c, _ in land_rows}
    known = {(r, c): v for r, c, v in seen_rows if (r, c) in on_land}
    out, report = gapfill.gap_fill_nearest(seen, land, GRID, max_km)
    got = {(x.row, x.col): (x.value, x.imputed) for x in out.collect()}
    assert set(got) == on_land
    n_imputed = 0
    for r, c in on_land:
        if (r, c) in known:
            assert got[(r, c)] == (known[(r, c)], False)
            continue
        d, rr, cc = min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in known)
        near = max_km is None or d <= (max_km / 10) ** 2
        n_imputed += near
        assert got[(r, c)] == ((known[(rr, cc)], True) if near else (None, False))
    r = report.first()
    assert (r.n_imputed, r.n_observed, r.n_land) == (n_imputed, len(known), len(on_land))


@pytest.mark.parametrize("max_km, cols, area", [(45.0, 128, 1 << 18), (45.0, 5, 60), (25.0, 3, 1)])
def test_gap_fill_of_many_maps_equals_one_by_one(spark, max_km, cols, area, monkeypatch):
    monkeypatch.setattr(gapfill, "BLOCK_COLS", cols)
    monkeypatch.setattr(gapfill, "BLOCK_PIXELS", area)
    land = {(r, c) for r, c, _ in pixels(spark, 9, 0.7)[0]}
    maps = [{(r, c): v for r, c, v in pixels(spark, seed, share)[0] if (r, c) in land} for seed, share in ((8, 0.06), (5, 0.3), (6, 0.0))]
    rows = [(r, c, maps[0].get((r, c)), maps[0].get((r, c)), maps[1].get((r, c)), maps[2].get((r, c))) for r, c in land]
    wide = spark.createDataFrame(rows, "row int, col int, a double, a2 double, b double, c double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(x.row, x.col): x for x in gapfill.gap_fill_maps(wide, ["a", "a2", "b", "c"], GRID, max_km).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == land
    for name, known in (("a", maps[0]), ("a2", maps[0]), ("b", maps[1]), ("c", maps[2])):
        for r, c in land:
            near = min((((r - y) ** 2 + (c - x) ** 2, y, x) for y, x in known), default=(1e9, 0, 0))
            want = (known[near[1:]], near[0] > 0) if near[0] <= (max_km / 10) ** 2 else (None, False)
            assert (got[(r, c)][name], got[(r, c)][f"{name}__imputed"]) == want


def test_gap_fill_queries_move_a_pixel_once_for_all_maps(spark):
    """One aggregation and one exchange into blocks: no exchange of a row per source and trait."""
    from pixelloom.catalog import all_queries

    plan = all_queries()["J13_gap_fill_nearest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_gap_fill_without_observations(spark):
    _rows, land = pixels(spark, 9, 0.5)
    none = spark.createDataFrame([], "row int, col int, value double")
    out, report = gapfill.gap_fill_nearest(none, land, GRID)
    assert out.filter("value is not null").count() == 0 and report.first().n_imputed == 0


def test_gap_fill_keeps_traits_apart(spark):
    land = spark.createDataFrame([(t, 0, c) for t in ("a", "b", None) for c in range(6)], "trait string, row int, col int")
    seen = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 0, 4, 2.0), ("b", 0, 5, 3.0), ("b", 0, 0, float("nan")), ("c", 0, 0, 9.0), (None, 0, 2, 4.0)], "trait string, row int, col int, value double")
    out, report = gapfill.gap_fill_nearest(seen, land, GRID, 15.0, ["trait"])
    got = {(r.trait, r.col): (r.value, r.imputed) for r in out.collect()}
    assert [got[("a", c)][0] for c in range(6)] == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0]
    assert [got[("b", c)][0] for c in range(6)] == [None, None, None, None, 3.0, 3.0] and got[("b", 4)][1] and not got[("b", 5)][1]
    assert [got[(None, c)][0] for c in range(6)] == [None, 4.0, 4.0, 4.0, None, None]
    assert {r.trait: tuple(r)[1:] for r in report.collect()} == {"a": (4, 2, 6), "b": (1, 1, 6), None: (2, 1, 6)}


def flood(labels):
    seen, parts = {}, 0
    for start in labels:
        if start in seen:
            continue
        parts += 1
        stack = [start]
        while stack:
            r, c = stack.pop()
            if (r, c) in seen:
                continue
            seen[(r, c)] = parts
            stack += [n for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if labels.get(n) == labels[start]]
    return seen


@pytest.mark.parametrize("tile, fan", [(3, 2), (4, 16), (256, 16)])
def test_components_equal_flood_fill(spark, tile, fan, monkeypatch):
    monkeypatch.setattr(components, "TILE", tile)
    monkeypatch.setattr(components, "FAN", fan)
    rng = random.Random(12)
    maps = {}
    for kind in ("a", "b", None):
        labels = {(r, c): rng.choice(["x", "y"]) for r in range(30) for c in range(24) if rng.random() < 0.8}
        if kind == "a":
            # a long snake, one component over the whole map
            labels.update({(r, c): "snake" for r in range(0, 30, 2) for c in range(24)})
            labels.update({(r, 23 if (r // 2) % 2 == 0 else 0): "snake" for r in range(1, 29, 2)})
        if kind == "b":
            labels.update({(r, c): None for r in range(5) for c in range(4)})
        maps[kind] = labels
    rows = [(k, r, c, v, "kept") for k, m in maps.items() for (r, c), v in m.items()]
    df = spark.createDataFrame(rows, "trait string, row int, col int, fold string, note string").repartition(7)
    parts = cut(components.components(df, "fold", GRID, ["trait"]))
    assert parts.columns == ["trait", "row", "col", "fold", "note", "component"] and parts.count() == len(rows)
    got = {(x.trait, x.row, x.col): x.component for x in parts.collect()}
    for kind, labels in maps.items():
        want = flood({k: v if v is not None else k for k, v in labels.items()})
        least = {}
        for (r, c), group in want.items():
            least[group] = min(least.get(group, 10**9), r * GRID.width + c)
        assert all(got[(kind, *k)] == least[g] for k, g in want.items())
    sizes = {(x.trait, x.fold): x for x in components.component_sizes(parts, "fold", 2.0, ["trait"]).collect()}
    snake = sizes[("a", "snake")]
    assert snake.n_components == 1 and snake.max_km2 == 2.0 * snake.n_pixels
    assert components.components(df.limit(0), "fold", GRID, ["trait"]).count() == 0


def inside(x, y, ring):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            hit = not hit
    return hit


ZONES = "zone_id int, ord int, name string, ring array<struct<x:double,y:double>>"


def zone_rings():
    star = [(1.2e5 + (9e4 if i % 2 else 3e4) * math.cos(i / 2000 * math.tau), 1.5e5 + (9e4 if i % 2 else 3e4) * math.sin(i / 2000 * math.tau)) for i in range(2000)]
    concave = [(8e4, 8e4), (2.3e5, 9e4), (2.0e5, 2.6e5), (1.2e5, 1.3e5), (6e4, 2.4e5)]
    return [
        # zone, order, ring: a hole and an island in it are more rings of one polygon
        (10, 0, [(5e3, 5e3), (2.2e5, 4e4), (1.1e5, 2.9e5)]),
        (11, 1, concave),
        (11, 1, [(1.0e5, 1.0e5), (1.0e5, 1.25e5), (1.4e5, 1.25e5), (1.4e5, 1.0e5)]),
        (11, 1, [(1.1e5, 1.05e5), (1.1e5, 1.15e5), (1.25e5, 1.15e5), (1.25e5, 1.05e5)]),
        (12, 2, [(-5e5, 2.7e5), (9e5, 2.7e5), (9e5, 9e5), (-5e5, 9e5)]),
        # edges through pixel centres, and a closed ring
        (13, 3, [(1.5e4, 1.5e4), (5.5e4, 1.5e4), (5.5e4, 5.5e4), (1.5e4, 5.5e4), (1.5e4, 1.5e4)]),
        (14, -1, star),
        (15, 9, [(2.9e5, 1e5), (3.5e5, 1e5), (3.5e5, 2e5)]),
        (16, 9, []),
    ]


@pytest.mark.parametrize("stripe", [1, 16])
def test_zones_equal_brute_force(spark, stripe, monkeypatch):
    monkeypatch.setattr(zones.zone_runs, "__defaults__", (stripe,))
    rings = zone_rings()
    z = spark.createDataFrame([(i, o, "n", [tuple(map(float, p)) for p in r]) for i, o, r in rings], ZONES)
    rows, df = pixels(spark, 2, 1.0)
    # repeated pixels, a column called like the result, one without a place
    df = df.unionByName(df.limit(50)).withColumn("zone_id", F.lit("old")).unionByName(spark.createDataFrame([(None, None, 0.0, "x")], "row int, col int, value double, zone_id string"))
    got = zones.pixel_to_zone(df, z, GRID)
    assert got.columns == ["row", "col", "value", "zone_id"]
    found = got.collect()
    assert len(found) == len(rows) + 51
    polygons = {(o, i) for i, o, _ in rings}
    seen = set()
    for r in found:
        if r.row is None:
            assert r.zone_id == zones.NO_ZONE
            continue
        x, y = 10_000 * (r.col + 0.5), 300_000 - 10_000 * (r.row + 0.5)
        hits = [p for p in polygons if sum(inside(x, y, ring) for i, o, ring in rings if (o, i) == p and ring) % 2]
        assert r.zone_id == (max(hits)[1] if hits else -1), (r.row, r.col)
        seen.add(r.zone_id)
    assert seen == {-1, 10, 11, 12, 13, 14}
    empty = zones.pixel_to_zone(df.drop("zone_id"), z.limit(0), GRID)
    assert empty.filter(F.col("zone_id") == zones.NO_ZONE).count() == len(found)


def test_wide_coverage_equals_long(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(-1, 3), rng.random() < 0.8, rng.choice([None, 0, 1, 2]), rng.choice([None, 1, 2])) for _ in range(400)]
    px = spark.createDataFrame(rows, "zone_id int, on_land boolean, a int, b int")
    z = spark.createDataFrame([(0, 0, "A"), (1, 1, "N/A"), (2, 2, "C"), (7, 3, "empty")], "zone_id int, ord int, name string")
    long = px.unpivot(["zone_id"], ["a", "b"], "trait", "source_code").filter("source_code is not null")
    want = zones.zonal_coverage(long, px.filter("on_land"), z).collect()
    got = zones.zonal_coverage_wide(px, z, ["a", "b"]).collect()
    key = lambda r: (r.section, r.name)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), nan_ok=True)


def test_zonal_coverage_rules(spark):
    z = spark.createDataFrame([(0, "A"), (1, "N/A"), (2, "empty")], "zone_id int, name string")
    px = spark.createDataFrame([(0,)] * 4 + [(1,)] * 2, "zone_id int")
    merged = spark.createDataFrame([("t", 0, 1), ("t", 0, 2), ("u", 0, 2), ("t", 1, 1)], "trait string, zone_id int, source_code int")
    rows = [r for r in zones.zone_order(zones.zonal_coverage(merged, px, z)).collect()]
    assert [r.name for r in rows] == ["A", "empty", "N/A", "TOTAL"]
    a, empty, na, total = rows
    assert a.valid_share == pytest.approx((2 / 4 + 1 / 4) / 2) and a.aux_share == pytest.approx((0.5 + 0.0) / 2)
    assert na.valid_share == pytest.approx(0.25) and na.primary_share == 0.0
    assert empty.n_total == 0 and empty.valid_share is None and total.n_total == 6


def test_block_land_and_mosaic(spark):
    native = spark.createDataFrame([(0, 0, 80), (0, 1, 80), (1, 2, 80), (1, 3, 10)], "row int, col int, cls int")
    frame = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "row int, col int")
    assert {(r.row, r.col): r.land for r in resample.block_land(native, 2, 80, frame).collect()} == {(0, 0): 0, (0, 1): 1, (0, 2): 255}
    tiles = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, float("nan")), ("b", 0, 1, 2.0), ("a", 0, 1, 5.0), ("c", 9, 99, 1.0)], "tile_name string, row int, col int, value double")
    got = {(r.row, r.col): r.value for r in resample.mosaic_tiles(tiles, GRID).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0}


def test_pyramid_rolls_up_to_direct_averages(spark):
    geo = GridSpec("EPSG:4326", 0.25, 5.0, -0.25, 50.0, 30, 24)
    _rows, df = pixels(spark, 7, 0.8, geo)
    both = resample.tile_pyramid(df, geo, [0, 3, 5], 16)
    for z in (0, 3):
        direct = {tuple(r)[:5]: r.value for r in resample.tile_pyramid(df, geo, [z], 16).collect()}
        rolled = {tuple(r)[:5]: r.value for r in both.filter(F.col("z") == z).collect()}
        assert set(direct) == set(rolled) and all(direct[k] == pytest.approx(rolled[k]) for k in direct)


def test_spatial_sample_counts(spark):
    rng = random.Random(3)
    # one corner holds a third of all chips
    pts = [(i, rng.random() if i % 3 else 0.01, rng.random() if i % 3 else 0.02) for i in range(900)]
    df = spark.createDataFrame(pts, "chip_id int, cx double, cy double")
    for n in (5, 64, 300, 900):
        out = sampling.sample_spatial_grid(df, n, 6, 4).collect()
        assert len(out) == n == len({r.chip_id for r in out})
        if n >= 36:
            assert len({r.bin for r in out}) == sampling.spatial_bins(df, 6).select("bin").distinct().count()


def test_exact_sample(spark):
    df = spark.range(1000)
    a = {r.id for r in sampling.sample_exact(df, ["id"], 0.25, seed=1).collect()}
    b = {r.id for r in sampling.sample_exact(df.repartition(7), ["id"], 0.25, seed=1).collect()}
    assert len(a) == 250 and a == b
    assert sampling.sample_exact(df, ["id"], 0.00001).count() == 1


def test_cap_per_channel(spark):
    rows = [("train", 1, "t", i // 5, i % 5, 1.0 if i % 2 else None, 2) for i in range(25)]
    df = spark.createDataFrame(rows, "split string, chip_id int, trait string, dr int, dc int, y double, source_code int")
    out = sampling.cap_per_channel(df, 5, 3).collect()
    assert len(out) == 25 and sum(r.y is not None for r in out) == 5 == sum(r.source_code > 0 for r in out)
    assert sum(r.y is not None for r in sampling.cap_per_channel(df, 99, 3).collect()) == 12


def test_target_layout():
    got = chips.target_layout(["X1", "X2"], ["mean", "std"], ["X2"])
    assert got == [("X2", "mean", 1, 2), ("X2", "std", 1, 3)]
    with pytest.raises(ValueError):
        chips.target_layout(["X1"], ["mean"], ["X9"])



def test_all_set_and_strides_of_chips(spark):
    _rows, df = pixels(spark, 5, 1.0)
    windows = chips.pixel_to_chip(df, GRID, 8, 4).withColumn("pixel_split", F.when(F.col("row") < 10, "train").when(F.col("row") < 20, "val"))
    copies = cut(chips.assign_chips(windows, {"train": 4, "val": 8, "all": 8}, 4))
    at = lambda split, step: windows.where(split).where(f"chip_row % {step} = 0 AND chip_col % {step} = 0").select("chip_id").distinct().count()
    got = {r.split: r.n for r in copies.groupBy("split").agg(F.count_distinct("chip_id").alias("n")).collect()}
    assert got == {"train": at("pixel_split = 'train'", 1), "val": at("pixel_split = 'val'", 2), "all": at("true", 2)}
    masked = masks.split_mask(copies.withColumns({"y": F.lit(1.0), "pred": F.lit(1.0)})).where("split = 'all'")
    assert masked.where("(y IS NOT NULL) <> (pixel_split IS NOT NULL)").isEmpty() and masked.where("y IS NOT NULL").count() > 0
    with pytest.raises(ValueError, match="multiples"):
        chips.assign_chips(windows, {"train": 12}, 8)


def test_offset_without_scale_leaves_values(spark):
    rules = spark.createDataFrame(
        [("a", None, None, 5.0, None, None), ("b", None, 2.0, None, None, None), ("c", None, 2.0, 5.0, None, None)],
        "variable string, nodata double, scale double, offset double, valid_min double, valid_max double",
    )
    values = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)], "variable string, v double")
    assert {r.variable: r.v for r in transforms.to_physical(values, rules).collect()} == {"a": 1.0, "b": 2.0, "c": 7.0, "d": 1.0}


def test_block_land_dense_equals_scaffold(spark):
    rng = np.random.default_rng(3)
    px = {(int(r), int(c)) for r, c in zip(rng.integers(0, 40, 120), rng.integers(0, 44, 120))}
    native = spark.createDataFrame([(r, c, 80 if (r + c) % 3 else 10) for r, c in px], "row int, col int, cls int")
    rows = [0, 1, 4, 5, 9, 9, 12]
    wanted = spark.createDataFrame([(r,) for r in rows], "row int")
    every = spark.createDataFrame([(r, c) for r in set(rows) for c in range(11)], "row int, col int")
    dense = sorted(map(tuple, resample.block_land_dense(native, 4, wanted, 11).collect()))
    assert dense == sorted(map(tuple, resample.block_land(native, 4, 80, every).collect())) and len(dense) == 66


def test_dense_land_is_made_after_the_exchange(spark):
    """Coarse pixels without data are neither shuffled nor joined."""
    from pixelloom.catalog import all_queries

    plan = all_queries()["A29_block_land"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Exchange")


@pytest.mark.parametrize("name, exchanges", [("P14_land_finalize", 1), ("P7_apply_water_mask", 1), ("A28_block_mean", 2)])
def test_means_of_all_traits_share_an_exchange(spark, name, exchanges):
    from pixelloom.catalog import all_queries

    plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == exchanges and "Join" not in plan
    # traits unfold after the last exchange
    assert max(plan.find("Generate"), plan.find("Expand")) < plan.index("Exchange")


def test_gap_fill_observations_travel_by_source(spark, monkeypatch):
    """J13_gap_fill_report: a row has the traits of its source, not of all maps; repeated and not finite ones give the same as maps do."""
    rows = [((i * 7) % 30, (i * 11) % 24, "ab"[i % 2], float(i % 13), None if i % 3 else i / 7) for i in range(40)]
    rows += [(3, 4, "a", 1.0, 2.0)] * 9 + [(9, 9, "b", float("nan"), 5.0), (9, 9, "b", 2.0, 7.0), (29, 23, None, None, None)] * 2
    seen = spark.createDataFrame(rows, "row int, col int, source string, x double, y double")
    maps = [f"{s}_{x}" for s in "ab" for x in "xy"]
    means = [F.avg(F.when(F.col("source") == m[0], F.col(m[2]))).alias(m) for m in maps]
    want = gapfill.gap_fill_maps(seen.groupBy("row", "col").agg(*means), maps, GRID, 60.0)
    got = gapfill.gap_fill_observations(seen, ["a", "b"], ["x", "y"], GRID, 60.0)
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    dealt = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if line.lstrip(" +-:").startswith("MapInArrow")]
    assert dealt and all("v1" in line and "v2" not in line for line in dealt)


def test_nearest_in_block_stops_at_the_nearest():
    """The nearest of all observations, ties by row, then column, as from looking at every one."""
    random.seed(3)
    for share in (0.002, 0.05, 0.5):
        seen = np.array([[random.random() < share for _ in range(60)] for _ in range(70)])
        y, x = (v.ravel() for v in np.mgrid[0:70, 12:48])
        d2, place = gapfill._nearest_in_block(seen, y, x, 12)
        at = np.argwhere(seen)
        for i in range(len(y)):
            near = min((((y[i] - r) ** 2 + (x[i] - c) ** 2, r, c) for r, c in at.tolist() if abs(x[i] - c) <= 12), default=None)
            if near and near[0] <= 144:
                assert (d2[i], place[i]) == (near[0], near[1] * 60 + near[2])
            else:
                assert d2[i] > 144


def test_gap_fill_rounds_means_before_they_fill(spark):
    """J13_gap_fill_nearest: a mean is rounded once, not for each pixel that it fills."""
    from pixelloom.catalog import all_queries

    plan = all_queries()["J13_gap_fill_nearest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("MapInArrow", 1)
    assert "round(" not in above and "round(" in below


def test_dense_land_of_a_wide_grid_is_stored_small(spark, tmp_path):
    """A29_block_land: columns recur within a page, so a file does not hold four bytes for each."""
    native = spark.createDataFrame([(r * 4, c * 4, 10) for r in range(20) for c in range(r, 30_000, 3_001)], "row int, col int, cls int")
    dense = resample.block_land_dense(native, 4, spark.range(20).select(F.col("id").cast("int").alias("row")), 30_000)
    dense.coalesce(1).write.parquet(f"{tmp_path}/land")
    assert spark.read.parquet(f"{tmp_path}/land").count() == 600_000
    assert sum(f.stat().st_size for f in (tmp_path / "land").iterdir()) < 600_000
