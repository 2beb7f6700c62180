import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlens.operators.raster import cells as CE
from boxlens.operators.raster import colour as CO
from boxlens.operators.raster import components as CC
from boxlens.operators.raster import cues as CU
from boxlens.operators.raster import grid as G
from boxlens.operators.raster import lines as LI
from boxlens.operators.raster import quality as Q

RASTER = "image long, y long, x long, w long, h long, v double"


def table(spark, planes):
    rows = [(i, y, x, p.shape[1], p.shape[0], float(p[y, x])) for i, p in planes.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, RASTER)


def plane_of(rows, col, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.y, r.x] = r[col]
    return out


def flood(mask, diagonal=True):
    seen, parts = set(), []
    moves = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for start in map(tuple, np.argwhere(mask)):
        if start in seen:
            continue
        part, todo = set(), deque([start])
        seen.add(start)
        while todo:
            y, x = todo.popleft()
            part.add((int(y), int(x)))
            for a, b in moves:
                n = (y + a, x + b)
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in seen:
                    seen.add(n)
                    todo.append(n)
        parts.append(frozenset(part))
    return set(parts)


def spiral(n):
    m = np.zeros((n, n), bool)
    y = x = 0
    dy, dx = 0, 1
    m[0, 0] = True
    while True:
        moved = False
        while 0 <= y + dy < n and 0 <= x + dx < n and not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and m[y + 2 * dy, x + 2 * dx]):
            y, x, moved = y + dy, x + dx, True
            m[y, x] = True
        if not moved:
            return m
        dy, dx = dx, -dy


def test_components_equal_a_flood_fill(spark):
    rng = np.random.default_rng(2)
    comb = np.zeros((12, 30), bool)
    comb[:, ::2], comb[11, :] = True, True
    masks = {1: rng.random((20, 30)) < 0.45, 2: spiral(21), 3: comb, 4: np.zeros((4, 4), bool), 5: np.ones((6, 6), bool)}
    px = table(spark, {k: v.astype(float) for k, v in masks.items()}).filter("v = 1")
    for connectivity in (8, 4):
        got = {}
        for r in CC.components(px, connectivity).collect():
            got.setdefault((r.image, r.label), set()).add((r.y, r.x))
        for k, m in masks.items():
            assert {frozenset(v) for (i, _), v in got.items() if i == k} == flood(m, connectivity == 8)


def test_wide_lines_meet_across_bands(spark):
    m = np.zeros((3, 700), bool)
    m[0, :], m[1, 699], m[2, ::2] = True, True, True
    got = {r.label for r in CC.components(table(spark, {1: m.astype(float)}).filter("v = 1")).collect()}
    assert len(got) == len(flood(m))


def test_reflection_repeats_on_short_lines(spark):
    p = np.arange(6, dtype=float).reshape(2, 3)
    k = G.gaussian_kernel(2.0)
    r = len(k) // 2
    ext = np.pad(p, ((r, r), (r, r)), mode="reflect")
    want = np.array([[sum(k[a] * k[b] * ext[y + a, x + b] for a in range(2 * r + 1) for b in range(2 * r + 1)) for x in range(3)] for y in range(2)])
    got = plane_of(G.gaussian(table(spark, {1: p}), ["v"], 2.0).collect(), "v", p.shape)
    assert np.allclose(got, want)


def test_scales_folded_into_one_kernel_equal_smoothing_then_differencing(spark):
    p = np.random.default_rng(0).integers(0, 255, (16, 18)).astype(float)
    t = table(spark, {1: p})
    direct = plane_of(G.sobel(t, "v", 1.0).collect(), "gx", p.shape)
    stepped = plane_of(G.sobel(G.gaussian(t, ["v"], 1.0), "v").collect(), "gx", p.shape)
    assert np.allclose(direct, stepped)


def test_quality_by_hand(spark):
    flat = np.full((8, 8), 100.0)
    half = np.zeros((8, 8))
    half[:, 4:] = 255
    df = table(spark, {1: flat, 2: half}).withColumns({"gray": F.col("v"), "val": F.col("v")})
    q = {r.image: r for r in Q.quality(df).collect()}
    assert (q[1].gray_std, q[1].noise_sigma, q[1].laplacian_variance, q[1].block_mean_std_4x4) == (0.0, 0.0, 0.0, 0.0)
    assert (q[2].saturation_ratio, q[2].dark_ratio, q[2].bright_ratio, q[2].block_mean_std_4x4) == (1.0, 0.5, 0.5, 127.5)
    tiny = Q.quality(table(spark, {1: np.ones((2, 2))}).withColumns({"gray": F.col("v"), "val": F.col("v")})).first()
    assert tiny.noise_sigma is None and tiny.block_mean_std_4x4 is None


def test_pixels_outside_the_mask_change_no_masked_metric(spark):
    p = np.random.default_rng(1).integers(0, 255, (12, 12)).astype(float)
    other = p.copy()
    other[:, 8:] = 7
    metrics = []
    for plane in (p, other):
        df = table(spark, {1: plane}).withColumns({"gray": F.col("v"), "mask": F.col("x") < 8, "support": F.col("x") < 7})
        metrics.append(tuple(Q.quality_masked(df, support="support").first()))
    assert metrics[0] == pytest.approx(metrics[1])


def test_flat_tiles_stay_flat_and_contrast_grows(spark):
    flat = G.equalize_tiles(table(spark, {1: np.full((16, 16), 90.0)}), "v", 2.0, 2).select("v").distinct().count()
    assert flat == 1
    soft = np.tile(np.linspace(100, 130, 16).round(), (16, 1))
    out = G.equalize_tiles(table(spark, {1: soft}), "v", 4.0, 2)
    assert out.agg(F.stddev_pop("v")).first()[0] > soft.std()


def test_polygons(spark):
    frame = spark.createDataFrame([(1, 10, 10), (2, 10, 10)], "image long, w long, h long")
    pts = spark.createDataFrame([(1, 0, 2.0, 2.0), (1, 1, 7.0, 2.0), (1, 2, 7.0, 5.0), (1, 3, 2.0, 5.0), (2, 0, 1.0, 1.0), (2, 1, 5.0, 5.0)], "image long, ord int, x double, y double")
    got = {(r.image, r.y, r.x) for r in CC.polygon_mask(frame, pts).collect()}
    assert got == {(1, y, x) for y in range(2, 6) for x in range(2, 8)}


def scene(spark, h=96, w=128):
    """Sky above, grass at the sides, textured road with a dark crack."""
    rng = np.random.default_rng(7)
    b, g, r = (np.zeros((h, w)) for _ in range(3))
    b[:], g[:], r[:] = 230, 190, 150
    top = h // 3
    for plane, value in ((b, 40), (g, 140), (r, 60)):
        plane[top:] = value + rng.normal(0, 12, (h - top, w))
    road = np.zeros((h, w), bool)
    road[top:, w // 5: w - w // 5] = True
    tone = np.clip(rng.normal(120, 4, (h, w)), 0, 255)
    for plane in (b, g, r):
        plane[road] = tone[road]
    crack = np.zeros((h, w), bool)
    for y in range(top + 8, h - 6):
        x = w // 2 + int(4 * math.sin(y / 9))
        crack[y, x:x + 2] = True
    for plane in (b, g, r):
        plane[crack] = 35
    rows = [(1, y, x, w, h, *(float(round(min(max(p[y, x], 0), 255))) for p in (b, g, r))) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "image long, y long, x long, w long, h long, b double, g double, r double")
    return df.withColumn("gray", CO.gray()).cache(), road, crack


def test_road_grows_on_asphalt_and_the_crack_is_found(spark):
    px, road, crack = scene(spark)
    f = CE.FeatureParams(cell_size=8)
    maps = CE.feature_maps(px, f).cache()
    scored = CE.score_cells(CE.cell_features(maps, f), CE.SeedParams(texture_range=(2.0, 60.0)))
    seeds = CE.select_seeds(scored, CE.SeedParams(min_score=0.3)).cache()
    found = seeds.collect()
    assert found and all(road[int(s.y), int(s.x)] for s in found)
    best = min(found, key=lambda s: s["rank"])
    assert best.score == max(s.score for s in found)
    grown = {(r.y, r.x) for r in CE.grow_regions(maps, seeds, CE.GrowParams(max_gradient=None), f).collect()}
    inside = sum(road[y, x] for y, x in grown)
    assert inside / len(grown) > 0.9 and inside > 0.3 * road.sum()
    line = LI.centerline(LI.line_score(px, sigmas=(1.0, 1.5)))
    trace = CC.hysteresis(line, F.col("center") >= 30, F.col("center") >= 60)
    shapes = CC.shape_features(trace.join(line.select("image", "y", "x", "center"), ["image", "y", "x"]), score="center").collect()
    long_one = max(shapes, key=lambda s: s.h)  # the horizon is a line too, but a level one
    assert long_one.h > 0.7 * crack.any(axis=1).sum() and long_one.elong > 3
    points = trace.filter(F.col("label") == long_one.label)
    widths = spark.createDataFrame([(1, long_one.label, 2.0)], "image long, label long, width double")
    assert LI.valley_score(px, points, widths, radius=4).first().valley > 0.5


def test_a_step_is_no_valley(spark):
    p = np.full((20, 20), 50.0)
    p[:, 10:] = 150
    df = table(spark, {1: p})
    points = df.filter("x = 9 AND y BETWEEN 3 AND 16").select("image", "y", "x", F.lit(1).cast("long").alias("label"))
    widths = spark.createDataFrame([(1, 1, 1.0)], "image long, label long, width double")
    assert LI.valley_score(df, points, widths, "v", radius=3).first().valley == 0.0
    alone = points.filter("y = 5")
    assert LI.valley_score(df, alone, widths, "v", radius=3).first().valley == 1.0


def test_road_top_stops_at_the_sky(spark):
    px, road, _ = scene(spark)
    top = CE.road_top(px.withColumns({c: F.col(c) for c in "bgr"}), texture_sigma=1.0).first().road_top
    assert 0.0 <= top <= 1 / 3 + 0.05


def test_edges_follow_a_step(spark):
    p = np.zeros((12, 12))
    p[:, 6:] = 200
    df = table(spark, {1: p, 2: np.zeros((5, 5))})
    got = {r.image: r.n_edges for r in LI.edge_count(df, "v").collect()}
    assert got[2] == 0 and 12 <= got[1] <= 24
    half = LI.edge_count(df.withColumn("mask", F.col("y") < 6), "v", mask="mask").filter("image = 1").first().n_edges
    assert half == got[1] / 2


def test_ring_cues_by_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.integers(20, 230, (24, 30)).astype(float)
    maps = table(spark, {1: p}).selectExpr("image", "y", "x", "w", "h", "v / 255 AS cx", "v / 300 AS cy", "v AS val", "v + 1 AS energy", "v / 256 AS coherence", "v / 2 + 1 AS l2")
    det = spark.createDataFrame([(1, 1, 8.0, 6.0, 13.0, 10.0, 30, 24)], "image long, did long, x1 double, y1 double, x2 double, y2 double, w long, h long")
    got = CU.ring_cues(maps, det, CU.reference_stats(maps)).first()
    ref = p[int(.6 * 24):int(.8 * 24), int(.3 * 30):int(.7 * 30)].ravel()
    ring = np.ones_like(p, bool)
    keep = np.zeros_like(p, bool)
    keep[max(0, int(8 - 10)):int(8 + 10), max(0, int(10.5 - 11)):int(10.5 + 11)] = True
    ring &= keep
    ring[4:12, 6:15] = False
    v = p[ring]
    iqr = max(np.percentile(ref, 75) - np.percentile(ref, 25), 5)
    assert got.bright == pytest.approx(abs(np.median(v) - np.median(ref)) / iqr)
    assert got.energy == pytest.approx(abs(np.log((np.median(v) + 1) / (np.median(ref) + 1))))
    assert got.coherence == pytest.approx(v.mean() / 256 - ref.mean() / 256)
    cm = np.array([np.median(ref) / 255, np.median(ref) / 300])
    spread = max(np.median(np.hypot(ref / 255 - cm[0], ref / 300 - cm[1])), 0.02)
    assert got.color == pytest.approx(np.hypot(np.median(v) / 255 - cm[0], np.median(v) / 300 - cm[1]) / spread)


def test_percolation_reaches_connected_dark_pixels_only(spark):
    p = np.full((20, 20), 200.0)
    p[10, 5:16] = 10
    p[6, 12] = 10
    df = table(spark, {1: p}).withColumn("gray", F.col("v"))
    points = df.filter("y = 10 AND x BETWEEN 8 AND 11").select("image", "y", "x", F.lit(1).cast("long").alias("did"))
    det = spark.createDataFrame([(1, 1, 8.0, 10.0, 12.0, 11.0, 20, 20)], "image long, did long, x1 double, y1 double, x2 double, y2 double, w long, h long")
    got = CU.percolate(df, points, det).first()
    # the window reaches from x = 2 to x = 17, so the whole dark run counts and the lone pixel does not
    assert got.perc_spread == 11 / 4 and got.perc_elong == pytest.approx(11)


def test_endpoints_point_outwards(spark):
    pts = [(1, 5, x, 77) for x in range(3, 12)] + [(1, 20, 20, 78)]
    df = spark.createDataFrame(pts, "image long, y long, x long, label long")
    ends = {r.x: (r.y, round(r.ux), round(r.uy), round(r.angle) % 180) for r in CC.piece_endpoints(df).collect()}
    assert ends == {3: (5, -1, 0, 0), 11: (5, 1, 0, 0)}


def test_context_counts_other_trace_only(spark):
    p = np.zeros((20, 20))
    df = table(spark, {1: p}).selectExpr("*", "x < 10 AS road", "y = 8 OR y = 12 AS trace", "false AS paint")
    points = df.filter("y = 8 AND x BETWEEN 6 AND 9").select("image", "y", "x", F.lit(1).cast("long").alias("did"))
    det = spark.createDataFrame([(1, 1, 6.0, 8.0, 10.0, 9.0, 20, 20)], "image long, did long, x1 double, y1 double, x2 double, y2 double, w long, h long")
    got = CU.candidate_context(df, points, det).first()
    w = [(y, x) for y in range(3, 14) for x in range(0, 16)]
    other = sum((y in (8, 12)) and not (y == 8 and 6 <= x <= 9) for y, x in w)
    assert got.straight == 1.0 and got.paint == 0.0 and 0.4 < got.road < 0.6
    assert got.density == pytest.approx(other / len(w), abs=0.02)


def test_summed_area_boxes(spark):
    p = np.random.default_rng(5).integers(0, 9, (9, 11)).astype(float)
    sat = G.integral(table(spark, {1: p}), "v")
    rng = random.Random(1)
    boxes = []
    for n in range(12):
        x1, y1 = rng.randrange(0, 10), rng.randrange(0, 8)
        boxes.append((1, n, float(x1), float(y1), float(rng.randrange(x1 + 1, 12)), float(rng.randrange(y1 + 1, 10))))
    got = {r.did: r.total for r in G.box_totals(spark.createDataFrame(boxes, "image long, did long, x1 double, y1 double, x2 double, y2 double"), sat).collect()}
    for _, n, x1, y1, x2, y2 in boxes:
        assert got[n] == p[int(y1):int(y2), int(x1):int(x2)].sum()


def test_refine_keeps_a_divided_road(spark):
    m = np.zeros((30, 40))
    m[:, 2:16], m[:, 22:38] = 1, 1
    m[10:12, 5:7] = 0
    m[3, 19] = 1
    df = table(spark, {1: m}).withColumn("mask", F.col("v") == 1)
    got = plane_of(CC.refine_mask(df, close=3, open_=3, hole_ratio=0.02, min_ratio=0.05).withColumn("m", F.col("mask").cast("int")).collect(), "m", m.shape)
    assert got[10:12, 5:7].all() and not got[3, 19] and got[15, 5] and got[15, 30]


def test_box_cues_by_brute_force(spark):
    rng = np.random.default_rng(9)
    shape = (26, 32)
    b, g, r = (rng.integers(10, 240, shape).astype(float) for _ in range(3))
    gray = np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5)
    rows = [(1, y, x, 32, 26, *(float(p[y, x]) for p in (b, g, r, gray, gray / 3))) for y in range(26) for x in range(32)]
    px = spark.createDataFrame(rows, "image long, y long, x long, w long, h long, b double, g double, r double, gray double, grad double")
    box = (8, 6, 19, 15)
    det = spark.createDataFrame([(1, 1, *map(float, box), 32, 26), (1, 2, 3.0, 3.0, 5.0, 9.0, 32, 26)], "image long, did long, x1 double, y1 double, x2 double, y2 double, w long, h long")
    got = CU.box_cues(px, det).collect()
    assert [q.did for q in got] == [1], "a box under four pixels wide is not measured"
    q = got[0]
    inside, window = np.zeros(shape, bool), np.zeros(shape, bool)
    inside[6:15, 8:19] = True
    window[max(0, 6 - 4):15 + 4, max(0, 8 - 5):19 + 5] = True
    ring = window & ~inside
    total = b + g + r + 1
    gi, go = gray[inside], gray[ring]
    iqr = max(np.percentile(go, 75) - np.percentile(go, 25), 1)
    assert q.dark_p10 == pytest.approx((np.percentile(go, 10) - np.percentile(gi, 10)) / iqr)
    assert q.dark == pytest.approx((np.median(go) - np.median(gi)) / iqr)
    assert q.tex == pytest.approx(gi.std() / go.std())
    assert q.grad == pytest.approx(gi.mean() / go.mean())
    assert q.chroma == pytest.approx(100 * np.hypot(np.median((r / total)[inside]) - np.median((r / total)[ring]), np.median((g / total)[inside]) - np.median((g / total)[ring])))
    assert q.aspect == pytest.approx(11 / 9) and q.rel_y == pytest.approx(10.5 / 26)


def test_onroad_cues_by_brute_force(spark):
    rng = np.random.default_rng(11)
    shape = (24, 30)
    v = rng.integers(60, 200, shape).astype(float)
    maps = table(spark, {1: v}).selectExpr("*", "v AS smooth", "v * 2 AS ta", "v - 100 AS tb", "v + 7 AS tc", "v / 2 AS score", "v / 4 AS big")
    det = spark.createDataFrame([(1, 1, 10.0, 8.0, 16.0, 11.0, 30, 24)], "image long, did long, x1 double, y1 double, x2 double, y2 double, w long, h long")
    pts = [(8 + k // 3, 10 + k) for k in range(6)]
    points = spark.createDataFrame([(1, 1, y, x) for y, x in pts], "image long, did long, y long, x long")
    got = CU.onroad_cues(maps, points, det, strong=F.col("score") >= 60, big=["big"]).first()
    ring = np.zeros(shape, bool)
    ring[max(0, int(9.5 - 9)):int(9.5 + 9), max(0, 13 - 12):13 + 12] = True
    ring[6:13, 8:18] = False
    w, own = v[ring], np.array([v[p] for p in pts])
    assert got.depth == pytest.approx((np.median(w) - own.mean()) / max(np.percentile(w, 75) - np.percentile(w, 25), 2))
    a, b, c = (w * 2).sum(), (w - 100).sum(), (w + 7).sum()
    xy = np.array([(x, y) for y, x in pts], float)
    _, _, vt = np.linalg.svd(xy - xy.mean(0))
    along = np.arctan2(vt[0, 1], vt[0, 0]) - (0.5 * np.arctan2(2 * b, a - c) + np.pi / 2)
    assert got.streak == pytest.approx((np.hypot(a - c, 2 * b) / (a + c)) ** 2 * np.cos(along) ** 2)
    assert got.strong == pytest.approx((own / 2 >= 60).mean()) and got.persist_big == pytest.approx(0.5)
    assert got.snr == pytest.approx((own / 2).mean() / np.percentile(w / 2, 95))


def test_rough_candidates_respect_the_area_limits(spark):
    m = np.zeros((40, 40))
    m[5:15, 5:15], m[20:22, 20:22], m[25:40, 0:39] = 1, 1, 1
    got = CU.rough_candidates(table(spark, {1: m}), F.col("v") == 1, 0.02, 0.2).collect()
    assert [(c.x1, c.y1, c.x2, c.y2, c.area) for c in got] == [(5.0, 5.0, 15.0, 15.0, 100)]


def test_equalisation_repeats_no_pixel(spark):
    """A tile's table is one row and a pixel meets one row of four tables: no sort of tables, no regrouping of pixels."""
    from boxlens.operators.raster import grid

    px = spark.range(400).selectExpr("1L AS image", "id DIV 20 AS y", "id % 20 AS x", "double(id % 256) AS v", "20L AS w", "20L AS h")
    out = grid.equalize_tiles(px, "v", 2.0, 4)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 400
