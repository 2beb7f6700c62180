"""Spanning forests, traces at many levels and windowed medians against plain NumPy."""

import numpy as np
from pyspark.sql import functions as F

from boxlens.operators.raster import cues as CU
from boxlens.operators.raster import forest as FO

LEVELS, RATIO = [40.0, 70.0, 90.0], 0.8


def scene(seed, side=14):
    return np.random.default_rng(seed).integers(0, 100, (side, side)).astype(float)


def pixels(spark, rasters):
    rows = [(i, y, x, float(v), r.shape[1], r.shape[0]) for i, r in enumerate(rasters) for (y, x), v in np.ndenumerate(r)]
    return spark.createDataFrame(rows, "image bigint, y bigint, x bigint, v double, w bigint, h bigint")


def parts(mask):
    """Label of every pixel of a mask: its first pixel's node, by flooding."""
    label = {}
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in label:
            continue
        stack, name = [(y, x)], (int(y) << 32) + int(x)
        label[y, x] = name
        while stack:
            a, b = stack.pop()
            for c in range(a - 1, a + 2):
                for d in range(b - 1, b + 2):
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and (c, d) not in label:
                        label[c, d] = name
                        stack.append((c, d))
    return label


def test_traces_of_all_levels_are_those_of_each(spark):
    rasters = [scene(1), scene(2), np.zeros((14, 14)), np.full((14, 14), 95.0)]
    got = {tuple(r) for r in FO.traces(pixels(spark, rasters), "v", LEVELS, RATIO).collect()}
    want = set()
    for i, r in enumerate(rasters):
        for level in LEVELS:
            label = parts(r >= level * RATIO)
            strong = {n for (y, x), n in label.items() if r[y, x] >= level}
            want |= {(i, level, y, x, n) for (y, x), n in label.items() if n in strong}
    assert got == want


def test_forest_has_the_greatest_weight(spark):
    raster = scene(3)
    p = pixels(spark, [raster])
    edges = FO.neighbour_edges(p, "v", ["image"]).withColumn("first", F.lit(0))
    nodes = p.select("image", FO.node_of(F.col("y"), F.col("x")).alias("node"), F.lit(0).alias("first"))
    labels, forest = FO.spanning_forest(nodes, edges, 1, ["image"])
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    total = 0
    for e in sorted(edges.collect(), key=lambda e: -e.weight):
        a, b = find(e.u), find(e.v)
        if a != b:
            root[a] = b
            total += e.weight
    found = forest.collect()
    assert len(found) == raster.size - 1 and sum(e.weight for e in found) == total
    assert {r.label for r in labels.collect()} == {0}


def line(y, x1, x2):
    return [(y, x) for x in range(x1, x2)]


def test_links_states_and_long_groups(spark):
    """Two halves of a line with a gap of five: apart at distance 3, one group with the drawn line at distance 6."""
    raster = np.zeros((20, 40))
    for y, x in line(10, 2, 10) + line(10, 15, 23):
        raster[y, x] = 100.0
    p = pixels(spark, [raster])
    trace = FO.traces(p, "v", [90.0], 0.8)
    groups = FO.linked_traces(trace, [0, 3, 6], 30.0, 3)
    count = {(r.distance, r.n) for r in groups.groupBy("distance", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count == {(0.0, 8), (3.0, 8), (6.0, 21)}
    rows = [(0, 1, True, 1.0, 8.0, 24.0, 13.0), (0, 2, True, 2.0, 8.0, 12.0, 13.0), (0, 3, False, 30.0, 1.0, 38.0, 5.0), (0, 4, True, 5.0, 5.0, 6.0, 9.0)]
    boxes = spark.createDataFrame(rows, "image bigint, did bigint, is_truth boolean, x1 double, y1 double, x2 double, y2 double")
    states = {(r.distance, r.did): r.state for r in FO.box_states(groups, boxes, [90.0], [0, 3, 6]).collect()}
    assert [states[0.0, d] for d in (1, 2, 3, 4)] == ["short", "M", "short", None]
    assert [states[6.0, d] for d in (1, 2, 3, 4)] == ["M", "overflow", "short", None]
    assert [r.empty for r in FO.empty_boxes(trace, boxes, [90.0]).collect()] == [1 / 3]
    far = boxes.filter("did = 3").withColumn("is_truth", F.lit(True))
    assert {(r.distance, r.n_long) for r in FO.long_groups(groups, far, p, [90.0], [0, 3, 6], 15).collect()} == {(0.0, 0.0), (3.0, 0.0), (6.0, 1.0)}


def test_window_median_at_tile_and_frame_borders(spark):
    rasters = [np.random.default_rng(8).integers(0, 256, (23, 37)).astype(float), np.full((3, 2), 7.0)]
    for radius in (1, 6):
        got = {(r.image, r.y, r.x): r.bg_v for r in CU.window_median(pixels(spark, rasters), ["v"], radius, tile=10).collect()}
        want = {}
        for i, r in enumerate(rasters):
            wide = np.pad(r, radius, mode="edge")
            for y, x in np.ndindex(r.shape):
                want[i, y, x] = np.median(wide[y : y + 2 * radius + 1, x : x + 2 * radius + 1])
        assert got == want


def test_joins_of_traces_are_merged(spark):
    """Small as these tables are, none is gathered on the driver: at size they grow with the pixels."""
    from boxlens.operators.raster import forest

    rows = [(i, y, x, float((x * 31 + y * 17 + i) % 60 + 120)) for i in range(2) for y in range(5) for x in range(5)]
    out = forest.traces(spark.createDataFrame(rows, "image long, y long, x long, v double"), "v", [150.0], 0.94)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() > 0
