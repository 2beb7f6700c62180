"""Connected components of sparse masks, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...params import MaskRules
from ...session import checkpoint, large
from . import grid as G

BAND = 256


def _runs(mask: DataFrame, by: list[str]) -> DataFrame:
    """Horizontal runs of true pixels with an id that is unique inside a group: first pixel in row-major order."""
    line = Window.partitionBy(*by, "y").orderBy("x")
    rows = mask.select(*by, "y", "x").withColumn("_isle", F.col("x") - F.row_number().over(line))
    runs = rows.groupBy(*by, "y", "_isle").agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
    return runs.select(*by, "y", "x1", "x2", (F.shiftleft(F.col("y").cast("bigint"), 32) + F.col("x1")).alias("node"))


def _links(runs: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Pairs of runs in neighbouring rows that touch (``reach`` 1: also diagonally). Runs meet on bands of columns, so a
    long line does not pair all its runs; a pair is kept in the band of its leftmost contact only."""
    def bands(lo, hi):
        return F.explode(F.sequence(F.floor(lo / BAND), F.floor(hi / BAND)))

    up = runs.select(*by, "y", F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("node").alias("u")).withColumn(
        "_band", bands(F.col("a1") - reach, F.col("a2") + reach)
    )
    down = runs.select(*by, (F.col("y") - 1).alias("y"), F.col("x1").alias("b1"), F.col("x2").alias("b2"), F.col("node").alias("v")).withColumn(
        "_band", bands(F.col("b1"), F.col("b2"))
    )
    first = F.floor(F.greatest(F.col("a1") - reach, F.col("b1")) / BAND)
    met = up.join(down, [*by, "y", "_band"]).filter(
        (F.col("a1") - reach <= F.col("b2")) & (F.col("b1") <= F.col("a2") + reach) & (first == F.col("_band"))
    )
    return met.select(*by, "u", "v")


def components(mask: DataFrame, connectivity: int = 8, by: list[str] | None = None) -> DataFrame:
    """Label of every true pixel: the smallest run id of its component.

    Pixels collapse to row runs first. Labels then spread over the run graph by repeated minimum and pointer jumping, so
    the number of rounds grows with the logarithm of a component's length, not with the length. Each round is a
    distributed job and is stored in the checkpoint folder.
    """
    by = by or ["image"]
    runs = checkpoint(_runs(mask, by))
    links = _links(runs, by, 1 if connectivity == 8 else 0)
    edges = checkpoint(links.unionByName(links.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = runs.select(*by, "node", F.col("node").alias("label"))
    if not edges.isEmpty():
        while True:
            seen = edges.join(labels.select(*by, F.col("node").alias("v"), "label"), [*by, "v"])
            low = seen.groupBy(*by, F.col("u").alias("node")).agg(F.min("label").alias("low"))
            hooked = labels.join(low, [*by, "node"], "left").withColumn("next", F.least("label", "low"))
            # a whole cluster adopts the best label any of its members saw ...
            best = hooked.groupBy(*by, "label").agg(F.min("next").alias("root"))
            merged = hooked.join(best, [*by, "label"]).select(*by, "node", "label", "root").persist()
            # ... and then takes over the label of the node it points to
            ahead = merged.select(*by, F.col("node").alias("root"), F.col("root").alias("far"))
            jumped = checkpoint(
                merged.join(ahead, [*by, "root"]).select(*by, "node", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("moved"))
            )
            merged.unpersist()
            labels = jumped.select(*by, "node", "label")
            if jumped.filter("moved").isEmpty():
                break
    spans = runs.join(labels, [*by, "node"])
    return spans.select(*by, "y", F.explode(F.sequence("x1", "x2")).alias("x"), "label")


def component_sizes(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or ["image"]
    return labelled.groupBy(*by, "label").agg(F.count("*").alias("size"))


def hysteresis(pixels: DataFrame, weak: Column, strong: Column, by: list[str] | None = None) -> DataFrame:
    """Weak pixels whose component holds a strong one, with their label."""
    by = by or ["image"]
    flagged = pixels.filter(weak).select(*by, "y", "x", strong.alias("_strong"))
    lab = components(flagged, 8, by).join(flagged, [*by, "y", "x"])
    kept = lab.groupBy(*by, "label").agg(F.bool_or("_strong").alias("k")).filter("k").drop("k")
    return lab.drop("_strong").join(kept, [*by, "label"])


def strong_levels(scores: DataFrame, score: str, percentile: float, floor: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Strong level per image: a percentile of its scores, never below ``floor``."""
    by = by or ["image"]
    return scores.groupBy(*by).agg(F.greatest(F.percentile(score, F.lit(percentile / 100.0)), F.lit(float(floor))).alias("hi"))


def hysteresis_at_percentile(pixels: DataFrame, score: str, percentile: float = 97.0, lo_ratio: float = 0.5, floor: float = 20.0) -> DataFrame:
    lv = strong_levels(pixels, score, percentile, floor)
    j = pixels.join(lv, "image")
    return hysteresis(j, F.col(score) >= F.col("hi") * lo_ratio, F.col(score) >= F.col("hi"))


def hysteresis_levels(pixels: DataFrame, score: str, levels: list[float], lo_ratio: float) -> DataFrame:
    """Traces at many fixed strong levels at once; components are keyed by (image, level)."""
    each = pixels.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    return hysteresis(each, F.col(score) >= F.col("level") * lo_ratio, F.col(score) >= F.col("level"), ["image", "level"])


# --- masks --------------------------------------------------------------------------------------------------------


def _holes(pixels: DataFrame, mask: str) -> DataFrame:
    """Background pixels in areas that do not reach the frame, with the size of their area."""
    bg = pixels.filter(~F.col(mask)).select("image", "y", "x", "w", "h")
    lab = components(bg, 4).join(bg, G.KEY)
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1)
    inner = lab.groupBy("image", "label").agg(F.count("*").alias("size"), F.bool_or(edge).alias("_open")).filter(~F.col("_open")).drop("_open")
    return lab.join(inner, ["image", "label"]).select("image", "y", "x", "size", (F.col("w") * F.col("h")).alias("frame"))


def fill_holes(pixels: DataFrame, mask: str = "mask", max_ratio: float | None = None) -> DataFrame:
    """Fill background areas enclosed by the mask, up to ``max_ratio`` of the frame."""
    holes = _holes(pixels, mask)
    if max_ratio is not None:
        holes = holes.filter(F.col("size") <= F.col("frame") * max_ratio)
    filled = holes.select("image", "y", "x", F.lit(True).alias("_fill"))
    return pixels.join(filled, G.KEY, "left").withColumn(mask, F.col(mask) | F.coalesce(F.col("_fill"), F.lit(False))).drop("_fill")


def drop_small(pixels: DataFrame, mask: str = "mask", min_ratio: float = 0.01) -> DataFrame:
    on = pixels.filter(F.col(mask)).select("image", "y", "x", (F.col("w") * F.col("h")).alias("frame"))
    lab = components(on, 8).join(on, G.KEY)
    big = lab.groupBy("image", "label").agg(F.count("*").alias("size"), F.max("frame").alias("frame")).filter(F.col("size") >= F.col("frame") * min_ratio)
    kept = lab.join(big.select("image", "label"), ["image", "label"], "left_semi").select("image", "y", "x", F.lit(True).alias("_keep"))
    return pixels.join(kept, G.KEY, "left").withColumn(mask, F.coalesce(F.col("_keep"), F.lit(False))).drop("_keep")


def refine_mask(pixels: DataFrame, mask: str = "mask", close: int = 7, open_: int = 5, hole_ratio: float | None = 0.02, min_ratio: float = 0.01) -> DataFrame:
    """Close, open, fill small holes, drop small parts."""
    out = pixels.withColumn("_m", F.col(mask).cast("int"))
    if close > 1:
        out = G.closed(out, "_m", G.ellipse_spans(close))
    if open_ > 1:
        out = G.opened(out, "_m", G.ellipse_spans(open_))
    out = checkpoint(out.withColumn(mask, F.col("_m") == 1).drop("_m"))
    return drop_small(fill_holes(out, mask, hole_ratio), mask, min_ratio)


def mask_metrics(pixels: DataFrame, mask: str = "mask", seeds: DataFrame | None = None) -> DataFrame:
    """Area, largest-part and hole ratios of each image's mask, and the share of seeds (image, x, y) on it."""
    base = pixels.groupBy("image").agg(F.count_if(mask).alias("road_pixels"), F.count("*").alias("_all"))
    on = pixels.filter(F.col(mask)).select("image", "y", "x")
    parts = component_sizes(components(on, 8)).groupBy("image").agg(F.max("size").alias("_max"), F.count("*").alias("n_components"))
    holes = _holes(pixels, mask).groupBy("image").agg(F.count("*").alias("_h"))
    j = base.join(parts, "image", "left").join(holes, "image", "left").fillna(0, ["_h", "n_components"])
    if seeds is None:
        j = j.withColumns({"n_seeds": F.lit(0).cast("bigint"), "_in": F.lit(0).cast("bigint")})
    else:
        at = seeds.select("image", F.bround("x", 0).cast("bigint").alias("x"), F.bround("y", 0).cast("bigint").alias("y"))
        hit = at.join(on.withColumn("_on", F.lit(1)), G.KEY, "left").groupBy("image").agg(F.count("*").alias("n_seeds"), F.count("_on").alias("_in"))
        j = j.join(hit, "image", "left").fillna(0, ["n_seeds", "_in"])
    some = F.col("road_pixels") > 0
    return j.select(
        "image", "road_pixels", "n_components", "n_seeds", (F.col("road_pixels") / F.col("_all")).alias("mask_area_ratio"),
        F.when(some, F.col("_max") / F.col("road_pixels")).alias("largest_component_ratio"),
        F.when(some, F.col("_h") / (F.col("road_pixels") + F.col("_h"))).alias("hole_ratio"),
        F.when(F.col("n_seeds") > 0, F.col("_in") / F.col("n_seeds")).alias("seed_consistency"),
    )


def validate_mask(metrics: DataFrame, rules: MaskRules = MaskRules()) -> DataFrame:
    """PASS or FAIL with the reasons, as text with the offending value."""
    reasons = [
        F.when(F.coalesce(F.col("n_seeds"), F.lit(0)) == 0, F.lit("no_seed")),
        F.when(F.coalesce(F.col("road_pixels"), F.lit(0)) == 0, F.lit("empty_mask")),
    ]
    warnings = []
    for name in ("mask_area_ratio", "largest_component_ratio", "hole_ratio", "seed_consistency"):
        low, high = getattr(rules, f"{name}_min", None), getattr(rules, f"{name}_max", None)
        if low is None and high is None:
            continue
        missing = F.when(F.col(name).isNull(), F.lit(f"{name}:undefined"))
        (reasons if rules.undefined_metric_policy == "fail" else warnings).append(missing)
        if low is not None:
            reasons.append(F.when(F.col(name) < low, F.format_string(f"{name}<{low} (%.4f)", F.bround(F.col(name), 4))))
        if high is not None:
            reasons.append(F.when(F.col(name) > high, F.format_string(f"{name}>{high} (%.4f)", F.bround(F.col(name), 4))))
    why = F.array_compact(F.array(*reasons))
    soft = F.array_compact(F.array(*warnings)) if warnings else F.array().cast("array<string>")
    return metrics.withColumns({"fail_reasons": why, "warnings": soft, "status": F.when(F.size(why) == 0, "PASS").otherwise("FAIL")})


def final_mask(candidates: DataFrame, manual: DataFrame, verdicts: DataFrame, min_ratio: float = 0.001, use_candidate: bool = True) -> DataFrame:
    """Which mask each image goes on with, and the pixels of that mask.

    ``candidates``: automatic mask on pixel rows (mask column); ``manual``: true pixels (image, y, x) of hand-made masks;
    ``verdicts``: image, status. A manual mask wins when it covers ``min_ratio`` of the frame; a smaller one is an error.
    """
    frame = candidates.groupBy("image").agg(F.count("*").alias("_all"), F.count_if("mask").alias("_auto"))
    drawn = manual.groupBy("image").agg(F.count("*").alias("_man"))
    j = frame.join(drawn, "image", "left").join(verdicts.select("image", "status"), "image", "left")
    source = (
        F.when(F.col("_man").isNotNull() & (F.col("_man") / F.col("_all") < min_ratio), "error_manual_too_small")
        .when(F.col("_man").isNotNull(), "manual").when(F.col("status") == "PASS", "auto")
        .when(F.lit(use_candidate) & (F.col("_auto") > 0), "auto_candidate_unverified").otherwise("skipped_manual_required")
    )
    plan = j.select("image", source.alias("source"))
    chosen = candidates.join(plan, "image")
    hand = manual.select("image", "y", "x", F.lit(True).alias("_hand"))
    out = chosen.join(hand, G.KEY, "left")
    mask = F.when(F.col("source") == "manual", F.coalesce(F.col("_hand"), F.lit(False))).when(
        F.col("source").isin("auto", "auto_candidate_unverified"), F.col("mask")
    ).otherwise(False)
    return out.withColumn("mask", mask).drop("_hand")


def polygon_mask(frame: DataFrame, points: DataFrame, name: str = "mask") -> DataFrame:
    """Pixels whose centre lies inside the polygon of their image, edges included; fewer than three points give nothing.

    Per scanline the crossings with the polygon's edges are sorted and paired into spans: work grows with the edges'
    heights, not with pixels times edges. ``points`` has image, ord, x, y.
    """
    ring = Window.partitionBy("image").orderBy("ord")
    whole = Window.partitionBy("image")
    p = points.select(
        "image", "ord", F.bround("x", 0).alias("x"), F.bround("y", 0).alias("y"), F.count("*").over(whole).alias("_n"),
        F.bround(F.coalesce(F.lead("x").over(ring), F.first("x").over(ring)), 0).alias("nx"),
        F.bround(F.coalesce(F.lead("y").over(ring), F.first("y").over(ring)), 0).alias("ny"),
    ).filter("_n >= 3")
    low, high = F.least("y", "ny"), F.greatest("y", "ny")
    f = frame.select("image", "w", "h")
    # every edge is closed at its upper end and open at its lower one, so a vertex on a scanline counts once
    cross = p.filter("y <> ny").withColumn("_y", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint") - 1))).select(
        "image", F.col("_y").alias("y"), (F.col("x") + (F.col("_y") - F.col("y")) / (F.col("ny") - F.col("y")) * (F.col("nx") - F.col("x"))).alias("cx")
    )
    order = Window.partitionBy("image", "y").orderBy("cx")
    pairs = cross.withColumns({"_i": F.row_number().over(order), "_to": F.lead("cx").over(order)}).filter("_i % 2 = 1 AND _to IS NOT NULL")
    spans = pairs.select("image", "y", F.ceil(F.col("cx") - 1e-9).cast("bigint").alias("a"), F.floor(F.col("_to") + 1e-9).cast("bigint").alias("b"))
    # the edges themselves belong to the polygon: each contributes its own pixels
    steps = F.greatest(F.abs(F.col("nx") - F.col("x")), F.abs(F.col("ny") - F.col("y")), F.lit(1.0))
    line = p.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), steps.cast("bigint")))).select(
        "image", F.bround(F.col("y") + (F.col("ny") - F.col("y")) * F.col("_k") / steps, 0).cast("bigint").alias("y"),
        F.bround(F.col("x") + (F.col("nx") - F.col("x")) * F.col("_k") / steps, 0).cast("bigint").alias("x"),
    )
    filled = spans.filter("b >= a").select("image", "y", F.explode(F.sequence("a", "b")).alias("x"))
    inside = filled.unionByName(line).distinct().join(f, "image").filter("x >= 0 AND y >= 0 AND x < w AND y < h")
    return inside.select("image", "y", "x", F.lit(True).alias(name))


def combine_masks(base: DataFrame, drawn: DataFrame, mode: str, mask: str = "mask") -> DataFrame:
    """``base`` pixel rows with a mask column, combined with drawn true pixels: replace, add or subtract."""
    if mode not in ("replace", "add", "subtract"):
        raise ValueError(f"unknown mode {mode}")
    hand = drawn.select("image", "y", "x", F.lit(True).alias("_d"))
    j = base.join(hand, G.KEY, "left")
    d = F.coalesce(F.col("_d"), F.lit(False))
    new = {"replace": d, "add": F.col(mask) | d, "subtract": F.col(mask) & ~d}[mode]
    return j.withColumn(mask, new).drop("_d")


# --- shapes -------------------------------------------------------------------------------------------------------


def principal_axes(points: DataFrame, by: list[str]) -> DataFrame:
    """Centre, covariance eigenvalues and major-axis angle of each group of pixels, from sums combined map-side."""
    g = points.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"),
    )
    d = F.sqrt((F.col("sxx") - F.col("syy")) * (F.col("sxx") - F.col("syy")) + 4 * F.col("sxy") * F.col("sxy"))
    return g.withColumns({
        "major": (F.col("sxx") + F.col("syy") + d) / 2, "minor": F.greatest((F.col("sxx") + F.col("syy") - d) / 2, F.lit(0.0)),
        "theta": F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2,
    }).drop("sxx", "syy", "sxy")


def shape_features(points: DataFrame, by: list[str] | None = None, score: str | None = None, hi: Column | None = None) -> DataFrame:
    """Box, area, length, width, elongation and contrast of each component.

    Length and breadth are the extents along the principal axes plus one pixel; they stand in for the sides of the
    smallest rotated rectangle and differ slightly for bent shapes.
    """
    by = by or ["image", "label"]
    axes = principal_axes(points, by).select(*by, "theta")
    j = points.join(axes, by)
    u = F.col("x") * F.cos("theta") + F.col("y") * F.sin("theta")
    v = -F.col("x") * F.sin("theta") + F.col("y") * F.cos("theta")
    strength = F.avg(score).alias("_s") if score else F.lit(0.0).alias("_s")
    g = j.groupBy(*by).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        F.count("*").cast("double").alias("area"), (F.max(u) - F.min(u) + 1).alias("_a"), (F.max(v) - F.min(v) + 1).alias("_b"), strength,
    )
    length, breadth = F.greatest("_a", "_b"), F.least("_a", "_b")
    contrast = F.col("_s") / hi if hi is not None else F.col("_s")
    return g.select(
        *by, "x", "y", "w", "h", "area", length.alias("length"), (F.col("area") / length).alias("width"), (length / breadth).alias("elong"),
        contrast.alias("contrast"),
    )


def line_residual(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """RMS distance of a component's pixels to its best straight line."""
    by = by or ["image", "label"]
    return principal_axes(points, by).select(*by, F.sqrt("minor").alias("resid"))


def piece_endpoints(trace: DataFrame, radius: int = 6, min_pixels: int = 5) -> DataFrame:
    """Ends of thin pieces: pixels with one 8-neighbour, their outward direction from the piece's nearby pixels, and the
    piece's principal angle in degrees. ``trace`` has image, y, x, label."""
    big = trace.join(
        large(trace.groupBy("image", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pixels).select("image", "label")), ["image", "label"]
    )
    pts = big.select("image", "y", "x", "label")

    def around(df, r):
        moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1)])
        return df.withColumn("_m", F.explode(moves)).select(
            "image", "label", F.col("y").alias("ey"), F.col("x").alias("ex"), (F.col("y") + F.col("_m.dy")).alias("y"), (F.col("x") + F.col("_m.dx")).alias("x")
        )

    near = around(pts, 1).join(large(pts), ["image", "label", "y", "x"]).groupBy("image", "label", "ey", "ex").agg(F.count("*").alias("k"))
    ends = near.filter("k = 2").select("image", "label", F.col("ey").alias("y"), F.col("ex").alias("x"))
    mean = around(ends, radius).join(large(pts), ["image", "label", "y", "x"]).groupBy("image", "label", "ey", "ex").agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")
    )
    dx, dy = F.col("ex") - F.col("mx"), F.col("ey") - F.col("my")
    size = F.hypot(dx, dy)
    out = mean.filter((F.col("n") >= 3) & (size >= 1e-3))
    angle = principal_axes(pts, ["image", "label"]).select("image", "label", F.pmod(F.degrees("theta"), F.lit(180.0)).alias("angle"))
    return out.join(large(angle), ["image", "label"]).select(
        "image", "label", F.col("ey").alias("y"), F.col("ex").alias("x"), (F.col("ey") * 1000000 + F.col("ex")).alias("pid"),
        (dx / size).alias("ux"), (dy / size).alias("uy"), "angle",
    )


# --- components in boxes ------------------------------------------------------------------------------------------


def spans_in_boxes(trace: DataFrame, boxes: DataFrame, tile: float = 64.0) -> DataFrame:
    """Per box the longest pixel count and the longest extent of the trace parts inside it, over the box's long side.

    The trace is cut to each box before parts are formed. ``boxes`` has image, did, x1..y2; boxes under 2 px on a side give
    NULL.
    """
    from ..geometry import pixels_in_boxes

    whole = boxes.select("image", "did", *[F.bround(c, 0).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    inside = pixels_in_boxes(trace.select("image", "y", "x"), whole, tile=tile).select("image", "did", "y", "x")
    lab = components(inside, 8, ["image", "did"])
    parts = lab.groupBy("image", "did", "label").agg(
        F.count("*").alias("n"), F.greatest(F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1).alias("s")
    ).groupBy("image", "did").agg(F.max("n").alias("n"), F.max("s").alias("s"))
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    ok = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= 2
    return whole.join(parts, ["image", "did"], "left").select(
        "image", "did", F.when(ok, F.coalesce(F.col("n"), F.lit(0)) / side).alias("longest"), F.when(ok, F.coalesce(F.col("s"), F.lit(0)) / side).alias("span"),
        F.coalesce(F.when(ok, F.col("n").isNull()), F.lit(True)).alias("empty"),
    )


def box_state(labelled: DataFrame, boxes: DataFrame, by: list[str] | None = None, tile: float = 64.0) -> DataFrame:
    """M when a component spans half the box's long side and lies half inside it; overflow when one spans but sticks out;
    short otherwise. ``labelled`` holds components of the whole trace, boxes may be truths or controls."""
    from ..geometry import pixels_in_boxes

    by = by or ["image"]
    b = boxes.select(
        "image", "did", *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")],
        F.greatest(F.floor("x1"), F.lit(0)).cast("double").alias("x1"), F.greatest(F.floor("y1"), F.lit(0)).cast("double").alias("y1"),
        F.ceil("x2").cast("double").alias("x2"), F.ceil("y2").cast("double").alias("y2"),
    )
    sized = b.withColumn("side", F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).filter(
        F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= 2
    )
    whole = labelled.groupBy(*by, "label").agg(F.min("x").alias("cx1"), F.min("y").alias("cy1"), (F.max("x") + 1).alias("cx2"), (F.max("y") + 1).alias("cy2"))
    inside = pixels_in_boxes(labelled, sized, tile=tile).groupBy(*by, "did", "label", "side", "_x1", "_y1", "_x2", "_y2").agg(
        F.greatest(F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1).alias("s")
    ).filter(F.col("s") / F.col("side") >= 0.5).join(large(whole), [*by, "label"])
    iw = F.greatest(F.least("cx2", "_x2") - F.greatest("cx1", "_x1"), F.lit(0.0))
    ih = F.greatest(F.least("cy2", "_y2") - F.greatest("cy1", "_y1"), F.lit(0.0))
    area = F.greatest((F.col("cx2") - F.col("cx1")) * (F.col("cy2") - F.col("cy1")), F.lit(1.0))
    best = inside.groupBy(*by, "did").agg(F.max(F.when(iw * ih >= 0.5 * area, 2).otherwise(1)).alias("r"))
    extra = [c for c in by if c != "image"]
    if extra:
        # a box without any spanning part still gets a row per level
        sized = sized.join(large(labelled.select(*by).distinct()), "image")
    out = sized.join(large(best), [*by, "did"], "left")
    return out.select(*by, "did", F.when(F.col("r") == 2, "M").when(F.col("r") == 1, "overflow").otherwise("short").alias("state"))
