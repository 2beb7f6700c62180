"""Cues measured around candidates: rings, road reference, roughness, contrast, surroundings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import boxes as B
from ..geometry import pixels_in_boxes
from . import grid as G
from .colour import chroma_plane, hsv, hue_plane
from .components import components, principal_axes, shape_features

OUTER, INNER = ("ox1", "oy1", "ox2", "oy2"), ("ix1", "iy1", "ix2", "iy2")


def _median(c) -> Column:
    return F.percentile(c, F.lit(0.5))


def _p(c, q) -> Column:
    return F.percentile(c, F.lit(q))


def ring_pixels(pixels: DataFrame, rings: DataFrame, values: list[str], tile: float = 64.0) -> DataFrame:
    """Pixels of every ring: inside the outer box, outside the inner one. ``rings`` has image, did and both boxes."""
    px = pixels.select("image", "y", "x", *values)
    inside = pixels_in_boxes(px, rings.select("image", "did", *OUTER, *INNER), OUTER, tile)
    hole = (F.col("x") >= F.col("ix1")) & (F.col("x") < F.col("ix2")) & (F.col("y") >= F.col("iy1")) & (F.col("y") < F.col("iy2"))
    return inside.filter(~hole).drop(*OUTER, *INNER)


def box_pixels(pixels: DataFrame, boxes: DataFrame, values: list[str], box: B.Box = B.DET_BOX, tile: float = 64.0) -> DataFrame:
    return pixels_in_boxes(pixels.select("image", "y", "x", *values), boxes.select("image", "did", *box), box, tile).drop(*box)


def structure_tensor(pixels: DataFrame, gray: str = "gray", sigma: float = 4.0, radius: int | None = None) -> DataFrame:
    """Averaged gradient products and, from them, energy, coherence and the smaller eigenvalue."""
    g = G.sobel(pixels, gray).withColumns({"ta": F.col("gx") * F.col("gx"), "tb": F.col("gx") * F.col("gy"), "tc": F.col("gy") * F.col("gy")}).drop("gx", "gy")
    t = G.gaussian(g, ["ta", "tb", "tc"], sigma, radius)
    root = F.sqrt((F.col("ta") - F.col("tc")) * (F.col("ta") - F.col("tc")) + F.col("tb") * F.col("tb") * 4)
    big, small = (F.col("ta") + F.col("tc") + root) / 2, F.greatest((F.col("ta") + F.col("tc") - root) / 2, F.lit(0.0))
    out = t.withColumns({"_l1": big, "l2": small}).withColumn("energy", F.col("_l1") + F.col("l2"))
    share = (F.col("_l1") - F.col("l2")) / F.greatest("energy", F.lit(1e-6))
    return out.withColumn("coherence", F.when(F.col("energy") > 1e-6, share * share).otherwise(0.0)).drop("_l1")


def cue_maps(pixels: DataFrame, sigma: float = 4.0, radius: int | None = None) -> DataFrame:
    """Colour plane, value and structure maps from b, g, r and gray columns."""
    return structure_tensor(pixels.withColumns(hsv()).withColumns(hue_plane()), "gray", sigma, radius)


CUE_COLUMNS = ["cx", "cy", "val", "energy", "coherence", "l2"]


def reference_stats(maps: DataFrame) -> DataFrame:
    """The image's own road sample: rows 60-80 %, columns 30-70 %."""
    window = (
        (F.col("y") >= F.floor(F.col("h") * 0.60)) & (F.col("y") < F.floor(F.col("h") * 0.80))
        & (F.col("x") >= F.floor(F.col("w") * 0.30)) & (F.col("x") < F.floor(F.col("w") * 0.70))
    )
    s = maps.filter(window)
    g = s.groupBy("image").agg(
        _median("cx").alias("cmx"), _median("cy").alias("cmy"), _median("val").alias("vmed"), F.greatest(_p("val", 0.75) - _p("val", 0.25), F.lit(5.0)).alias("viqr"),
        F.greatest(_median("energy"), F.lit(1e-3)).alias("emed"), F.avg("coherence").alias("cohm"), F.greatest(_median("l2"), F.lit(1e-3)).alias("l2med"),
    )
    far = s.join(g.select("image", "cmx", "cmy"), "image").groupBy("image").agg(
        F.greatest(_median(F.hypot(F.col("cx") - F.col("cmx"), F.col("cy") - F.col("cmy"))), F.lit(0.02)).alias("cspread")
    )
    return g.join(far, "image")


def ring_cues(maps: DataFrame, det: DataFrame, stats: DataFrame, min_ring: int = 20) -> DataFrame:
    """How unlike the road sample a candidate's surroundings are. Rings under ``min_ring`` pixels give no row.

    ``det`` has image, did, x1..y2 and the frame size w, h.
    """
    rings = det.select("image", "did", *[c.alias(n) for n, c in B.ring_double(B.DET_BOX, F.col("w").cast("double"), F.col("h").cast("double")).items()])
    px = ring_pixels(maps, rings, CUE_COLUMNS)
    g = px.groupBy("image", "did").agg(
        F.count("*").alias("n"), *[_median(c).alias(f"m_{c}") for c in ("cx", "cy", "val", "energy", "l2")], F.avg("coherence").alias("m_coh")
    ).filter(F.col("n") >= min_ring).join(stats, "image")
    return g.select(
        "image", "did", (F.hypot(F.col("m_cx") - F.col("cmx"), F.col("m_cy") - F.col("cmy")) / F.col("cspread")).alias("color"),
        (F.abs(F.col("m_val") - F.col("vmed")) / F.col("viqr")).alias("bright"),
        F.abs(F.log(F.greatest("m_energy", F.lit(1e-3)) / F.col("emed"))).alias("energy"), (F.col("m_coh") - F.col("cohm")).alias("coherence"),
        F.log(F.greatest("m_l2", F.lit(1e-3)) / F.col("l2med")).alias("corner"),
    )


def onroad_cues(maps: DataFrame, points: DataFrame, det: DataFrame, smooth: str = "smooth", score: str = "score", strong: Column | None = None, big: list[str] = []) -> DataFrame:
    """Depth of a candidate under its ring, how far it follows the ring's texture, its strong share, its score against
    the ring's 95th percentile, and its persistence at larger scales (columns ``big``).

    ``maps`` carries ta, tb, tc, the smoothed gray, the score and any large-scale scores; ``points`` is image, did, y, x.
    """
    rings = det.select("image", "did", *[c.alias(n) for n, c in B.ring_double(B.DET_BOX, F.col("w").cast("double"), F.col("h").cast("double")).items()])
    around = ring_pixels(maps, rings, [smooth, "ta", "tb", "tc", score]).groupBy("image", "did").agg(
        _median(smooth).alias("rm"), (_p(smooth, 0.75) - _p(smooth, 0.25)).alias("riqr"), F.sum("ta").alias("a"), F.sum("tb").alias("b"), F.sum("tc").alias("c"),
        _p(score, 0.95).alias("r95"),
    )
    on = points.select("image", "did", "y", "x").join(maps.select("image", "y", "x", smooth, score, *big), G.KEY)
    hit = strong if strong is not None else F.lit(False)
    own = on.groupBy("image", "did").agg(
        F.avg(smooth).alias("om"), F.avg(score).alias("os"), F.avg(hit.cast("int")).alias("strong"), *[F.avg(c).alias(f"b_{c}") for c in big]
    )
    line = principal_axes(points, ["image", "did"]).select("image", "did", "theta")
    j = own.join(around, ["image", "did"]).join(line, ["image", "did"])
    root = F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) + F.col("b") * F.col("b") * 4) / F.greatest(F.col("a") + F.col("c"), F.lit(1e-6))
    grain = F.atan2(F.col("b") * 2, F.col("a") - F.col("c")) / 2 + F.lit(3.141592653589793 / 2)
    along = F.cos(F.col("theta") - grain)
    return j.select(
        "image", "did", ((F.col("rm") - F.col("om")) / F.greatest("riqr", F.lit(2.0))).alias("depth"), (root * root * along * along).alias("streak"), "strong",
        (F.col("os") / F.greatest("r95", F.lit(1e-3))).alias("snr"), *[(F.col(f"b_{c}") / F.greatest("os", F.lit(1e-3))).alias(f"persist_{c}") for c in big],
    )


# --- roughness ----------------------------------------------------------------------------------------------------


def roughness(pixels: DataFrame, gray: str = "gray", k: int = 21, sigma: float = 1.0, radius: int | None = None, name: str = "rough") -> DataFrame:
    """Local mean of the gradient magnitude."""
    g = G.gradient_magnitude(pixels, gray, sigma, radius, "_grad")
    return G.box_mean(g, {name: "_grad"}, k).drop("_grad")


def row_robust_z(pixels: DataFrame, rough: str = "rough", band: int = 15, name: str = "z") -> DataFrame:
    """Roughness against the road at the same height: per row median and MAD, smoothed over neighbouring rows."""
    rows = pixels.groupBy("image", "y", "h").agg(_median(rough).alias("med"))
    spread = pixels.join(rows.select("image", "y", "med"), ["image", "y"]).groupBy("image", "y").agg(
        (_median(F.abs(F.col(rough) - F.col("med"))) * 1.4826 + 1e-3).alias("mad")
    )
    line = rows.join(spread, ["image", "y"]).withColumns({"x": F.lit(0).cast("bigint"), "w": F.lit(1).cast("bigint")})
    flat = [1.0 / band] * band
    smooth = G.sep(line, "y", {"_med": ("med", flat), "_mad": ("mad", flat)}).select("image", "y", "_med", "_mad")
    return pixels.join(smooth, ["image", "y"]).withColumn(name, (F.col(rough) - F.col("_med")) / F.col("_mad")).drop("_med", "_mad")


def ring_ratio(pixels: DataFrame, rough: str = "rough", mask: str | None = None, rings=((41, 121), (121, 361)), min_cover: float = 0.3, name: str = "ratio") -> DataFrame:
    """Roughness over the mean roughness of the road in a ring around, the larger of several rings; 0 off the mask and
    where too little of the ring is road. Rings are differences of box sums."""
    m = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    out = pixels.withColumn("_m", m).withColumn("_em", F.col(rough) * F.col("_m"))
    for k in sorted({k for pair in rings for k in pair}):
        out = G.box_sum(out, {f"_e{k}": "_em", f"_n{k}": "_m"}, k)
    best = F.lit(0.0)
    for a, b in rings:
        n = F.col(f"_n{b}") - F.col(f"_n{a}")
        mean = (F.col(f"_e{b}") - F.col(f"_e{a}")) / F.greatest(n, F.lit(1.0)) + 1e-3
        best = F.greatest(best, F.when(n >= min_cover * (b * b - a * a), F.col(rough) / mean).otherwise(0.0))
    temp = [f"_{t}{k}" for t in "en" for k in {k for pair in rings for k in pair}]
    return out.withColumn(name, best * F.col("_m")).drop("_m", "_em", *temp)


def rough_candidates(pixels: DataFrame, on: Column, min_frac: float = 0.0006, max_frac: float = 0.08, open_k: int = 5) -> DataFrame:
    """Boxes of the opened mask's components whose area lies in the allowed share of the frame."""
    m = G.opened(pixels.withColumn("_on", on.cast("int")), "_on", G.rect_spans(open_k)).filter("_on = 1")
    lab = components(m, 8).join(m.select("image", "y", "x", "w", "h"), G.KEY)
    g = lab.groupBy("image", "label", "w", "h").agg(
        F.count("*").alias("area"), F.min("x").cast("double").alias("x1"), F.min("y").cast("double").alias("y1"),
        (F.max("x") + 1).cast("double").alias("x2"), (F.max("y") + 1).cast("double").alias("y2"),
    )
    frame = F.col("w") * F.col("h")
    return g.filter((F.col("area") >= frame * min_frac) & (F.col("area") <= frame * max_frac)).withColumnRenamed("label", "did")


def box_cues(pixels: DataFrame, det: DataFrame, gray: str = "gray") -> DataFrame:
    """Colour difference to the ring (x 100), how much darker the darkest tenth is, aspect and height, and the extra
    contrast, texture and gradient ratios. ``pixels`` has b, g, r, gray and optionally grad; small boxes give no row."""
    has_grad = "grad" in pixels.columns
    px = pixels.withColumns(chroma_plane())
    values = [gray, "cr", "cg"] + (["grad"] if has_grad else [])
    rings = det.select("image", "did", *[c.alias(n) for n, c in B.ring_half(B.DET_BOX, F.col("w").cast("double"), F.col("h").cast("double")).items()])

    def stats(df, tag):
        return df.groupBy("image", "did").agg(
            F.count("*").alias(f"n_{tag}"), _p(gray, 0.1).alias(f"p10_{tag}"), _median(gray).alias(f"med_{tag}"), (_p(gray, 0.75) - _p(gray, 0.25)).alias(f"iqr_{tag}"),
            F.stddev_pop(gray).alias(f"std_{tag}"), _median("cr").alias(f"cr_{tag}"), _median("cg").alias(f"cg_{tag}"),
            *([F.avg("grad").alias(f"grad_{tag}")] if has_grad else []),
        )

    inner, outer = stats(box_pixels(px, det, values), "i"), stats(ring_pixels(px, rings, values), "o")
    big = (F.col("x2") - F.col("x1") >= 4) & (F.col("y2") - F.col("y1") >= 4) & (F.col("n_o") >= 20)
    j = det.join(inner, ["image", "did"]).join(outer, ["image", "did"]).filter(big)
    iqr = F.greatest("iqr_o", F.lit(1.0))
    bw, bh = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    extra = [(F.col("grad_i") / F.greatest("grad_o", F.lit(1e-3))).alias("grad")] if has_grad else []
    return j.select(
        *det.columns, (F.hypot(F.col("cr_i") - F.col("cr_o"), F.col("cg_i") - F.col("cg_o")) * 100).alias("chroma"),
        ((F.col("p10_o") - F.col("p10_i")) / iqr).alias("dark_p10"), (F.greatest(bw, bh) / F.greatest(F.lit(1.0), F.least(bw, bh))).alias("aspect"),
        ((F.col("y1") + F.col("y2")) / 2 / F.col("h")).alias("rel_y"), ((F.col("med_o") - F.col("med_i")) / iqr).alias("dark"),
        (F.col("std_i") / F.greatest("std_o", F.lit(1e-3))).alias("tex"), *extra,
    )


def box_contrast(pixels: DataFrame, det: DataFrame, gray: str = "gray") -> DataFrame:
    """Darkest twentieth and median of a box against the median of a band around it."""
    whole = det.join(pixels.select("image", "w", "h").distinct(), "image").select(
        "image", "did", "w", "h", F.greatest(F.bround("x1", 0), F.lit(0.0)).alias("x1"), F.greatest(F.bround("y1", 0), F.lit(0.0)).alias("y1"),
        F.least(F.bround("x2", 0), F.col("w").cast("double")).alias("x2"), F.least(F.bround("y2", 0), F.col("h").cast("double")).alias("y2"),
    ).filter((F.col("x2") - F.col("x1") >= 2) & (F.col("y2") - F.col("y1") >= 2))
    m = F.greatest(F.lit(8.0), F.floor(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * 0.3))
    zero = F.lit(0.0)
    rings = whole.select(
        "image", "did", F.greatest(zero, F.col("x1") - m).alias("ox1"), F.greatest(zero, F.col("y1") - m).alias("oy1"),
        F.least(F.col("w").cast("double"), F.col("x2") + m).alias("ox2"), F.least(F.col("h").cast("double"), F.col("y2") + m).alias("oy2"),
        F.col("x1").alias("ix1"), F.col("y1").alias("iy1"), F.col("x2").alias("ix2"), F.col("y2").alias("iy2"),
    )
    out = ring_pixels(pixels, rings, [gray]).groupBy("image", "did").agg(F.count("*").alias("_n"), _median(gray).alias("ref")).filter("_n >= 20")
    inner = box_pixels(pixels, whole, [gray]).groupBy("image", "did").agg(_p(gray, 0.05).alias("_p5"), _median(gray).alias("_m"))
    return inner.join(out, ["image", "did"]).select("image", "did", (F.col("_p5") - F.col("ref")).alias("dark"), (F.col("_m") - F.col("ref")).alias("median"), "ref")


def percolate(pixels: DataFrame, points: DataFrame, det: DataFrame, gray: str = "gray") -> DataFrame:
    """Dark surroundings connected to a candidate: their size against its own, and their elongation."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    ring = B.ring_grown(B.DET_BOX, w, h, 2.0, 4.0)
    window = det.select("image", "did", *[ring[c].alias(n) for c, n in zip(OUTER, B.DET_BOX)])
    inside = box_pixels(pixels, window, [gray])
    q = inside.groupBy("image", "did").agg(_p(gray, 0.25).alias("q1"), _median(gray).alias("med"), _p(gray, 0.75).alias("q3"))
    own = points.select("image", "did", "y", "x", F.lit(True).alias("_own"))
    dark = inside.join(q, ["image", "did"]).join(own, ["image", "did", "y", "x"], "left").withColumn("_own", F.coalesce("_own", F.lit(False)))
    kept = dark.filter(F.col("_own") | (F.col(gray) < F.col("med") - (F.col("q3") - F.col("q1")) * 0.5)).select("image", "did", "y", "x", "_own")
    lab = components(kept, 8, ["image", "did"]).join(kept, ["image", "did", "y", "x"])
    seeds = lab.filter("_own").select("image", "did", "label").distinct()
    region = lab.join(seeds, ["image", "did", "label"], "left_semi")
    shape = shape_features(region, ["image", "did"]).select("image", "did", "area", "elong")
    size = points.groupBy("image", "did").agg(F.count("*").alias("n"))
    return shape.join(size, ["image", "did"]).select("image", "did", (F.col("area") / F.col("n")).alias("perc_spread"), F.col("elong").alias("perc_elong"))


def _median_of_tile(cols: list[str], radius: int, tile: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        w, h, y0, x0 = int(first["w"]), int(first["h"]), int(first["ty"]) * tile, int(first["tx"]) * tile
        y1, x1 = min(h, y0 + tile), min(w, x0 + tile)
        # the frame repeats its border pixels outwards
        ys, xs = (np.clip(np.arange(a - radius, b + radius), 0, top - 1) for a, b, top in ((y0, y1, h), (x0, x1, w)))
        top, left = ys[0], xs[0]
        at = part["y"].to_numpy() - top, part["x"].to_numpy() - left
        here = np.mgrid[y0:y1, x0:x1].reshape(2, -1)
        out = {"image": np.full(here.shape[1], first["image"]), "y": here[0], "x": here[1]}
        k = 2 * radius + 1
        for c in cols:
            plane = np.zeros((ys[-1] - top + 1, xs[-1] - left + 1))
            plane[at] = part[c].to_numpy()
            values, rank = np.unique(plane[ys - top][:, xs - left], return_inverse=True)
            rank = rank.reshape(len(ys), len(xs))
            # the middle rank of every window, bisected: counts of ranks up to a middle come from summed areas
            low, high = np.zeros((y1 - y0, x1 - x0), np.int64), np.full((y1 - y0, x1 - x0), len(values) - 1)
            while (low < high).any():
                middle = (low + high) // 2
                enough = np.zeros(middle.shape, bool)
                for m in np.unique(middle[low < high]):
                    area = np.zeros((len(ys) + 1, len(xs) + 1), np.int64)
                    area[1:, 1:] = (rank <= m).cumsum(axis=0).cumsum(axis=1)
                    count = area[k:, k:] - area[:-k, k:] - area[k:, :-k] + area[:-k, :-k]
                    enough |= (middle == m) & (count > k * k // 2)
                low, high = np.where(enough | (low == high), low, middle + 1), np.where(enough, middle, high)
            out[f"bg_{c}"] = values[low].reshape(-1)
        return pd.DataFrame(out)

    return run


def window_median(pixels: DataFrame, cols: list[str], radius: int, tile: int = 64) -> DataFrame:
    """``image, y, x, bg_<col>``: the exact median over the (2 radius + 1)^2 window, border pixels repeated outwards.

    Each pixel goes to the tiles whose margin it lies in, so an image of any size is spread and a task holds one tile.  A median is bisected over
    the tile's values, and each step counts by summed areas: its work does not grow with the window.  The frame must be complete.
    """
    wide = [c for c in cols]
    span = lambda c, size: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - radius) / tile), F.lit(0)), F.least(F.floor((F.col(c) + radius) / tile), F.floor((F.col(size) - 1) / tile))))
    dealt = pixels.select("image", "y", "x", "w", "h", *[F.col(c).cast("double") for c in wide]).withColumn("ty", span("y", "h")).withColumn("tx", span("x", "w"))
    schema = "image bigint, y bigint, x bigint, " + ", ".join(f"bg_{c} double" for c in wide)
    return dealt.groupBy("image", "ty", "tx").applyInPandas(_median_of_tile(wide, radius, tile), schema)


def channel_outliers(pixels: DataFrame, det: DataFrame, channels: list[str], radius: int = 15, limit: float = 3.0) -> DataFrame:
    """Per channel the share of box pixels far below, and far from, their local median in units of the lower half's MAD."""
    local = window_median(pixels, channels, radius)
    dev = pixels.join(local, G.KEY).withColumns({f"d_{c}": F.col(c) - F.col(f"bg_{c}") for c in channels})
    low = dev.filter(F.col("y") >= F.floor(F.col("h") / 2))
    mid = low.groupBy("image").agg(*[_median(f"d_{c}").alias(f"m_{c}") for c in channels])
    mad = low.join(mid, "image").groupBy("image").agg(
        *[F.greatest(_median(F.abs(F.col(f"d_{c}") - F.col(f"m_{c}"))) * 1.4826, F.lit(0.5)).alias(f"s_{c}") for c in channels]
    )
    z = dev.join(mad, "image").withColumns({f"z_{c}": F.col(f"d_{c}") / F.col(f"s_{c}") for c in channels})
    inside = box_pixels(z, det, [f"z_{c}" for c in channels])
    return inside.groupBy("image", "did").agg(*[
        a for c in channels for a in (
            F.avg((F.col(f"z_{c}") < -limit).cast("int")).alias(f"{c}_dark"), F.avg((F.abs(f"z_{c}") > limit).cast("int")).alias(f"{c}_abs"),
        )
    ])


def candidate_context(pixels: DataFrame, points: DataFrame, det: DataFrame, road: str = "road", trace: str = "trace", paint: str = "paint") -> DataFrame:
    """Road share around a candidate, density of other trace pixels near it, straightness and paint share beside it.

    ``det`` has image, did, x1..y2, w, h; ``points`` image, did, y, x. Straightness is the candidate's extent along its
    main axis over its pixel count.
    """
    w, h = F.col("w").cast("double"), F.col("h").cast("double")

    def grown(factor, px):
        r = B.ring_grown(B.DET_BOX, w, h, factor, px)
        return det.select("image", "did", *[r[c].alias(n) for c, n in zip(OUTER, B.DET_BOX)])

    near = box_pixels(pixels, grown(1.0, 8.0), [road, paint]).groupBy("image", "did").agg(
        F.avg(F.col(road).cast("int")).alias("road"), F.avg(F.col(paint).cast("int")).alias("paint")
    )
    own = points.select("image", "did", "y", "x", F.lit(True).alias("_own"))
    wide = box_pixels(pixels, grown(2.0, 4.0), [trace]).join(own, ["image", "did", "y", "x"], "left")
    density = wide.groupBy("image", "did").agg(F.avg((F.col(trace) & F.col("_own").isNull()).cast("int")).alias("density"))
    shape = shape_features(points, ["image", "did"]).select("image", "did", (F.col("length") / F.col("area")).alias("straight"))
    return near.join(density, ["image", "did"]).join(shape, ["image", "did"])
