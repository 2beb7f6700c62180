"""Line detection: ridge score, centre lines, edges, thresholds, smoothing, two-sided darkness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.hashing import hash_key
from . import grid as G
from .components import hysteresis


def line_score(pixels: DataFrame, gray: str = "gray", sigmas: tuple[float, ...] = (1.0, 1.5, 2.0), combine: str = "max", radius: int | None = None) -> DataFrame:
    """Dark-line strength (score) and the direction across the line (angle) from second derivatives at several scales.

    Smoothing and differentiation are folded into one kernel per direction, so all scales together cost one window along
    x and one along y. ``combine``: the strongest scale, or the mean with the angle of the scale nearest to it.
    """
    outputs = {}
    for i, s in enumerate(sigmas):
        g = G.gaussian_kernel(s, radius)
        second, smooth, diff = (G.convolved(g, k) for k in (G.SECOND, G.SMOOTH, G.DIFF))
        outputs.update({f"_xx{i}": (gray, second, smooth), f"_yy{i}": (gray, smooth, second), f"_xy{i}": (gray, diff, diff)})
    out = G.filter2(pixels, outputs)
    scales = []
    for i, s in enumerate(sigmas):
        xx, yy, xy = F.col(f"_xx{i}"), F.col(f"_yy{i}"), F.col(f"_xy{i}")
        root = F.sqrt((xx - yy) * (xx - yy) + xy * xy * 4)
        big, small = (xx + yy + root) / 2, (xx + yy - root) / 2
        strength = F.greatest(big - F.abs(small), F.lit(0.0)) * (s * s)
        scales.append(F.struct(strength.alias("s"), (F.atan2(xy * 2, xx - yy) / 2).alias("a")))
    out = out.withColumn("_sc", F.array(*scales)).drop(*outputs)
    strengths = F.transform("_sc", lambda v: v["s"])
    if combine == "mean":
        score = F.aggregate(strengths, F.lit(0.0), lambda a, v: a + v) / len(sigmas)
        pick = F.array_position(F.transform(strengths, lambda v: F.abs(v - F.col("score"))), F.array_min(F.transform(strengths, lambda v: F.abs(v - F.col("score")))))
    else:
        score = F.array_max(strengths)
        pick = F.array_position(strengths, F.col("score"))
    return out.withColumn("score", score).withColumn("angle", F.get("_sc", pick.cast("int") - 1)["a"]).drop("_sc")


def _suppress(pixels: DataFrame, score: str, sector: Column, name: str) -> DataFrame:
    """Keep a pixel when it is not below its two neighbours in its sector (0 across, 1 down-right, 2 down, 3 up-right)."""
    rows = pixels.withColumn("_q", sector).withColumns({"_dn": F.col("x") - F.col("y"), "_up": F.col("x") + F.col("y")})
    lines = [
        Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "_dn").orderBy("x"),
        Window.partitionBy("image", "x").orderBy("y"), Window.partitionBy("image", "_up").orderBy("x"),
    ]
    c = F.col(score)
    sides = {}
    for q, w in enumerate(lines):
        sides[f"_n{q}"] = F.greatest(F.coalesce(F.lag(c).over(w), F.lit(0.0)), F.coalesce(F.lead(c).over(w), F.lit(0.0)))
    out = rows.withColumns(sides)
    around = F.when(F.col("_q") == 0, F.col("_n0")).when(F.col("_q") == 1, F.col("_n1")).when(F.col("_q") == 2, F.col("_n2")).otherwise(F.col("_n3"))
    return out.withColumn(name, F.when((c >= around) & (c > 0), c).otherwise(0.0)).drop("_q", "_dn", "_up", *sides)


def centerline(pixels: DataFrame, score: str = "score", angle: str = "angle", name: str = "center") -> DataFrame:
    """Thin the score to its ridges, comparing across the line in four directions. Rows, columns and both diagonals are
    window partitions."""
    sector = F.pmod(F.bround(F.col(angle) / (3.141592653589793 / 4), 0), F.lit(4)).cast("int")
    return _suppress(pixels, score, sector, name)


def edge_count(pixels: DataFrame, gray: str = "gray", low: float = 100.0, high: float = 200.0, mask: str | None = None) -> DataFrame:
    """Edge pixels per image: gradient ridges kept by two thresholds."""
    g = G.sobel(pixels, gray).withColumn("_mag", F.abs("gx") + F.abs("gy"))
    sector = F.pmod(F.bround(F.atan2("gy", "gx") / (3.141592653589793 / 4), 0), F.lit(4)).cast("int")
    thin = _suppress(g, "_mag", sector, "_edge")
    kept = hysteresis(thin, F.col("_edge") > low, F.col("_edge") > high)
    if mask is not None:
        kept = kept.join(pixels.filter(F.col(mask)).select(*G.KEY), G.KEY, "left_semi")
    counts = kept.groupBy("image").agg(F.count("*").alias("n_edges"))
    return pixels.select("image").distinct().join(counts, "image", "left").fillna(0, ["n_edges"])


def adaptive_threshold(pixels: DataFrame, col: str, block: int, c: float, inverse: bool = False, name: str = "on") -> DataFrame:
    """Pixels above (or, inverted, at or below) their local mean minus ``c``."""
    m = G.box_mean(pixels, {"_mean": col}, block, "replicate")
    limit = F.bround("_mean", 0) - c
    return m.withColumn(name, (F.col(col) <= limit) if inverse else (F.col(col) > limit)).drop("_mean")


def guided_filter(pixels: DataFrame, col: str = "gray", r: int = 4, eps: str | float = "std", eps_scale: float = 1.0, name: str = "guided") -> DataFrame:
    """Edge-preserving smoothing guided by the image itself; ``eps`` may be the image's std or var."""
    rows = pixels.withColumn("_sq", F.col(col) * F.col(col))
    if isinstance(eps, str):
        stat = pixels.groupBy("image").agg((F.stddev_pop(col) if eps == "std" else F.var_pop(col)).alias("_eps"))
        rows = rows.join(stat, "image")
    else:
        rows = rows.withColumn("_eps", F.lit(float(eps)))
    m = G.box_mean(rows, {"_m": col, "_ms": "_sq"}, 2 * r + 1)
    var = F.col("_ms") - F.col("_m") * F.col("_m")
    ab = m.withColumn("_a", var / (var + F.col("_eps") * eps_scale)).withColumn("_b", F.col("_m") - F.col("_a") * F.col("_m"))
    out = G.box_mean(ab, {"_ma": "_a", "_mb": "_b"}, 2 * r + 1)
    return out.withColumn(name, F.col("_ma") * F.col(col) + F.col("_mb")).drop("_sq", "_eps", "_m", "_ms", "_a", "_b", "_ma", "_mb")


def sample_normals(points: DataFrame, radius: int, samples: int | None = None, seed=0) -> DataFrame:
    """Pixels of every component with the local direction across it: all of them, or ``samples`` of each drawn by hash.

    A sample looks only at its own component within ``radius``: its surrounding cells are generated and looked up, so a
    long component is not paired with itself.
    """
    drawn = points
    if samples is not None:
        pick = Window.partitionBy("image", "label").orderBy(hash_key(seed, "image", "label", "y", "x"))
        drawn = points.withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") <= samples)
    disk = [(dy, dx) for dy, dx in G.square_offsets(radius) if dy * dy + dx * dx <= radius * radius]
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk])
    near = drawn.select("image", "label", F.col("y").alias("sy"), F.col("x").alias("sx"), F.inline(moves)).select(
        "image", "label", "sy", "sx", (F.col("sy") + F.col("dy")).alias("y"), (F.col("sx") + F.col("dx")).alias("x")
    ).join(points.select("image", "label", "y", "x"), ["image", "label", "y", "x"])
    g = near.groupBy("image", "label", "sy", "sx").agg(
        F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy")
    ).filter("n >= 3")
    along = F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2
    return g.select("image", "label", "sy", "sx", (-F.sin(along)).alias("nx"), F.cos(along).alias("ny"))


def valley_score(pixels: DataFrame, points: DataFrame, widths: DataFrame, gray: str = "gray", gap: float = 2.0, radius: int = 7, samples: int | None = None, seed=0) -> DataFrame:
    """How evenly both sides of a component are brighter than it: median over its pixels of the weaker over the stronger
    side, 0 when a side is not brighter, 1 when nothing could be measured. ``widths`` has image, label, width."""
    s = sample_normals(points, radius, samples, seed).join(widths.select("image", "label", "width"), ["image", "label"])
    d = F.col("width") / 2 + gap
    side = F.inline(F.array(*[
        F.struct(F.lit(sg).alias("sg"), F.bround(F.col("sx") + F.col("nx") * d * sg, 0).cast("bigint").alias("x"), F.bround(F.col("sy") + F.col("ny") * d * sg, 0).cast("bigint").alias("y"))
        for sg in (1, -1)
    ]))
    v = pixels.select("image", "y", "x", F.col(gray).alias("_v"))
    looked = s.select("image", "label", "sy", "sx", side).join(v, G.KEY)
    own = v.select("image", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("_v").alias("_c"))
    diff = looked.join(own, ["image", "sy", "sx"]).groupBy("image", "label", "sy", "sx").agg(
        F.count("*").alias("k"), F.min(F.col("_v") - F.col("_c")).alias("lo"), F.max(F.col("_v") - F.col("_c")).alias("hi")
    ).filter("k = 2")
    ratio = F.when((F.col("lo") <= 0) | (F.col("hi") <= 0), 0.0).otherwise(F.col("lo") / F.nullif(F.col("hi"), F.lit(0.0)))
    med = diff.groupBy("image", "label").agg(F.percentile(ratio, F.lit(0.5)).alias("valley"))
    return widths.select("image", "label").join(med, ["image", "label"], "left").fillna(1.0, ["valley"])
