"""Image quality metrics, analysis masks and brightness decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...params import GammaRule
from . import grid as G
from .colour import NOISE_FACTOR


def block_of(pos: Column, size: Column, parts: int) -> Column:
    """Index of the part a position falls in when ``size`` is split into ``parts`` runs, the longer ones first."""
    q, rem = F.floor(size / parts), size % parts
    cut = rem * (q + 1)
    return F.when(pos < cut, F.floor(pos / (q + 1))).otherwise(rem + F.floor((pos - cut) / F.greatest(q, F.lit(1)))).cast("bigint")


def _responses(pixels: DataFrame, gray: str) -> DataFrame:
    """Laplacian and noise-kernel responses in the same two windows."""
    one = [0.0, 1.0, 0.0]
    out = G.filter2(pixels, {"_lx": (gray, G.SECOND, one), "_ly": (gray, one, G.SECOND), "_noise": (gray, G.SECOND, G.SECOND)})
    return out.withColumn("_lap", F.col("_lx") + F.col("_ly")).drop("_lx", "_ly")


def _inner() -> Column:
    return (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("w") - 1) & (F.col("y") < F.col("h") - 1)


def quality(pixels: DataFrame, gray: str = "gray", val: str = "val", dark: float = 40, bright: float = 215, grid: int = 4) -> DataFrame:
    """Nine metrics per image over the whole frame.

    Blocks are averaged first and every block mean weighs the same, so one image is one line of block sums, combined
    map-side.
    """
    v = F.col(gray)
    r = _responses(pixels, gray).withColumns({"_by": block_of(F.col("y"), F.col("h"), grid), "_bx": block_of(F.col("x"), F.col("w"), grid)})
    inner = _inner()
    part = r.groupBy("image", "w", "h", "_by", "_bx").agg(
        F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"),
        F.count_if((v == 0) | (v == 255)).alias("sat"), F.count_if(v < dark).alias("dark"), F.count_if(v > bright).alias("bright"),
        F.sum(val).alias("vs"), F.sum("_lap").alias("ls"), F.sum(F.col("_lap") * F.col("_lap")).alias("lss"),
        F.sum(F.when(inner, F.abs("_noise"))).alias("ns"),
    )
    g = part.groupBy("image", "w", "h").agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "ss", "sat", "dark", "bright", "vs", "ls", "lss", "ns")],
        F.stddev_pop(F.col("s") / F.col("n")).alias("bstd"),
    )
    n = F.col("n")

    def variance(s, ss):
        return F.greatest(F.col(ss) / n - (F.col(s) / n) * (F.col(s) / n), F.lit(0.0))

    return g.select(
        "image", (F.col("s") / n).alias("gray_mean"), F.sqrt(variance("s", "ss")).alias("gray_std"),
        F.when((F.col("w") >= grid) & (F.col("h") >= grid), F.col("bstd")).alias("block_mean_std_4x4"),
        (F.col("sat") / n).alias("saturation_ratio"), (F.col("dark") / n).alias("dark_ratio"), (F.col("bright") / n).alias("bright_ratio"),
        (F.col("vs") / n).alias("hsv_v_mean"), variance("ls", "lss").alias("laplacian_variance"),
        F.when((F.col("w") >= 3) & (F.col("h") >= 3), F.col("ns") * NOISE_FACTOR / (6 * (F.col("w") - 2) * (F.col("h") - 2))).alias("noise_sigma"),
    )


def quality_masked(
    pixels: DataFrame, mask: str = "mask", support: str | None = None, gray: str = "gray",
    dark: float = 40, bright: float = 215, grid: int = 4, min_block: int = 1, by: list[str] | None = None,
) -> DataFrame:
    """Eight metrics inside the mask. Filter responses count only where ``support`` holds; images with an empty mask get
    NULLs. Blocks divide the mask's bounding box and need ``min_block`` mask pixels."""
    by = by or ["image"]
    v, m = F.col(gray), F.col(mask)
    s = m if support is None else m & F.col(support)
    r = _responses(pixels, gray).withColumn("_s", s)
    box = pixels.filter(m).groupBy(*by).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    images = pixels.select(*by).distinct()
    bh, bw = F.col("_y1") - F.col("_y0") + 1, F.col("_x1") - F.col("_x0") + 1
    inside = r.filter(m).join(box, by).withColumns({
        "_by": F.when((bh >= grid) & (bw >= grid), block_of(F.col("y") - F.col("_y0"), bh, grid)),
        "_bx": F.when((bh >= grid) & (bw >= grid), block_of(F.col("x") - F.col("_x0"), bw, grid)),
    })
    inner = _inner() & F.col("_s")
    part = inside.groupBy(*by, "_by", "_bx").agg(
        F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.count_if((v == 0) | (v == 255)).alias("sat"),
        F.count_if(v < dark).alias("dark"), F.count_if(v > bright).alias("bright"), F.count_if("_s").alias("sn"),
        F.sum(F.when(F.col("_s"), F.col("_lap"))).alias("ls"), F.sum(F.when(F.col("_s"), F.col("_lap") * F.col("_lap"))).alias("lss"),
        F.count_if(inner).alias("nn"), F.sum(F.when(inner, F.abs("_noise"))).alias("ns"),
    )
    usable = F.when((F.col("n") >= min_block) & F.col("_by").isNotNull(), F.col("s") / F.col("n"))
    g = part.groupBy(*by).agg(
        F.stddev_pop(usable).alias("bstd"), F.count(usable).alias("bn"),
        *[F.sum(c).alias(c) for c in ("n", "s", "ss", "sat", "dark", "bright", "sn", "ls", "lss", "nn", "ns")],
    )
    n, sn = F.col("n"), F.col("sn")
    out = g.select(
        *by, (F.col("s") / n).alias("gray_mean"), F.sqrt(F.greatest(F.col("ss") / n - (F.col("s") / n) * (F.col("s") / n), F.lit(0.0))).alias("gray_std"),
        F.when(F.col("bn") >= 2, F.col("bstd")).alias("block_mean_std_4x4"), (F.col("dark") / n).alias("dark_ratio"),
        (F.col("bright") / n).alias("bright_ratio"), (F.col("sat") / n).alias("saturation_ratio"),
        F.when(sn > 0, F.greatest(F.col("lss") / F.nullif(sn, F.lit(0)) - F.pow(F.col("ls") / F.nullif(sn, F.lit(0)), F.lit(2)), F.lit(0.0))).alias("laplacian_variance"),
        (F.col("ns") * NOISE_FACTOR / F.nullif(6 * F.col("nn"), F.lit(0))).alias("noise_sigma"),
    )
    return images.join(out, by, "left")


def sharpness(pixels: DataFrame, mask: str = "mask", gray: str = "gray", kernel: int = 5, min_pixels: int = 100) -> DataFrame:
    """Laplacian variance inside the eroded mask, over the whole image when too little mask is left."""
    e = G.erode(pixels.withColumn("_m", F.col(mask).cast("int")), "_m", G.rect_spans(kernel), "_e")
    r = G.laplacian(e, gray, "_lap")
    kept = F.when(F.col("_e") == 1, F.col("_lap"))
    g = r.groupBy("image").agg(F.var_pop(kept).alias("_in"), F.count(kept).alias("_n"), F.var_pop("_lap").alias("_all"))
    return g.select("image", F.when(F.col("_n") > min_pixels, F.col("_in")).otherwise(F.col("_all")).alias("sharpness"))


def analysis_mask(pixels: DataFrame, mask: str = "mask", kernel: int = 5, iterations: int = 1, name: str = "analysis") -> DataFrame:
    out = pixels.withColumn("_m", F.col(mask).cast("int"))
    for _ in range(iterations):
        out = G.erode(out, "_m", G.rect_spans(kernel))
    return out.withColumn(name, F.col("_m") == 1).drop("_m")


def analysis_info(pixels: DataFrame, mask: str = "mask", analysis: str = "analysis", min_pixels: int = 2000, min_ratio: float = 0.3) -> DataFrame:
    g = pixels.groupBy("image").agg(F.count_if(analysis).alias("pixels"), F.count_if(mask).alias("road_pixels"))
    ratio = F.when(F.col("road_pixels") > 0, F.col("pixels") / F.col("road_pixels")).otherwise(0.0)
    out = g.withColumn("_r", ratio)
    return out.withColumn("ratio_of_road", F.round("_r", 6)).withColumn(
        "sufficient", (F.col("pixels") >= min_pixels) & (F.col("_r") >= min_ratio)
    ).drop("_r")


def choose_gamma(pixels: DataFrame, mask: str = "mask", gray: str = "gray", rule: GammaRule = GammaRule()) -> DataFrame:
    """Per image the correction to use: the weakest candidate that clears every dark condition, else the strongest one that
    passes the saturation guard; candidates past the first guarded one are not considered. NULL when none qualifies.

    All candidates are measured in one pass: each mask pixel contributes to a few counters per candidate.
    """
    steps = sorted({c for c in rule.candidates if c < 1.0}, reverse=True)
    inside = pixels.filter(F.col(mask))
    aggs = [F.count("*").alias("n"), F.count_if((F.col(gray) == 0) | (F.col(gray) == 255)).alias("sat")]
    for i, c in enumerate(steps):
        v = F.bround(F.pow(F.col(gray) / 255.0, F.lit(c)) * 255.0, 0)
        aggs += [F.sum(v).alias(f"s{i}"), F.count_if(v < 40).alias(f"d{i}"), F.count_if((v == 0) | (v == 255)).alias(f"t{i}")]
    g = inside.groupBy("image").agg(*aggs)
    tried = []
    for i, c in enumerate(steps):
        mean, dark, sat = F.col(f"s{i}") / F.col("n"), F.col(f"d{i}") / F.col("n"), F.col(f"t{i}") / F.col("n")
        resolved = F.lit(True)
        if rule.gray_mean_below is not None:
            resolved = resolved & (mean >= rule.gray_mean_below)
        if rule.dark_ratio_above is not None:
            resolved = resolved & (dark <= rule.dark_ratio_above)
        guard = F.lit(False)
        if rule.max_saturation_ratio_after is not None:
            guard = (sat > rule.max_saturation_ratio_after) & (sat > F.col("sat") / F.col("n"))
        tried.append(F.struct(F.lit(c).alias("value"), resolved.alias("resolved"), guard.alias("guard")))
    start = F.struct(F.lit(None).cast("double").alias("value"), F.lit(False).alias("stop"))

    def step(s, t):
        halted = F.struct(s["value"].alias("value"), F.lit(True).alias("stop"))
        taken = F.struct(t["value"].alias("value"), t["resolved"].alias("stop"))
        return F.when(s["stop"] | t["guard"], halted).otherwise(taken)

    return g.select("image", F.aggregate(F.array(*tried), start, step, lambda s: s["value"]).alias("gamma"))
