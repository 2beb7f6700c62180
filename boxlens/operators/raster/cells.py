"""Grid cells, seeds and region growing for the road mask."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import checkpoint
from . import grid as G
from .colour import lab
from .components import components

EPS = 1e-6
OFFSETS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


# --- fixed values: parameter defaults -----------------------------------------------------------------------------
@dataclass(frozen=True)
class FeatureParams:
    smooth_sigma: float = 2.0
    gradient_sigma: float = 1.0
    texture_sigma: float = 2.0
    edge_threshold: float = 6.0
    lightness_weight: float = 0.35
    cell_size: int = 32


@dataclass(frozen=True)
class SeedParams:
    count_min: int = 3
    count_max: int = 5
    min_score: float = 0.6
    min_distance_cells: int = 3
    min_cell_fill: float = 0.5
    max_chroma_distance_to_best: float | None = 5.0
    max_lightness_distance_to_best: float | None = 25.0
    max_shadow_darkening_to_best: float | None = 50.0
    max_texture_ratio_to_best: float | None = 2.0
    weights: dict = field(default_factory=lambda: {
        "position": 1.0, "neutral_color": 1.0, "homogeneity": 1.0, "texture": 1.0, "brightness": 1.0, "neighbor_similarity": 1.5,
    })
    vertical_power: float = 0.5
    horizontal_center_weight: float = 0.3
    neutral_chroma_scale: float = 18.0
    homogeneity_edge_scale: float = 0.2
    texture_range: tuple = (2.0, 45.0)
    brightness_range: tuple = (10.0, 80.0)
    brightness_margin: float = 15.0
    neighbor_color_scale: float = 6.0


@dataclass(frozen=True)
class GrowParams:
    color_threshold: float = 6.0
    seed_std_scale: float = 1.0
    max_color_threshold: float = 9.0
    max_lightness_diff: float = 30.0
    max_gradient: float | None = 5.0
    texture_ratio_range: tuple = (0.35, 2.5)
    min_seed_cell_coverage: float = 0.3
    connectivity: int = 8
    shadow: bool = True
    max_darkening: float = 60.0
    shadow_color_threshold: float = 7.0
    blue_shift_weight: float = 0.2
    max_rise_ratio: float | None = 0.1
    min_texture_scale: float = 0.3
# ------------------------------------------------------------------------------------------------------------------


def feature_maps(pixels: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Smoothed Lab (L, a, bb), lightness gradient and texture per pixel, from b, g, r columns.

    The three smoothing scales share windows: one pass along x and one along y for colour and gradient, one more pair
    for the texture average.
    """
    raw = pixels.withColumn("_l", lab()["L"])
    k = G.gaussian_kernel(p.smooth_sigma)
    g = G.gaussian_kernel(p.gradient_sigma)
    d, s = G.convolved(g, G.DIFF), G.convolved(g, G.SMOOTH)
    out = G.filter2(raw, {
        "_b": ("b", k, k), "_g": ("g", k, k), "_r": ("r", k, k), "_gx": ("_l", d, s), "_gy": ("_l", s, d),
        "_xx": ("_l", G.SECOND, G.SMOOTH), "_yy": ("_l", G.SMOOTH, G.SECOND),
    })
    out = out.withColumns({
        **lab("_b", "_g", "_r"), "gradient": F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")) / 8.0, "texture": F.abs(F.col("_xx") + F.col("_yy")),
    }).drop("_b", "_g", "_r", "_gx", "_gy", "_xx", "_yy", "_l")
    return G.gaussian(out, ["texture"], p.texture_sigma)


def cell_features(maps: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """One row per grid cell: colour means and spreads, position, texture, gradient, edge density, fill, chroma and the
    mean colour distance to the neighbouring cells."""
    cs = p.cell_size
    r, c = F.floor(F.col("y") / cs).alias("row"), F.floor(F.col("x") / cs).alias("col")
    g = maps.groupBy("image", "w", "h", r, c).agg(
        *[F.avg(v).alias(f"mean_{n}") for n, v in (("L", "L"), ("a", "a"), ("b", "bb"))],
        *[F.stddev_pop(v).alias(f"std_{n}") for n, v in (("L", "L"), ("a", "a"), ("b", "bb"))],
        F.avg("texture").alias("texture"), F.avg("gradient").alias("grad_mean"),
        F.avg((F.col("gradient") > p.edge_threshold).cast("int")).alias("edge_density"), (F.count("*") / (cs * cs)).alias("fill"),
    )

    def centre(i, size):
        end = F.least((F.col(i) + 1) * cs, F.col(size))
        return (F.col(i) * cs + end - 1) / 2.0

    cells = g.withColumns({"x": centre("col", "w"), "y": centre("row", "h")}).withColumns({
        "cx": F.col("x") / F.greatest(F.col("w") - 1, F.lit(1)), "cy": F.col("y") / F.greatest(F.col("h") - 1, F.lit(1)),
        "chroma": F.sqrt(F.col("mean_a") * F.col("mean_a") + F.col("mean_b") * F.col("mean_b")),
    })
    dist = neighbor_mean(cells, _distance(p.lightness_weight), "neighbor_dist", ["mean_L", "mean_a", "mean_b"])
    return cells.join(dist, ["image", "row", "col"], "left")


def _distance(weight: float) -> Column:
    dl = (F.col("mean_L") - F.col("o_mean_L")) * weight
    da, db = F.col("mean_a") - F.col("o_mean_a"), F.col("mean_b") - F.col("o_mean_b")
    return F.sqrt(dl * dl + da * da + db * db)


def neighbor_mean(cells: DataFrame, value: Column, name: str, carry: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Mean of ``value`` over a cell's up to eight neighbours; the neighbour's columns are prefixed ``o_``."""
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in OFFSETS])
    sent = cells.select("image", F.explode(moves).alias("_m"), F.col(row).alias("_r"), F.col(col).alias("_c"), *[F.col(c).alias(f"o_{c}") for c in carry]).select(
        "image", (F.col("_r") + F.col("_m.dr")).alias(row), (F.col("_c") + F.col("_m.dc")).alias(col), *[f"o_{c}" for c in carry]
    )
    return cells.select("image", row, col, *carry).join(sent, ["image", row, col]).groupBy("image", row, col).agg(F.avg(value).alias(name))


def _mean_of(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = sum(weights[n] for n in parts)
    if total <= 0:
        return F.lit(1.0)
    logs = [F.log(F.greatest(c, F.lit(EPS))) * weights[n] for n, c in parts.items()]
    return F.exp(reduce(lambda a, b: a + b, logs) / total)


def _between(v: Column, low=0.0, high=1.0) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def score_cells(cells: DataFrame, p: SeedParams = SeedParams(), lightness_weight: float = 0.35) -> DataFrame:
    """Road-likeness of every cell: a weighted geometric mean of six components."""
    lo, hi = p.texture_range
    t = F.col("texture")
    below = _between(t / max(lo, EPS))
    dark = F.greatest(F.lit(p.brightness_range[0]) - F.col("mean_L"), F.lit(0.0)) / p.brightness_margin
    light = F.greatest(F.col("mean_L") - p.brightness_range[1], F.lit(0.0)) / p.brightness_margin
    chroma = F.col("chroma") / p.neutral_chroma_scale
    parts = {
        "position": F.pow("cy", F.lit(p.vertical_power)) * (1.0 - p.horizontal_center_weight * F.abs(2.0 * F.col("cx") - 1.0)),
        "neutral_color": F.exp(-(chroma * chroma)), "homogeneity": F.exp(-F.col("edge_density") / p.homogeneity_edge_scale),
        "texture": F.when(t < lo, below * below).when(t > hi, _between(F.lit(hi) / F.greatest(t, F.lit(EPS)))).otherwise(1.0),
        "brightness": _between(1.0 - dark - light),
    }
    named = cells.withColumns({f"c_{n}": c for n, c in parts.items()})
    cols = {n: F.col(f"c_{n}") for n in parts}
    first = named.withColumn("preliminary", _mean_of(cols, p.weights))
    support = neighbor_mean(
        first, F.exp(-_distance(lightness_weight) / p.neighbor_color_scale) * F.col("o_preliminary"), "c_neighbor_similarity",
        ["mean_L", "mean_a", "mean_b", "preliminary"],
    )
    j = first.join(support, ["image", "row", "col"], "left").fillna(0.0, ["c_neighbor_similarity"])
    cols["neighbor_similarity"] = F.col("c_neighbor_similarity")
    return j.withColumn("score", _mean_of(cols, p.weights)).drop("preliminary")


def select_seeds(cells: DataFrame, p: SeedParams = SeedParams()) -> DataFrame:
    """Up to ``count_max`` cells, best first, apart from each other and consistent with the first.

    One aggregate per seed over the cells still allowed: no image's cells are gathered in one place.
    """
    order = F.struct(F.col("score"), -F.col("row"), -F.col("col"))
    keep = ["row", "col", "x", "y", "score", "mean_L", "mean_a", "mean_b", "texture"]
    left = cells.filter((F.col("fill") >= p.min_cell_fill) & (F.col("score") >= p.min_score)).select("image", *keep)
    left = checkpoint(left)
    chosen, first = [], None
    for rank in range(p.count_max):
        best = left.groupBy("image").agg(F.max_by(F.struct(*keep), order).alias("s"))
        best = checkpoint(best.select("image", F.lit(rank).alias("rank"), *[F.col(f"s.{k}").alias(k) for k in keep]))
        chosen.append(best)
        names = {k: f"s_{k}" for k in keep}
        j = left.join(best.drop("rank").withColumnsRenamed(names), "image")
        apart = F.greatest(F.abs(F.col("row") - F.col("s_row")), F.abs(F.col("col") - F.col("s_col"))) >= p.min_distance_cells
        ok = apart if first else apart & _consistent(p)
        first = True
        left = j.filter(ok).select("image", *keep)
    return reduce(DataFrame.unionByName, chosen)


def _consistent(p: SeedParams) -> Column:
    ok = F.lit(True)
    if p.max_chroma_distance_to_best is not None:
        ok = ok & (F.hypot(F.col("mean_a") - F.col("s_mean_a"), F.col("mean_b") - F.col("s_mean_b")) <= p.max_chroma_distance_to_best)
    d = F.col("mean_L") - F.col("s_mean_L")
    if p.max_lightness_distance_to_best is not None:
        ok = ok & (d <= p.max_lightness_distance_to_best)
    if p.max_shadow_darkening_to_best is not None:
        ok = ok & (-d <= p.max_shadow_darkening_to_best)
    if p.max_texture_ratio_to_best is not None:
        t, s = F.greatest("texture", F.lit(EPS)), F.greatest("s_texture", F.lit(EPS))
        ok = ok & (F.greatest(t / s, s / t) <= p.max_texture_ratio_to_best)
    return ok


def seed_references(maps: DataFrame, seeds: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Mean Lab, colour spread and median texture of every seed's cell."""
    cs = p.cell_size
    s = seeds.select("image", "rank", "row", "col", F.col("y").alias("seed_y"))
    px = maps.withColumns({"row": F.floor(F.col("y") / cs), "col": F.floor(F.col("x") / cs)})
    g = px.join(s, ["image", "row", "col"]).groupBy("image", "rank", "row", "col", "seed_y").agg(
        F.avg("L").alias("rL"), F.avg("a").alias("ra"), F.avg("bb").alias("rb"), F.hypot(F.stddev_pop("a"), F.stddev_pop("bb")).alias("sigma_ab"),
        F.percentile("texture", F.lit(0.5)).alias("ref_texture"), F.count("*").alias("cell_pixels"),
    )
    return g


def acceptance(p: GrowParams = GrowParams(), lightness_weight: float = 0.35) -> Column:
    """Whether a pixel looks like the seed it is compared with, shadows of it included."""
    dl, da, db = F.col("L") - F.col("rL"), F.col("a") - F.col("ra"), F.col("bb") - F.col("rb")
    wl = dl * lightness_weight
    limit = F.least(F.lit(p.color_threshold) + F.col("sigma_ab") * p.seed_std_scale, F.lit(p.max_color_threshold))
    ok = (F.sqrt(wl * wl + da * da + db * db) <= limit) & (F.abs(dl) <= p.max_lightness_diff)
    scale = F.lit(1.0)
    if p.shadow:
        bluish = F.when(db < 0, db * p.blue_shift_weight).otherwise(db)
        dark = (dl < 0) & (-dl <= p.max_darkening) & (F.hypot(da, bluish) <= p.shadow_color_threshold)
        if p.max_rise_ratio is not None:
            dark = dark & (F.col("y") >= F.greatest(F.lit(0), F.floor(F.col("seed_y") - p.max_rise_ratio * F.col("h"))))
        ok = ok | dark
        scale = _between(F.col("L") / F.greatest("rL", F.lit(EPS)), p.min_texture_scale, 1.0)
    if p.max_gradient is not None:
        ok = ok & (F.col("gradient") <= p.max_gradient)
    ref = F.greatest("ref_texture", F.lit(EPS))
    lo, hi = p.texture_ratio_range
    return ok & (F.col("texture") >= ref * lo * scale) & (F.col("texture") <= ref * hi)


def grow_regions(maps: DataFrame, seeds: DataFrame, p: GrowParams = GrowParams(), f: FeatureParams = FeatureParams(), full_frame: bool = True) -> DataFrame:
    """Mask pixels reachable from the seeds through acceptable pixels.

    Components of the acceptable pixels are formed per (image, seed); the one covering most of the seed's cell is kept when
    it covers enough of it. Images without any seed become whole-frame candidates when ``full_frame``.
    """
    refs = checkpoint(seed_references(maps, seeds, f))
    ok = maps.join(refs, "image").filter(acceptance(p, f.lightness_weight)).select("image", "rank", "y", "x")
    lab_ = checkpoint(components(ok, p.connectivity, ["image", "rank"]))
    cs = f.cell_size
    inside = lab_.join(refs.select("image", "rank", "row", "col", "cell_pixels"), ["image", "rank"]).filter(
        (F.floor(F.col("y") / cs) == F.col("row")) & (F.floor(F.col("x") / cs) == F.col("col"))
    )
    cover = inside.groupBy("image", "rank", "label", "cell_pixels").agg(F.count("*").alias("n"))
    best = cover.groupBy("image", "rank", "cell_pixels").agg(F.max_by(F.struct("label", "n"), F.struct("n", -F.col("label"))).alias("b"))
    kept = best.filter(F.col("b.n") / F.col("cell_pixels") >= p.min_seed_cell_coverage).select("image", "rank", F.col("b.label").alias("label"))
    grown = lab_.join(kept, ["image", "rank", "label"], "left_semi").select("image", "y", "x").distinct()
    if full_frame:
        bare = maps.select("image", "y", "x").join(seeds.select("image").distinct(), "image", "left_anti")
        grown = grown.unionByName(bare)
    return grown


def road_top(pixels: DataFrame, texture_sigma: float = 3.0, bands: int = 24, margin: float = 0.05, share: float = 0.5) -> DataFrame:
    """Share of the frame height above the road: bands are followed upward from the sample until two in a row stop
    looking like road.

    ``pixels`` has b, g, r at working resolution. Colours use the 8-bit Lab scale.
    """
    c = lab()
    px = pixels.withColumns({"_L": c["L"] * 2.55, "_A": c["a"] + 128, "_B": c["bb"] + 128})
    px = G.filter2(px, {"_xx": ("_L", G.SECOND, G.SMOOTH), "_yy": ("_L", G.SMOOTH, G.SECOND)})
    px = G.gaussian(px.withColumn("_t", F.abs(F.col("_xx") + F.col("_yy"))).drop("_xx", "_yy"), ["_t"], texture_sigma)
    window = (
        (F.col("y") >= F.floor(F.col("h") * 0.60)) & (F.col("y") < F.floor(F.col("h") * 0.80))
        & (F.col("x") >= F.floor(F.col("w") * 0.30)) & (F.col("x") < F.floor(F.col("w") * 0.70))
    )
    med = lambda v: F.percentile(v, F.lit(0.5))
    ref = px.filter(window).groupBy("image").agg(
        med("_A").alias("ma"), med("_B").alias("mb"), F.greatest(F.stddev_pop("_A"), F.lit(3.0)).alias("sa"),
        F.greatest(F.stddev_pop("_B"), F.lit(3.0)).alias("sb"), med("_L").alias("ml"), F.stddev_pop("_L").alias("sl"), med("_t").alias("mt"),
    )
    da, db = (F.col("_A") - F.col("ma")) / F.col("sa"), (F.col("_B") - F.col("mb")) / F.col("sb")
    road = (
        (F.sqrt(da * da + db * db) < 3) & (F.col("_t") > F.col("mt") * 0.35)
        & (F.col("_L") < F.col("ml") + F.greatest(F.col("sl") * 3, F.lit(45.0)))
    )
    # band i holds rows floor(i h / n) .. floor((i + 1) h / n) - 1
    band = F.floor(((F.col("y") + 1) * bands - 1) / F.col("h")).cast("int")
    rows = px.join(ref, "image").groupBy("image", band.alias("band")).agg(F.avg(road.cast("int")).alias("s"))
    start = int(0.70 * bands)
    line = rows.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("band", "s"))).alias("m"))
    init = F.struct(F.lit(start).alias("top"), F.lit(0).alias("gap"))

    def step(st, i):
        hit = F.coalesce(F.col("m")[i], F.lit(0.0)) >= share
        halted, climbed = st["gap"] > 1, F.struct(i.alias("top"), F.lit(0).alias("gap"))
        missed = F.struct(st["top"].alias("top"), (st["gap"] + 1).alias("gap"))
        return F.when(halted, st).when(hit, climbed).otherwise(missed)

    up = F.sequence(F.lit(start - 1), F.lit(0))
    top = F.aggregate(up, init, step, lambda st: st["top"])
    return line.select("image", F.greatest(F.lit(0.0), top / bands - margin).alias("road_top"))
