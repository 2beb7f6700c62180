"""Row rules: tags, shape classes, verification limits, correction decisions, first-match attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import VALID_TAGS, GammaRule, GaussianRule, PotholeRules, QualityLimits, ShapeRules


def classify_shape(df: DataFrame, frame_area="frame_area", rules: ShapeRules = ShapeRules(), name: str = "type") -> DataFrame:
    """crack, pothole or noise from area, length and elongation. Expects area, length, elong, branch."""
    share = F.col("area") / F.col(frame_area)
    crack_branch, pothole_branch = F.col("branch") == "crack", F.col("branch") == "pothole"
    if rules.crack_min_length > 0:
        too_small = F.when(crack_branch, F.col("length") < rules.crack_min_length).otherwise(share < rules.min_area_ratio)
    else:
        too_small = share < rules.min_area_ratio
    kind = (
        F.when(too_small, "noise")
        .when(crack_branch & (F.col("elong") >= rules.crack_min_elong), "crack")
        .when(pothole_branch & (share >= rules.pothole_min_area_ratio) & (F.col("elong") < rules.pothole_max_elong), "pothole")
        .otherwise("noise")
    )
    return df.withColumn(name, kind)


def passes_cues(limits: dict[str, float], cues="cues") -> Column:
    """``k``: upper limit on cue k, a missing cue passes. ``k_min``: lower limit."""
    ok = F.lit(True)
    for key, limit in limits.items():
        if key.endswith("_min"):
            ok = ok & F.coalesce(F.col(cues)[key[:-4]] >= limit, F.lit(False))
        else:
            ok = ok & F.coalesce(F.col(cues)[key] <= limit, F.lit(True))
    return ok


def cue_filter(det: DataFrame, limits: dict[str, float], cues="cues") -> DataFrame:
    return det.filter(passes_cues(limits, cues))


def verify_pothole(det: DataFrame, rules: PotholeRules = PotholeRules()) -> DataFrame:
    ok = (
        (F.col("chroma") <= rules.chroma_max) & (F.col("dark_p10") >= rules.dark_p10_min)
        & (F.col("aspect") <= rules.aspect_max) & (F.col("rel_y") >= rules.min_rel_y)
    )
    if rules.road_color_max is not None:
        ok = ok & F.coalesce(F.col("road_color") <= rules.road_color_max, F.lit(True))
    return det.filter(ok)


def classify_quality(df: DataFrame, limits: QualityLimits = QualityLimits(), name: str = "tags") -> DataFrame:
    """Sorted tag array; a missing, negative or non-finite metric is ``unclassified``, never ``normal``."""

    def usable(c):
        v = F.col(c)
        return F.when(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < F.lit(float("inf"))), v)

    lap, block = usable("laplacian_variance"), usable("block_mean_std_4x4")
    tags = F.array_compact(F.array(
        F.when(lap < limits.blur_laplacian_lt, "blur"),
        F.when(block > limits.local_block_std_gt, "local_illumination"),
        F.when(lap.isNull() | block.isNull(), "unclassified"),
    ))
    return df.withColumn(name, F.when(F.size(tags) == 0, F.array(F.lit("normal"))).otherwise(F.array_sort(tags)))


def parse_tags(text="tags") -> Column:
    """Sorted tags of a ``;`` list, NULL when the list is empty, repeats a tag, has an unknown one or mixes ``normal``."""
    parts = F.filter(F.transform(F.split(F.col(text), ";"), lambda t: F.trim(t)), lambda t: t != "")
    good = (
        (F.size(parts) > 0) & (F.size(F.array_distinct(parts)) == F.size(parts))
        & (F.size(F.array_except(parts, F.array(*[F.lit(t) for t in VALID_TAGS]))) == 0)
        & (~F.array_contains(parts, "normal") | (F.size(parts) == 1))
    )
    return F.when(good, F.array_sort(parts))


def row_tags(df: DataFrame, tags="tags", viewpoint="viewpoint", name: str = "tag") -> DataFrame:
    """One row per bucket an image counts in: all, each quality tag, and its viewpoint."""
    view = F.when(F.coalesce(F.col(viewpoint), F.lit("")) != "", F.concat(F.lit("vp_"), viewpoint))
    buckets = F.concat(F.array(F.lit("all")), F.split(F.col(tags), ";"), F.array_compact(F.array(view)))
    return df.withColumn(name, F.explode(buckets))


def gate_steps(images: DataFrame, steps: list[tuple[str, str]], tags="tags") -> DataFrame:
    """Which correction steps apply to which image, in order. ``steps`` is (step, apply_to); ``all`` always applies.

    ``tags`` is an array column.
    """
    plan = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("step"), F.lit(a).alias("apply_to")) for i, (s, a) in enumerate(steps)
    ])
    return images.select("image", tags, F.inline(plan)).filter(
        (F.col("apply_to") == "all") | F.array_contains(F.col(tags), F.col("apply_to"))
    ).select("image", "ordinal", "step")


def judged_tags(images: DataFrame, sharpness="sharpness", limit: float = 50.0, tags="tags") -> DataFrame:
    """Add blur_rt or not_blur_rt from the measured road sharpness."""
    return images.withColumn(tags, F.array_append(F.col(tags), F.when(F.col(sharpness) < limit, "blur_rt").otherwise("not_blur_rt")))


def folder_of(path: str) -> Column:
    """Parent folder name of a path, '' at the top level."""
    return F.regexp_extract(F.col(path), r"([^/]+)/[^/]*$", 1)


def source_of(name: str) -> Column:
    """Image stem without its trailing ``_digits``."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"_\d+$", "")


def country_of(name: str) -> Column:
    """Everything before the last underscore."""
    return F.regexp_extract(F.col(name), r"^(.*?)(?:_[^_]*)?$", 1)


def first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """Label of the first rule that holds; one expression, so the order is kept."""
    out = None
    for label, cond in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


# --- fixed values: thresholds of the attribution lists ------------------------------------------------------------
GREEN_SHARE, FAR_SHARE, BRIGHT_SHARE, LIGHT_STEP = 0.3, 0.25, 0.05, 40
ROAD_SHARE, PAINT_SHARE, SHADE_GRADIENT, SHORT_LENGTH = 0.5, 0.03, 6, 40
# ------------------------------------------------------------------------------------------------------------------


def false_alarm_source() -> Column:
    """Five sources from green, y2, frame_height, bright and light_range columns."""
    return first_rule([
        ("vegetation", F.col("green") >= GREEN_SHARE),
        ("far", F.col("y2") <= FAR_SHARE * F.col("frame_height")),
        ("marking", F.col("bright") >= BRIGHT_SHARE),
        ("shade_edge", F.col("light_range") >= LIGHT_STEP),
    ], "on_road")


def crack_alarm_source() -> Column:
    """Where a false crack sits, from touches_truth, road, paint, shade and length columns."""
    return first_rule([
        ("touches_truth", F.col("touches_truth")),
        ("off_road", F.col("road") < ROAD_SHARE),
        ("beside_paint", F.col("paint") >= PAINT_SHARE),
        ("shade_edge", F.col("shade") >= SHADE_GRADIENT),
        ("on_road_short", F.col("length") < SHORT_LENGTH),
    ], "on_road_long")


def discard_reason(min_length: float, min_elong: float, min_valley: float, min_depth: float, min_overlap: float = 0.5) -> Column:
    """Why a candidate was dropped, from type, road_overlap, length, elong, border, valley and depth columns."""
    crack = F.col("type") == "crack"
    return first_rule([
        ("kept", crack & (F.col("road_overlap") >= min_overlap)),
        ("off_road", crack),
        ("short", F.col("length") < min_length),
        ("elongation", F.col("elong") < min_elong),
        ("border", F.col("border")),
        ("one_sided", F.coalesce(F.col("valley") < min_valley, F.lit(False))),
        ("depth", F.coalesce(F.col("depth") < min_depth, F.lit(False))),
    ], "road_cues")


def _gamma_tests(rule: GammaRule) -> list[Column]:
    tests = []
    if rule.gray_mean_below is not None:
        tests.append(F.col("gray_mean") < rule.gray_mean_below)
    if rule.dark_ratio_above is not None:
        tests.append(F.col("dark_ratio") > rule.dark_ratio_above)
    return tests


def decide_gamma(df: DataFrame, rule: GammaRule = GammaRule()) -> DataFrame:
    """gamma_apply and gamma_reason per metrics row (gray_mean, dark_ratio, sufficient)."""
    if rule.mode == "off":
        apply, reason = F.lit(False), F.lit("mode_off")
    elif rule.mode == "fixed":
        apply = F.lit(rule.value != 1.0)
        reason = F.lit("fixed_mode" if rule.value != 1.0 else "gamma_is_1")
    else:
        tests = _gamma_tests(rule)
        missing = F.lit(False)
        for t in tests:
            missing = missing | t.isNull()
        hit = F.lit(rule.logic == "AND")
        for t in tests:
            hit = (hit & t) if rule.logic == "AND" else (hit | t)
        can = any(c < 1.0 for c in rule.candidates) if rule.selection == "adaptive" else rule.value != 1.0
        reason = (
            F.when(~F.col("sufficient"), "insufficient_analysis_pixels").when(missing, "metric_unavailable")
            .when(hit & F.lit(can), "conditions_met").when(hit, "gamma_is_1").otherwise("conditions_not_met")
        )
        apply = reason == "conditions_met"
    return df.withColumns({"gamma_apply": apply, "gamma_reason": reason})


def decide_gaussian(df: DataFrame, rule: GaussianRule = GaussianRule()) -> DataFrame:
    if rule.mode == "off":
        reason = F.lit("mode_off")
    elif rule.mode == "fixed":
        reason = F.lit("fixed_mode")
    else:
        reason = (
            F.when(~F.col("sufficient"), "insufficient_analysis_pixels").when(F.col("noise_sigma").isNull(), "metric_unavailable")
            .when(F.col("noise_sigma") >= rule.noise_threshold, "noise_sigma_at_or_above_threshold")
            .otherwise("noise_sigma_below_threshold")
        )
    return df.withColumns({
        "gaussian_reason": reason, "gaussian_apply": reason.isin("fixed_mode", "noise_sigma_at_or_above_threshold"),
    })
