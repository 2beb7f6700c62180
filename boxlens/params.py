"""Job parameters. Defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, fields

# --- fixed values -------------------------------------------------------------------------------------------------
KINDS = ("crack", "pothole")
CRITERIA = ("iou50", "iou30", "in50")
IOU_LIMITS = {"iou50": 0.5, "iou30": 0.3}
INSIDE_SHARE = 0.5
MIN_CONTROL_AREA = 400.0
CLASS_TO_KIND = {
    "longitudinal crack": "crack",
    "transverse crack": "crack",
    "alligator crack": "crack",
    "pothole": "pothole",
}
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
VALID_TAGS = ("blur", "local_illumination", "normal", "unclassified")
QUALITY_METRICS = (
    "gray_mean", "gray_std", "block_mean_std_4x4", "saturation_ratio",
    "dark_ratio", "bright_ratio", "hsv_v_mean", "laplacian_variance", "noise_sigma",
)
# ------------------------------------------------------------------------------------------------------------------


def from_mapping(cls, values: dict):
    """Build a parameter dataclass from a mapping; a key it does not know is an error, ``_`` keys are comments."""
    known = {f.name for f in fields(cls)}
    given = {k: v for k, v in values.items() if not k.startswith("_")}
    unknown = sorted(set(given) - known)
    if unknown:
        raise ValueError(f"{cls.__name__}: unknown keys {unknown}")
    return cls(**given)


@dataclass(frozen=True)
class QualityLimits:
    blur_laplacian_lt: float = 50.0
    local_block_std_gt: float = 44.0


@dataclass(frozen=True)
class ResizeParams:
    long_side: int = 1024
    allow_upscale: bool = True


@dataclass(frozen=True)
class ShapeRules:
    min_area_ratio: float = 0.0002
    crack_min_length: float = 0.0
    crack_min_elong: float = 3.0
    pothole_min_area_ratio: float = 0.002
    pothole_max_elong: float = 3.0


@dataclass(frozen=True)
class PotholeRules:
    chroma_max: float = 1.0
    dark_p10_min: float = 0.0
    aspect_max: float = 3.0
    min_rel_y: float = 0.0
    road_color_max: float | None = None


@dataclass(frozen=True)
class GammaRule:
    """When and how strongly to brighten dark road. A NULL threshold switches its condition off."""

    mode: str = "conditional"
    selection: str = "adaptive"
    value: float = 0.8
    candidates: tuple[float, ...] = (1.0, 0.9, 0.8, 0.7)
    logic: str = "AND"
    gray_mean_below: float | None = 80.0
    dark_ratio_above: float | None = 0.07
    max_saturation_ratio_after: float | None = 0.02


@dataclass(frozen=True)
class GaussianRule:
    """When to smooth."""

    mode: str = "off"
    sigma: float = 0.8
    kernel: int = 3
    noise_threshold: float = 0.6


@dataclass(frozen=True)
class MaskRules:
    """Inclusive limits on mask metrics; every enabled limit must hold."""

    mask_area_ratio_min: float | None = 0.1
    mask_area_ratio_max: float | None = None
    largest_component_ratio_min: float | None = 0.8
    hole_ratio_max: float | None = 0.15
    seed_consistency_min: float | None = 0.6
    undefined_metric_policy: str = "fail"
