"""Channel expressions over b, g, r columns in 0-255."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: luma weights, sRGB and D65 constants -----------------------------------------------------------
LUMA = (0.114, 0.587, 0.299)
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
# ------------------------------------------------------------------------------------------------------------------


def _bgr(b, g, r):
    return [F.col(c) if isinstance(c, str) else c for c in (b, g, r)]


def gray(b="b", g="g", r="r", rounded: bool = True) -> Column:
    b, g, r = _bgr(b, g, r)
    v = b * LUMA[0] + g * LUMA[1] + r * LUMA[2]
    return F.floor(v + 0.5).cast("double") if rounded else v


def hsv(b="b", g="g", r="r") -> dict[str, Column]:
    """hue in degrees 0-360, sat and val in 0-255."""
    b, g, r = _bgr(b, g, r)
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = v - low
    hue = (
        F.when(d == 0, 0.0).when(v == r, (g - b) * 60.0 / d).when(v == g, 120.0 + (b - r) * 60.0 / d).otherwise(240.0 + (r - g) * 60.0 / d)
    )
    return {"hue": F.when(hue < 0, hue + 360.0).otherwise(hue), "sat": F.when(v == 0, 0.0).otherwise(d * 255.0 / v), "val": v}


def hue_plane(hue="hue", sat="sat") -> dict[str, Column]:
    """Hue and saturation as a point, so that medians and distances are meaningful."""
    a, s = F.radians(F.col(hue)), F.col(sat) / 255.0
    return {"cx": s * F.cos(a), "cy": s * F.sin(a)}


def chroma_plane(b="b", g="g", r="r") -> dict[str, Column]:
    """Brightness-free colour: red and green shares."""
    b, g, r = _bgr(b, g, r)
    total = b + g + r + 1
    return {"cr": r / total, "cg": g / total}


def lab(b="b", g="g", r="r") -> dict[str, Column]:
    """CIE L*a*b* of sRGB, L in 0-100."""
    b, g, r = _bgr(b, g, r)

    def linear(c):
        u = c / 255.0
        return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))

    lr, lg, lb = linear(r), linear(g), linear(b)
    x, y, z = [(lr * m[0] + lg * m[1] + lb * m[2]) / w for m, w in zip(XYZ, WHITE)]

    def f(t):
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)

    light = F.when(y > 0.008856, F.cbrt(y) * 116.0 - 16.0).otherwise(y * 903.3)
    return {"L": light, "a": (f(x) - f(y)) * 500.0, "bb": (f(y) - f(z)) * 200.0}


def colour_distance(one: tuple[str, str, str], other: tuple[str, str, str], lightness_weight: float = 0.35) -> Column:
    """Lab distance that discounts lightness, which shadows change most."""
    (l1, a1, b1), (l2, a2, b2) = [tuple(map(F.col, t)) for t in (one, other)]
    dl = (l1 - l2) * lightness_weight
    return F.sqrt(dl * dl + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2))


def paint(hue="hue", sat="sat", val="val") -> Column:
    """White or yellow road marking."""
    h, s, v = F.col(hue), F.col(sat), F.col(val)
    return ((v > 200) & (s < 40)) | ((h >= 30) & (h <= 70) & (s > 80) & (v > 120))


NOISE_FACTOR = math.sqrt(math.pi / 2)
