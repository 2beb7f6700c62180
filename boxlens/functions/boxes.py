"""Box arithmetic as column expressions. A box is four double columns, corners exclusive on the far side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[str, str, str, str]

DET_BOX: Box = ("x1", "y1", "x2", "y2")
TRUTH_BOX: Box = ("gx1", "gy1", "gx2", "gy2")


def _c(name) -> Column:
    return name if isinstance(name, Column) else F.col(name)


def area(box=DET_BOX) -> Column:
    x1, y1, x2, y2 = map(_c, box)
    zero = F.lit(0.0)
    return F.greatest(x2 - x1, zero) * F.greatest(y2 - y1, zero)


def intersection(a=DET_BOX, b=TRUTH_BOX) -> Column:
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    return area((F.greatest(ax1, bx1), F.greatest(ay1, by1), F.least(ax2, bx2), F.least(ay2, by2)))


def iou(a=DET_BOX, b=TRUTH_BOX) -> Column:
    inter = intersection(a, b)
    return inter / (area(a) + area(b) - inter)


def inside_share(a=DET_BOX, b=TRUTH_BOX) -> Column:
    """Share of ``a`` lying in ``b``; areas under one pixel count as one pixel."""
    return intersection(a, b) / F.greatest(area(a), F.lit(1.0))


def overlaps(a=DET_BOX, b=TRUTH_BOX) -> Column:
    """Open-interval overlap on both axes."""
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    return (ax1 < bx2) & (bx1 < ax2) & (ay1 < by2) & (by1 < ay2)


def xyxy(x="x", y="y", w="w", h="h") -> list[Column]:
    x, y, w, h = map(_c, (x, y, w, h))
    return [x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")]


def ring_double(box: Box, width, height, pad: int = 6, guard: int = 2) -> dict[str, Column]:
    """Outer box of twice the size plus ``pad`` on each side, inner box grown by ``guard``; clipped to the frame."""
    x1, y1, x2, y2 = map(_c, box)
    width, height = _c(width), _c(height)
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    half_w, half_h = x2 - x1 + pad, y2 - y1 + pad
    zero = F.lit(0.0)

    def trunc(v):
        return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")

    return {
        "ox1": F.greatest(zero, trunc(cx - half_w)), "oy1": F.greatest(zero, trunc(cy - half_h)),
        "ox2": F.least(width, trunc(cx + half_w)), "oy2": F.least(height, trunc(cy + half_h)),
        "ix1": F.greatest(zero, x1 - guard), "iy1": F.greatest(zero, y1 - guard),
        "ix2": F.least(width, x2 + guard), "iy2": F.least(height, y2 + guard),
    }


def ring_half(box: Box, width, height) -> dict[str, Column]:
    """Outer box grown by half the box size on every side, inner box the box itself."""
    x1, y1, x2, y2 = map(_c, box)
    width, height = _c(width), _c(height)
    zero = F.lit(0.0)
    dx, dy = F.floor((x2 - x1) / 2).cast("double"), F.floor((y2 - y1) / 2).cast("double")
    return {
        "ox1": F.greatest(zero, x1 - dx), "oy1": F.greatest(zero, y1 - dy),
        "ox2": F.least(width, x2 + dx), "oy2": F.least(height, y2 + dy),
        "ix1": x1, "iy1": y1, "ix2": x2, "iy2": y2,
    }


def ring_grown(box: Box, width, height, factor: float = 1.0, pixels: float = 0.0) -> dict[str, Column]:
    """Outer box scaled about its centre by ``factor`` and then grown by ``pixels``."""
    x1, y1, x2, y2 = map(_c, box)
    width, height = _c(width), _c(height)
    zero = F.lit(0.0)
    dx = (x2 - x1) * ((factor - 1) / 2) + pixels
    dy = (y2 - y1) * ((factor - 1) / 2) + pixels
    return {
        "ox1": F.greatest(zero, F.floor(x1 - dx).cast("double")), "oy1": F.greatest(zero, F.floor(y1 - dy).cast("double")),
        "ox2": F.least(width, F.ceil(x2 + dx).cast("double")), "oy2": F.least(height, F.ceil(y2 + dy).cast("double")),
        "ix1": x1, "iy1": y1, "ix2": x2, "iy2": y2,
    }


def touches_border(width, height, sides: str = "t", margin: float = 2.0, x="x", y="y", w="w", h="h") -> Column:
    x, y, w, h, width, height = map(_c, (x, y, w, h, width, height))
    tests = {"t": y <= margin, "b": y + h >= height - margin, "l": x <= margin, "r": x + w >= width - margin}
    hit = F.lit(False)
    for side in sides:
        hit = hit | tests[side]
    return hit
