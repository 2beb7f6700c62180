"""Moving boxes between the original frame and the cropped, resized frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..params import ResizeParams
from ..session import large


def crop_geometry(images: DataFrame, default_roi: str = "bottom_half", resize: ResizeParams = ResizeParams()) -> DataFrame:
    """Crop rectangle and output size per image.

    ``images`` has image, original_width, original_height and optionally ``roi``: ``full``, ``bottom_half``,
    ``bottom_<N>`` (percent kept, 1-100) or ``x,y,width,height``. A NULL roi takes ``default_roi``. Rounding is
    half-even. Rows whose roi is malformed or leaves the frame get ``valid`` = false.
    """
    w, h = F.col("original_width").cast("bigint"), F.col("original_height").cast("bigint")
    roi = F.coalesce(F.col("roi"), F.lit(default_roi)) if "roi" in images.columns else F.lit(default_roi)
    percent = F.try_to_number(F.nullif(F.regexp_extract(roi, r"^bottom_(\d+)$", 1), F.lit("")), F.lit("999")).cast("int")
    box = F.when(roi.rlike(r"^\d+,\d+,\d+,\d+$"), F.transform(F.split(roi, ","), lambda v: v.cast("bigint")))
    half = F.floor(h / 2).cast("bigint")
    kept = F.greatest(F.lit(1), F.bround(h * percent / 100.0, 0).cast("bigint"))
    ok_percent = percent.between(1, 100)

    def pick(full, bottom_half, bottom_n, explicit) -> Column:
        return (
            F.when(roi == "full", full).when(roi == "bottom_half", bottom_half).when(ok_percent, bottom_n).when(box.isNotNull(), explicit)
        )

    zero = F.lit(0).cast("bigint")
    crop = images.select(
        "image", w.alias("original_width"), h.alias("original_height"),
        pick(zero, zero, zero, box[0]).alias("crop_x"), pick(zero, half, h - kept, box[1]).alias("crop_y"),
        pick(w, w, w, box[2]).alias("crop_width"), pick(h, h - half, kept, box[3]).alias("crop_height"),
    )
    valid = F.coalesce(
        (F.col("crop_width") >= 1) & (F.col("crop_height") >= 1)
        & (F.col("crop_x") + F.col("crop_width") <= F.col("original_width"))
        & (F.col("crop_y") + F.col("crop_height") <= F.col("original_height")),
        F.lit(False),
    )
    scale = F.lit(float(resize.long_side)) / F.greatest("crop_width", "crop_height")
    if not resize.allow_upscale:
        scale = F.least(scale, F.lit(1.0))
    sized = crop.withColumn("valid", valid).withColumn("_s", F.when(F.col("valid"), scale))
    for side in ("width", "height"):
        out = F.greatest(F.lit(1), F.bround(F.col(f"crop_{side}") * F.col("_s"), 0).cast("bigint"))
        sized = sized.withColumn(f"output_{side}", F.when(F.col("valid"), out))
    return sized.select(
        *crop.columns, "output_width", "output_height",
        F.expr("try_divide(output_width, crop_width)").alias("scale_x"), F.expr("try_divide(output_height, crop_height)").alias("scale_y"),
        "valid",
    )


def to_crop(boxes: DataFrame, geometry: DataFrame) -> DataFrame:
    """Boxes in output coordinates, clamped to the frame; boxes outside it are dropped."""
    g = geometry.select("image", "crop_x", "crop_y", "scale_x", "scale_y", "output_width", "output_height")
    zero = F.lit(0.0)

    def lo(v, axis):
        return F.greatest(zero, (F.col(v) - F.col(f"crop_{axis}")) * F.col(f"scale_{axis}"))

    def hi(v, axis, size):
        return F.least(F.col(size).cast("double"), (F.col(v) - F.col(f"crop_{axis}")) * F.col(f"scale_{axis}"))

    moved = boxes.join(large(g), "image").withColumns({
        "x1": lo("x1", "x"), "y1": lo("y1", "y"), "x2": hi("x2", "x", "output_width"), "y2": hi("y2", "y", "output_height"),
    })
    return moved.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).select(*boxes.columns)


def count_cut(boxes: DataFrame, cropped: DataFrame) -> DataFrame:
    """Boxes the crop removed, per image and kind. One pass over the tagged union, no join."""
    both = boxes.select("image", "kind", F.lit(1).alias("_n")).unionByName(cropped.select("image", "kind", F.lit(-1).alias("_n")))
    return both.groupBy("image", "kind").agg(F.sum("_n").cast("bigint").alias("n_cut"))


def to_original(det: DataFrame, geometry: DataFrame) -> DataFrame:
    """Detections (x, y, w, h) back in original pixels."""
    g = geometry.select("image", "crop_x", "crop_y", "scale_x", "scale_y")
    return det.join(large(g), "image").withColumns({
        "x": F.col("x") / F.col("scale_x") + F.col("crop_x"), "y": F.col("y") / F.col("scale_y") + F.col("crop_y"),
        "w": F.col("w") / F.col("scale_x"), "h": F.col("h") / F.col("scale_y"),
    }).select(*det.columns)


def mask_bbox(mask_pixels: DataFrame, frame: DataFrame, margin: int = 0) -> DataFrame:
    """Bounding rectangle of the true pixels per image, grown by ``margin`` and clamped to the frame."""
    box = mask_pixels.groupBy("image").agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2")
    )
    j = box.join(large(frame.select("image", "width", "height")), "image")
    x0, y0 = F.greatest(F.lit(0), F.col("x1") - margin), F.greatest(F.lit(0), F.col("y1") - margin)
    x9 = F.least(F.col("width"), F.col("x2") + 1 + margin)
    y9 = F.least(F.col("height"), F.col("y2") + 1 + margin)
    return j.select("image", x0.alias("x"), y0.alias("y"), (x9 - x0).alias("w"), (y9 - y0).alias("h"))


def ring_columns(det: DataFrame, rings: dict[str, Column]) -> DataFrame:
    return det.withColumns(rings)


def box_tiles(df: DataFrame, box: B.Box, tile: float) -> DataFrame:
    """Rows repeated once per grid tile their box touches; for joins of boxes with pixels."""
    x1, y1, x2, y2 = map(F.col, box)
    return df.filter((x1 < x2) & (y1 < y2)).withColumn(
        "_tx", F.explode(F.sequence(F.floor(x1 / tile), F.floor((x2 - 1e-9) / tile)))
    ).withColumn("_ty", F.explode(F.sequence(F.floor(y1 / tile), F.floor((y2 - 1e-9) / tile))))


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, box: B.Box = B.DET_BOX, tile: float = 64.0, on=("image",)) -> DataFrame:
    """Join every pixel with the boxes that hold it (x1 <= x < x2). Equi join on image and tile."""
    p = pixels.withColumn("_tx", F.floor(F.col("x") / tile)).withColumn("_ty", F.floor(F.col("y") / tile))
    b = box_tiles(boxes, box, tile)
    x1, y1, x2, y2 = map(F.col, box)
    return p.join(large(b), [*on, "_tx", "_ty"]).filter(
        (F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2)
    ).drop("_tx", "_ty")


def road_overlap(det: DataFrame, mask_pixels: DataFrame, frame: DataFrame, tile: float = 64.0) -> DataFrame:
    """Share of each detection's pixels that lie in the mask, four decimals; 0 for a box outside the frame.

    Corners are rounded half-even to whole pixels and clamped; a box keeps at least one pixel of width and height.
    """
    f = frame.select("image", "width", "height")

    def px(c):
        return F.bround(c, 0).cast("bigint")

    j = det.join(large(f), "image").withColumns({
        "_x1": F.greatest(F.lit(0), px(F.col("x"))), "_y1": F.greatest(F.lit(0), px(F.col("y"))),
    })
    j = j.withColumns({
        "_x2": F.least(F.col("width"), px(F.col("x")) + F.greatest(px(F.col("w")), F.lit(1))),
        "_y2": F.least(F.col("height"), px(F.col("y")) + F.greatest(px(F.col("h")), F.lit(1))),
    })
    keyed = j.select("image", "did", *[F.col(c).cast("double") for c in ("_x1", "_y1", "_x2", "_y2")])
    inside = pixels_in_boxes(mask_pixels.select("image", "y", "x"), keyed, ("_x1", "_y1", "_x2", "_y2"), tile)
    counts = inside.groupBy("image", "did").agg(F.count("*").alias("_n"))
    size = (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1"))
    ok = (F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1"))
    share = F.when(ok, F.coalesce(F.col("_n"), F.lit(0)) / size).otherwise(0.0)
    return j.join(counts, ["image", "did"], "left").select(*det.columns, F.round(share, 4).alias("road_overlap"))


def on_road(det: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    return det.withColumn("on_road", F.col("road_overlap") >= min_overlap)


def on_road_counts(det: DataFrame, by: list[str]) -> DataFrame:
    return det.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("on_road").alias("n_on_road"), F.count_if(~F.col("on_road")).alias("n_off_road")
    )
