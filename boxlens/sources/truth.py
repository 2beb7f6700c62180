"""Truth and detection files in their three formats, to box tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import CLASS_TO_KIND
from .images import file_name

# --- fixed values: file schemas -----------------------------------------------------------------------------------
ANNOTATION = (
    "size struct<width:int,height:int>, objects array<struct<classTitle:string,points:struct<exterior:array<array<double>>>,"
    "tags:array<struct<value:string>>>>"
)
TRUTH_JSON = "struct<images:array<struct<source:string,boxes:array<struct<class:string,bbox_xyxy:array<double>>>>>>"
DETECTIONS = "map<string,array<struct<type:string,bbox:array<double>>>>"
TRUTH_CSV = "image string, x double, y double, w double, h double, type string"
SPLIT_CSV = "image string, source string, `group` string, has_damage int, n_crack int, n_pothole int, split string"
VIEWPOINT_CSV = "image string, viewpoint string, note string"
# ------------------------------------------------------------------------------------------------------------------


def kind_of(text: Column) -> Column:
    return F.when(F.lower(text).contains("pothole"), "pothole").otherwise("crack")


def class_kind(title: Column, class_map: dict[str, str] = CLASS_TO_KIND) -> Column:
    entries = [F.lit(v) for pair in class_map.items() for v in pair]
    return F.create_map(*entries)[title]


def annotation_boxes(docs: DataFrame, image: str = "image", class_map: dict[str, str] = CLASS_TO_KIND) -> DataFrame:
    """Boxes of parsed annotation documents (columns of ``ANNOTATION``). Corners may come in any order; classes outside
    the map are dropped. ``gid`` is the object's position in its document."""
    o = docs.select(F.col(image).alias("image"), F.posexplode("objects").alias("gid", "o"))
    a, b = F.col("o.points.exterior")[0], F.col("o.points.exterior")[1]
    return o.select(
        "image", class_kind(F.col("o.classTitle"), class_map).alias("kind"), F.col("gid").cast("bigint").alias("gid"),
        F.least(a[0], b[0]).alias("x1"), F.least(a[1], b[1]).alias("y1"), F.greatest(a[0], b[0]).alias("x2"), F.greatest(a[1], b[1]).alias("y2"),
        F.col("o.classTitle").alias("class_title"), F.array_join(F.transform("o.tags", lambda t: t["value"]), "; ").alias("detail"),
    ).filter("kind IS NOT NULL")


def read_annotations(spark: SparkSession, path: str, class_map: dict[str, str] = CLASS_TO_KIND) -> tuple[DataFrame, DataFrame]:
    """Annotation files (one per image, named ``<image>.json``): the images that have truth with their size, and the boxes.

    An image with a file but no boxes is known to be undamaged; an image without a file has no truth at all.
    """
    docs = spark.read.schema(ANNOTATION).option("multiLine", True).json(path)
    docs = docs.withColumn("image", F.regexp_replace(file_name("_metadata.file_path"), r"\.json$", ""))
    images = docs.select("image", F.col("size.width").cast("double").alias("width"), F.col("size.height").cast("double").alias("height"), F.lit(True).alias("has_gt"))
    return images, annotation_boxes(docs, class_map=class_map)


def csv_boxes(rows: DataFrame) -> DataFrame:
    """x, y, w, h rows to corner form; the kind is pothole when the type text says so, crack otherwise."""
    return rows.select("image", kind_of(F.col("type")).alias("kind"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))


def read_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    return csv_boxes(spark.read.schema(TRUTH_CSV).option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path))


def match_names(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes per listed image: rows under its file name, or, when it has none, rows under its stem. Images the file does
    not mention are undamaged, they simply have no rows."""
    named = images.select("image", F.regexp_replace("image", r"\.[^.]*$", "").alias("_stem"))
    listed = boxes.select("image").distinct()
    direct = named.join(listed, "image", "left_semi")
    by_stem = named.join(listed, "image", "left_anti").select("image", "_stem")
    renamed = boxes.withColumnRenamed("image", "_stem").join(by_stem, "_stem").drop("_stem")
    return boxes.join(direct.select("image"), "image", "left_semi").unionByName(renamed)


def truth_json_boxes(docs: DataFrame, text: str = "value") -> DataFrame:
    """{images: [{source, boxes: [{class, bbox_xyxy}]}]} documents to boxes; one row with NULL box per image without any."""
    d = docs.select(F.explode(F.from_json(text, TRUTH_JSON)["images"]).alias("i"))
    b = d.select(F.col("i.source").alias("image"), F.posexplode_outer("i.boxes").alias("gid", "b"))
    q = F.col("b.bbox_xyxy")
    return b.select(
        "image", F.col("gid").cast("bigint").alias("gid"), F.when(F.col("b").isNotNull(), kind_of(F.col("b.class"))).alias("kind"),
        F.least(q[0], q[2]).alias("x1"), F.least(q[1], q[3]).alias("y1"), F.greatest(q[0], q[2]).alias("x2"), F.greatest(q[1], q[3]).alias("y2"),
    )


def read_truth_json(spark: SparkSession, path: str) -> DataFrame:
    return truth_json_boxes(spark.read.text(path, wholetext=True))


def find_truth(images: DataFrame, sources: list[tuple[DataFrame | None, DataFrame] | None]) -> DataFrame:
    """Truth of each image from the first source responsible for it, with ``source_rank``.

    Sources come in order of priority, absent ones as None: the images a source lists (None: all of them) and its boxes.
    An image belongs to the first source that lists it, also if that has no boxes for it: then it is undamaged and keeps one
    row without a box. Boxes of later sources are never mixed in. An image that no source lists has no truth and no row.
    """
    present = [(i, *s) for i, s in enumerate(sources) if s is not None]
    if not present:
        raise ValueError("no truth source given")
    names = images.select("image").distinct()
    lists = [(names if listed is None else listed.select("image").distinct()).select("image", F.lit(i).alias("source_rank")) for i, listed, _ in present]
    owner = names.join(reduce(DataFrame.unionByName, lists).groupBy("image").agg(F.min("source_rank").alias("source_rank")), "image")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [boxes.withColumn("source_rank", F.lit(i)) for i, _, boxes in present])
    return owner.join(rows, ["image", "source_rank"], "left")


def detections_boxes(docs: DataFrame, text: str = "value") -> DataFrame:
    """{image: [{type, bbox}]} documents to detections; images without any keep one row with NULL did."""
    d = docs.select(F.explode(F.from_json(text, DETECTIONS)).alias("image", "ds"))
    e = d.select("image", F.posexplode_outer("ds").alias("did", "d"))
    q = F.col("d.bbox")
    return e.select("image", F.col("did").cast("bigint").alias("did"), F.col("d.type").alias("kind"), q[0].alias("x"), q[1].alias("y"), q[2].alias("w"), q[3].alias("h"))


def read_detections_json(spark: SparkSession, path: str) -> DataFrame:
    return detections_boxes(spark.read.text(path, wholetext=True))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPLIT_CSV).option("header", True).csv(path)


def read_viewpoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIEWPOINT_CSV).option("header", True).csv(path)
