"""Image folders: listing, decoding, naming, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import IMAGE_SUFFIXES


def file_name(path: str = "path") -> Column:
    return F.regexp_extract(F.col(path), r"([^/]*)$", 1)


def stem(path: str = "path") -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def relative(path: str, root: str) -> Column:
    """Path below ``root``, whatever scheme prefix the file system adds."""
    clean = root.rstrip("/")
    return F.regexp_replace(F.regexp_replace(F.col(path), r"^[a-z]+:/+", "/"), "^" + _quoted(clean) + "/+", "")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def is_image(path: str = "path") -> Column:
    """Known suffix, and no hidden part anywhere in the relative path."""
    p = F.lower(F.col(path))
    return p.rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + r")$") & ~F.concat(F.lit("/"), F.col(path)).rlike(r"/\.")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Images below a folder, sorted: path, rel, name, length. File contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    rel = files.withColumn("rel", relative("path", root))
    return rel.filter(is_image("rel")).withColumn("name", file_name("rel")).orderBy("rel")


def load_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: name, rel, ``image`` struct (BGR bytes) and ``valid``; unreadable files stay as invalid rows."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)
    rel = rows.withColumn("path", F.col("image.origin")).withColumn("rel", relative("path", root))
    ok = F.coalesce((F.col("image.nChannels") > 0) & (F.col("image.height") > 0) & (F.col("image.width") > 0), F.lit(False))
    return rel.filter(is_image("rel")).select(file_name("rel").alias("name"), "rel", "image", ok.alias("valid"))


def error_rows(images: DataFrame) -> DataFrame:
    """One status row per image; a file that could not be decoded is an error row and the batch goes on."""
    return images.select(
        "name", F.when(F.col("valid"), "success").otherwise("error").alias("status"),
        F.when(~F.col("valid"), F.lit("decode: not a readable image")).alias("error"),
    )


def image_id(rel: str = "rel") -> Column:
    """Relative path without suffix, parts joined by ``__``."""
    return F.regexp_replace(F.regexp_replace(F.col(rel), r"\.[^./]*$", ""), "/", "__")


def output_names(images: DataFrame, rel: str = "rel") -> DataFrame:
    """The bare stem, or the full id where several images share a stem. Stem counts are joined back, so a popular stem is
    counted map-side and not gathered."""
    s = images.withColumn("_stem", stem(rel))
    counts = s.groupBy("_stem").agg(F.count("*").alias("_n"))
    out = s.join(counts, "_stem")
    return out.withColumn("output_name", F.when(F.col("_n") == 1, F.col("_stem")).otherwise(image_id(rel))).drop("_stem", "_n")


def subset(images: DataFrame, split: DataFrame, part: str, key: str = "image") -> DataFrame:
    return images.join(split.filter(F.col("split") == part).select(key), key, "left_semi")


PROTECTED = ("rdd", "rdd_test")


def guard_dataset(name: str, allow: bool = False) -> str:
    """Refuse data sets that contain the protected split."""
    if name in PROTECTED and not allow:
        raise ValueError(f"{name} contains the protected test split")
    return name


def guard_protected(images: DataFrame, split: DataFrame, part: str = "test", allow: bool = False, key: str = "image") -> tuple[DataFrame, DataFrame]:
    """Images outside the protected split, and a one-row count of those held back."""
    blocked = split.filter(F.col("split") == part).select(key).distinct()
    held = images.join(blocked, key, "left_semi").agg(F.count("*").alias("n_blocked"))
    return (images if allow else images.join(blocked, key, "left_anti")), held


def pick_names(images: DataFrame, names: DataFrame, key: str = "image") -> tuple[DataFrame, DataFrame]:
    """Named images, and the names that were not found."""
    wanted = names.select(key).distinct()
    return images.join(wanted, key, "left_semi"), wanted.join(images.select(key), key, "left_anti")


def first_n(images: DataFrame, n: int, key: str = "image") -> DataFrame:
    return images.orderBy(key).limit(n)


def attach_viewpoint(images: DataFrame, viewpoints: DataFrame, key: str = "image") -> DataFrame:
    """Viewpoint labels for grouping only; images without one get ''."""
    return images.join(viewpoints.select(key, "viewpoint"), key, "left").fillna("", ["viewpoint"])
