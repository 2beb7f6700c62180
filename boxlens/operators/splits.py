"""Exact stratified splits, hash subsets and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, hash_uniform, md5_divmod
from .ranks import ordinals


def stratified_systematic_split(
    rows: DataFrame, strata: list[str], frac: float, seed=20261006, key: str = "image",
    picked: str = "test", rest: str = "dev", digits: int = 2, start: float | None = None,
) -> DataFrame:
    """Systematic sampling through hash-shuffled strata laid end to end.

    With the running position n of a row, it is picked iff floor(u + n f) > floor(u + (n - 1) f), which is the closed form
    of an accumulator carried across the strata: the total share is exact to one row, and each stratum's to one row.
    """
    placed = ordinals(rows, strata, seed, key, name="_i", digits=digits)
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("_k"))
    # one row per stratum, a handful of category levels
    before = Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    u = F.lit(start) if start is not None else hash_uniform(hash_key(seed, F.lit("start")))
    n = F.col("_i") + F.col("_o") + 1
    hit = F.floor(u + n * frac) > F.floor(u + (n - 1) * frac)
    return placed.join(offsets, strata).withColumn("split", F.when(hit, picked).otherwise(rest)).drop("_i", "_o")


def split_balance(split: DataFrame, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """Rows per level of each column on either side, and the share of the second side."""
    levels = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]))
    g = split.select("split", levels).groupBy("column", "level").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in names])
    return g.withColumn("share", F.col(f"n_{names[1]}") / (F.col(f"n_{names[0]}") + F.col(f"n_{names[1]}")))


def sample_n(rows: DataFrame, n: int, seed, key: str) -> DataFrame:
    """``n`` rows in hash order: a distributed top-n, no shuffle of the table."""
    return rows.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def hash_subset(rows: DataFrame, frac: float, levels: list[float], name: str = "image", prefix: str = "mixed:") -> DataFrame:
    """Rows whose name hash falls under ``frac``, with a level picked by further digits of the same hash."""
    digest = F.md5(F.concat(F.lit(prefix), F.col(name).cast("string")))
    low, pick = md5_divmod(digest, 10000, len(levels))
    options = F.array(*[F.lit(float(v)) for v in levels])
    return rows.withColumns({"_low": low, "level": F.get(options, pick.cast("int"))}).filter(F.col("_low") / 10000 < frac).drop("_low")


def hash_angle(name: str = "image") -> "F.Column":
    """Whole degrees 0-179 fixed by the md5 of a name."""
    return md5_divmod(F.md5(F.col(name).cast("string")), 180)[0]


def closest_to_target(levels: DataFrame, by: list[str], level: str, measured: str, target: float) -> DataFrame:
    gap = F.abs(F.col(measured) - target)
    return levels.groupBy(*by).agg(F.min_by(F.struct(level, measured), F.struct(gap, F.col(level))).alias("_b")).select(*by, "_b.*")
