"""Stored runs: reading, checking, wide sinks, the run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import ledger_metrics


def read_run(rows: DataFrame, pick: str | None = None, config: list[str] = ["condition", "detector"]) -> DataFrame:
    """Rows of one run that have truth, for exactly one configuration. ``pick`` is 'condition/detector'.

    ``has_gt`` may be boolean or text from a CSV. More or fewer than one configuration is an error; the check reads only
    the distinct configurations.
    """
    truthy = F.lower(F.col("has_gt").cast("string")).isin("true", "1")
    kept = rows.filter(truthy)
    if pick is not None:
        kept = kept.filter(F.concat_ws("/", *config) == pick)
    found = kept.select(*config).distinct().limit(3).collect()
    if len(found) != 1:
        raise ValueError(f"expected one configuration, found {[tuple(r) for r in found]}")
    return kept


def different_images(a: DataFrame, b: DataFrame, key: str = "image") -> DataFrame:
    """Images present in only one of two runs."""
    both = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sides = both.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.filter("_a <> _b").select(key, F.when(F.col("_a") == 1, "first").otherwise("second").alias("only_in"))


def assert_same_images(a: DataFrame, b: DataFrame, key: str = "image") -> None:
    if not different_images(a, b, key).isEmpty():
        raise ValueError("the runs do not cover the same images")


def wide_results(scores: DataFrame, keys: list[str] = ["image", "detector"]) -> DataFrame:
    """One row per image and configuration with a column per kind, criterion and count. The columns are fixed, so no
    extra job has to discover them."""
    from ..params import CRITERIA, KINDS

    cols = []
    for k in KINDS:
        here = F.col("kind") == k
        cols += [F.max(F.when(here, F.col(c))).alias(f"{k}_{c}") for c in ("n_gt", "n_cut", "n_det")]
        for c in CRITERIA:
            at = here & (F.col("criterion") == c)
            cols += [F.max(F.when(at, F.col(v))).alias(f"{k}_{c}_{v}") for v in ("tp", "fp", "fn")]
    return scores.groupBy(*keys).agg(*cols)


def write_results(wide: DataFrame, path: str, run: str, fmt: str = "parquet") -> None:
    """Append a run's rows under its own partition."""
    out = wide.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run")
    (out.option("header", True).csv(path) if fmt == "csv" else out.parquet(path))


def ledger_rows(scores: DataFrame, run: str, meta: dict[str, str], keys: list[str] = ["detector"]) -> DataFrame:
    """One line per configuration: time stamp (UTC+9), run, meta columns and the rounded metrics of both kinds."""
    from ..params import KINDS

    long = ledger_metrics(scores, [*keys, "kind"])
    names = ["gt", "hit", "fake", "cands", "recall", "precision", "f1", "fake_per_img", "frag_per_hit", "precision_hit"]
    cols = [F.max(F.when(F.col("kind") == k, F.col(n))).alias(f"{k}_{n}") for k in KINDS for n in names]
    wide = long.groupBy(*keys).agg(F.max("n_images").alias("n_images"), *cols)
    when = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "+09:00"), "yyyy-MM-dd HH:mm")
    return wide.select(when.alias("when"), F.lit(run).alias("run"), *[F.lit(v).alias(k) for k, v in meta.items()], *wide.columns)


def append_ledger(scores: DataFrame, path: str, run: str, meta: dict[str, str] = {}) -> bool:
    """Append the run's lines to the ledger; nothing is written when no image had truth."""
    rows = ledger_rows(scores, run, meta)
    if scores.isEmpty():
        return False
    rows.write.mode("append").partitionBy("run").parquet(path)
    return True


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
