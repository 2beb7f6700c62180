"""Mixing sources to target weights by Pareto order sampling.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, in_order, staged, whole_text, with_amount_before, word_count

#: plan tables of up to so many sources are broadcast, larger ones are joined by a shuffle
BROADCAST_SOURCES = 200_000


def uniform(seed: str, id_col: Column, text: Column) -> Column:
    """A number in (0, 1) from the md5 of seed, id and text: 52 bits, the same on every run and engine."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")), F.md5(whole_text(text))))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size, target`` of each source.

    Sources in code point order, null last, take the ``weights`` in turn and share the sum of all sizes by them.  A target
    stops at ``cap`` times its source's size; the excess is shared again by weight until none is above.  That ends where
    every source below its stop has the same target per weight, which is found in order of stop per weight.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("bigint"))
    stop = F.col("source_size") * cap
    ascending = Window.partitionBy().orderBy((stop / F.col("weight")), F.col("source").asc_nulls_last())
    ahead, behind = ascending.rowsBetween(Window.unboundedPreceding, -1), ascending.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(stop).over(ahead), F.lit(0))
    ranked = weighed.withColumn("level", left / F.sum("weight").over(behind)).withColumn("free", F.col("level") * F.col("weight") <= stop)
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(ascending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.coalesce(F.least(level * F.col("weight"), stop.cast("double")), stop.cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size, target, copies, cut``: every row of a source is taken ``copies`` times, and once more if its
    ``u`` is at or below ``cut``.

    A row's expected number of copies is target over source size.  Its whole part is certain.  The rest is its inclusion
    probability p in a Pareto sample: rows rank by (u / (1 - u)) / (p / (1 - p)), and the least ranks are taken while
    that brings their summed size nearer to what is left of the target.  The running sum is taken over a range-sorted
    table, so a source that holds most rows spreads over many tasks.
    """
    targets = source_targets(sized, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = staged(
        targets.withColumns({"copies": F.floor(rate), "p": rate - F.floor(rate)}).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets"
    )
    open_sources = plan.filter("p > 0").select(F.col("source").alias("_s"), "p", "rest")
    odds = lambda x: x / (1 - x)
    rows = _by_source(sized.filter("size > 0"), open_sources).withColumn("pareto", odds(F.col("u")) / odds(F.col("p")))
    ranked = in_order(rows.select("source", "pareto", "u", "size", "rest"), ["source", "pareto"], "mix-ranks")
    summed = with_amount_before(ranked, F.col("size"), "ahead", "source")
    cuts = summed.filter(F.col("ahead") + F.col("size") / 2 < F.col("rest")).groupBy(F.col("source").alias("_s")).agg(F.max("u").alias("cut"))
    return plan.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "copies", F.coalesce("cut", F.lit(-1.0)).alias("cut"))


def _by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined with a table of one row for each ``_s``."""
    small = table.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")


def sized_rows(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    text = F.col(text_col)
    return df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(whole_text(text_col)).alias("size"), uniform(seed, F.col(id_col), text).alias("u"))


def _taken(seeded: Column) -> Column:
    return F.col("copies") + (seeded <= F.col("cut")).cast("bigint")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """``id, size, source, source_size, target, times, taken`` of every row: how often the mix takes it, and words so taken.

    Null text is empty and null sources are one source.  Rows without words count for nothing.  Rows that repeat id and
    text share their random number, so all or none of them get the extra copy.  No row is taken more than ``cap`` times.
    A mix without any words takes nothing; an empty table gives an empty result.  Only the three named columns are read.
    """
    sized = staged(sized_rows(df, id_col, text_col, source_col, seed), "mix-sizes")
    plan = mix_plan(sized, weights, cap).withColumnRenamed("source", "_s")
    return _by_source(sized, plan).withColumn("times", _taken(F.col("u"))).select("id", "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, with all their columns.  The texts are not shuffled."""
    sized = staged(sized_rows(df, id_col, text_col, source_col, seed), "mix-sizes")
    plan = mix_plan(sized, weights, cap).select(F.col("source").alias("_mix_source"), F.col("copies").alias("_mix_copies"), F.col("cut").alias("_mix_cut"))
    u = fresh(df, "mix_u")
    rows = df.withColumn(u, uniform(seed, F.col(id_col), F.col(text_col)))
    small = plan.count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(plan) if small else plan, F.col(source_col).cast("string").eqNullSafe(F.col("_mix_source")))
    times = F.col("_mix_copies") + (F.col(u) <= F.col("_mix_cut")).cast("bigint")
    n = fresh(df, "mix_n")
    return joined.withColumn(n, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*df.columns)
