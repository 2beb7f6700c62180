"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, row_hash, rows_kept, staged, whole_text


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def content_groups(docs: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: ``digest, check, keep_id, group_size``.

    ``docs`` has ``id, text`` (normalised), ``digest`` and ``check``; ``hot`` lists the digests of very large groups.
    Texts are compared whole in each of the three steps, so a digest that two texts share never merges them:

    1. partial aggregation on (digest, salt, text) inside each input partition,
    2. merging of those partial rows by (digest, salt, text), large groups spread over ``salts`` reducers,
    3. combining of the salt winners of large groups by (digest, text); small groups pass with their text left behind.
    """
    salted = docs.join(F.broadcast(hot.select("digest", F.lit(True).alias("is_hot"))), "digest", "left").withColumn(
        "salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0))
    )
    winners = salted.groupBy("digest", "check", "salt", "is_hot", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return (
        winners.withColumn("text", F.when(F.col("is_hot"), F.col("text")))
        .groupBy("digest", "check", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count_if(F.col("is_hot").isNull()).alias("texts"))
        # equal in both hashes but not in content: refuse rather than merge
        .withColumn("group_size", F.when(F.col("texts") <= 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both hashes"))))
        .select("digest", "check", "keep_id", "group_size")
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lower_ascii, digest=sha256_digest, salts: int = 64, hot_groups: int = 1000) -> DataFrame:
    """One row per input row: ``id, digest, row_key, row_no, keep_id, group_size, kept``.

    Rows whose normalised texts are identical form a group; the row with the largest id stays.  Null text counts as
    empty.  A null id counts as smaller than any other; if all ids of a group are null, one of its rows stays.  Of rows
    that repeat both id and text one stays (the first as written, ``row_no`` tells them apart).  An empty table gives
    an empty result.  Other columns are not read, so their names cannot clash.

    A group counts as hot beyond one in ``hot_groups`` of all rows, so there are never more hot groups than that and
    only they are broadcast; every other join and grouping is by digest.
    """
    docs = df.select(F.col(id_col).alias("id"), row_hash(F.col(id_col), F.col(text_col)).alias("row_key"), normalise(whole_text(text_col)).alias("text")).withColumns({"digest": digest(F.col("text")), "check": F.xxhash64("text")})
    members = staged(docs.select("id", "row_key", "digest", "check", F.monotonically_increasing_id().alias("row_no")), "exact-members")
    sizes = members.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    total = members.agg((F.count(F.lit(1)) / hot_groups).alias("least"))
    hot = staged(sizes.filter("n > 1").join(F.broadcast(total), F.col("n") > F.col("least")).select("digest"), "exact-hot")
    groups = staged(content_groups(docs, hot, salts), "exact-groups")
    is_hot = F.broadcast(hot)
    keys = ["digest", "check"]
    cold_part = members.join(is_hot, "digest", "left_anti").join(groups.join(is_hot, "digest", "left_anti"), keys)
    hot_part = members.join(F.broadcast(groups.join(is_hot, "digest", "left_semi")), keys)
    joined = cold_part.unionByName(hot_part)
    first = members.groupBy("digest", "check", F.col("id").alias("id_")).agg(F.min("row_no").alias("first_no"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = (joined.digest == first.digest) & (joined.check == first.check) & joined.id.eqNullSafe(first.id_)
    winner = F.col("id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("row_no") == F.col("first_no"), F.lit(True))
    return (
        joined.join(first.select("digest", "check", "id_", "first_no"), twice, "left")
        .select("id", joined.digest, "row_key", "row_no", "keep_id", "group_size", winner.alias("kept"))
    )


def keep_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, whole and with all their columns, one of each group of equal texts."""
    return rows_kept(df, row_hash(F.col(id_col), F.col(text_col)), exact_dedup(df, id_col, text_col))
