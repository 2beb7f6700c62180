"""Helpers the operators share: staged tables, ranges of an order, the k-th row of a huge ranking."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: slots of the filters in front of joins: their broadcasts never exceed so many numbers
SLOTS = 1 << 20
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.  Only a local master may lack it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, and a lost executor costs a reread."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(col: str | Column = "text") -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(col: Column) -> Column:
    """Number of maximal runs of anything but blanks, tabs and line ends."""
    marked = F.translate(col, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(marked, " ", -1), lambda w: w != "")).cast("bigint")


def row_hash(*cols: Column) -> Column:
    """128 bits over the columns as they stand, nulls told from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("0")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_kept(df: DataFrame, key: Column, decided: DataFrame, one_each: bool = True) -> DataFrame:
    """Rows of ``df`` by the decisions ``row_key, kept``: whole rows, one for each key that is kept.

    A key without a kept row loses all its rows.  A key that occurs more than once and is kept is reduced to one row
    (``one_each``), with a partial aggregation before the shuffle, or else keeps all of them.
    """
    name = fresh(df, "row_key")
    keyed = df.withColumn(name, key)
    keys = decided.groupBy("row_key").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    special = staged(keys.filter(~F.col("kept") | (F.col("n") > 1) if one_each else ~F.col("kept")).select(F.col("row_key").alias(name), "kept"), "rows-kept")
    # most rows share a slot with no special key and stay where they are; only the others are shuffled
    slot = fresh(keyed, "slot")
    dealt = keyed.withColumn(slot, F.pmod(F.xxhash64(name), F.lit(SLOTS)).cast("int"))
    slots = F.broadcast(special.select(F.pmod(F.xxhash64(name), F.lit(SLOTS)).cast("int").alias(slot)).distinct())
    free, near = dealt.join(slots, slot, "left_anti").drop(slot), dealt.join(slots, slot, "left_semi").drop(slot)
    once = free.unionByName(near.join(special.select(name), name, "left_anti"))
    if not one_each:
        return once.select(*df.columns)
    repeated = near.join(special.filter("kept").select(name), name, "left_semi").dropDuplicates([name])
    return once.unionByName(repeated).select(*df.columns)


def join_groups(rows: DataFrame, groups: DataFrame, keys: str | list[str], size: str, hot_groups: int = 1000) -> DataFrame:
    """``rows`` joined with ``groups``, one row for each value of ``keys`` with its number of rows in ``size``.

    Values with more than one in ``hot_groups`` of all rows, of which there are at most ``hot_groups``, are joined by
    broadcast where their rows lie; all others by a shuffle on the keys.
    """
    keys = [keys] if isinstance(keys, str) else keys
    least = groups.agg((F.sum(size) / hot_groups).alias("_least"))
    hot = staged(groups.filter(F.col(size) > 1).join(F.broadcast(least), F.col(size) > F.col("_least")).drop("_least"), "hot-groups")
    names = F.broadcast(hot.select(*keys))
    cold = rows.join(names, keys, "left_anti").join(groups.join(names, keys, "left_anti"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``: a filter of bounded size in front of a join.

    Keys fall into a fixed number of slots, and rows of slots without a wanted key are left behind before the shuffle.
    None that is wanted is lost; with very many wanted keys all slots fill and nothing is saved.
    """
    slot = lambda: F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("_slot")
    slots = wanted.select(slot()).distinct()
    return rows.withColumn("_slot", slot()).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")


def range_bounds(df: DataFrame, order: str, n: int) -> list[int]:
    """Up to ``n`` values of the bigint column ``order``, ascending from its least, that cut it into ranges of about equal row counts.

    Each bound is the least value in its range, exactly.
    """
    quantiles = df.agg(F.percentile_approx(order, [i / n for i in range(n)], max(10_000, 20 * n)).alias("q")).first().q or []
    rough = sorted(set(quantiles))
    least = df.groupBy(range_of(F.col(order), rough).alias("r")).agg(F.min(order).alias("v")).collect()
    return sorted({r.v for r in least if r.v is not None})


def range_of(col: Column, bounds: list[int]) -> Column:
    """Index of the last bound at or below ``col`` by binary search; 0 below all of them and for null."""
    if len(bounds) < 2:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    top = 1 << (len(bounds) - 1).bit_length() - 1
    steps = F.split(F.lit(",".join(str(top >> i) for i in range(top.bit_length()))), ",").cast("array<int>")
    at = lambda i, s: F.when((i + s < len(bounds)) & (F.get(table, i + s) <= col), i + s).otherwise(i)
    return F.coalesce(F.aggregate(steps, F.lit(0), at), F.lit(0))


def in_order(df: DataFrame, order: list, name: str, **options) -> DataFrame:
    """``df`` written in ascending ``order`` and read back with ``file_no`` and ``row_index``, which together are that order.

    One range shuffle; a hot value of the first column splits where a later column differs.
    """
    path = new_path(df.sparkSession, name)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**options).parquet(path)
    return read_in_order(df.sparkSession, path, df.schema)


def read_in_order(spark: SparkSession, path: str, schema) -> DataFrame:
    number = lambda i: F.regexp_extract("_metadata.file_name", r"^part-(\d+)-.*-c(\d+)", i).cast("bigint")
    return spark.read.schema(schema).parquet(path).select("*", (number(1) * 1000000 + number(2)).alias("file_no"), F.col("_metadata.row_index").alias("row_index"))


def with_amount_before(ordered: DataFrame, amount: Column, out: str, group: str | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Adds the bigint ``out``: the sum of ``amount`` over the rows before this one (of the same ``group``).

    Each file is summed on its own and shifted by the totals of the files before it; only those totals, a row for each
    file and group in it, meet in one place.  ``totals`` gives those (keys and ``_t``) where they are cheaper to have otherwise.
    """
    keys = ["file_no"] + ([group] if group else [])
    rows = ordered.withColumn("_amount", amount.cast("bigint"))
    totals = rows.groupBy(*keys).agg(F.sum("_amount").alias("_t")) if totals is None else totals
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_start"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys).orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, same).withColumn(out, F.col("_start") + F.coalesce(F.sum("_amount").over(inside), F.lit(0))).drop("_amount", "_start", *[f"_k{i}" for i in range(len(keys))])


class Memo:
    """Remembered results of a function of strings inside one Python worker, in two generations of at most ``limit`` entries.

    What a batch needs moves to the young generation; when that is full it becomes the old one, and what nobody asked for since
    is forgotten.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def filled(self, keys: Iterable[str], compute: Callable[[list[str]], Iterable[bytes]]) -> dict[str, bytes]:
        """A dictionary that holds at least ``keys``, which are distinct."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = [k for k in keys if k not in young]
        if old:
            young.update((k, old[k]) for k in new if k in old)
            new = [k for k in new if k not in young]
        if new:
            young.update(zip(new, compute(new)))
        return young
