"""Order statistics of large groups: running totals, exact percentiles, k-th values, AUC, best thresholds.

A window over a whole group would put the group in one task. Here values are first reduced to distinct values with counts
(hot values collapse map-side), then sorted into ranges over group and value, so a large group spreads over many of them; only a
range is ever summed in one task, and the ranges' totals, a row for each group in each range, carry the running total across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, hash_key
from ..session import checkpoint


def _same(by: list[str]) -> tuple[list[str], bool]:
    return (by, False) if by else (["_all"], True)


def running_totals(df: DataFrame, by: list[str], value: str, sums: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """One row per (by, value): each named sum for that value (``name``), up to and including it (``cum_name``) and over the
    whole group (``all_name``).

    Distinct values are cut into ``buckets`` ranges of (by, value), as many as there are shuffle partitions if not given.
    The ranges are stored, so every branch of the plan and every retry sees the same ones, and the input is read once.
    Nothing is joined or windowed on the group alone but the ranges' totals.
    """
    keys, whole = _same(by)
    if whole:
        df = df.withColumn("_all", F.lit(0))
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()])
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(rows.repartitionByRange(n, *keys, value).withColumn("_bucket", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.sum(f"_t_{n}").over(group).alias(f"all_{n}") for n in sums],
    )
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = placed.withColumns({f"_c_{n}": F.sum(n).over(inside) for n in sums})
    out = local.join(offsets, same)
    return out.select(*by, value, *sums, *[(F.col(f"_c_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in sums], *[f"all_{n}" for n in sums])


def exact_percentiles(df: DataFrame, by: list[str], value: str, qs: list[float], names: list[str] | None = None) -> DataFrame:
    """Linearly interpolated percentiles per group, one column per q. Groups may be arbitrarily large."""
    names = names or [f"p{round(q * 100):g}" for q in qs]
    ranked = running_totals(df, by, value, {"n": F.count("*")})
    keys, whole = _same(by)
    if whole:
        ranked = ranked.withColumn("_all", F.lit(0))
    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("all_n") - 1) * F.lit(float(q))
        aggs.append(F.min(F.when(F.col("cum_n") > F.floor(pos), F.col(value))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("cum_n") > F.ceil(pos), F.col(value))).alias(f"_hi{i}"))
    g = ranked.groupBy(*keys).agg(F.max("all_n").alias("_n"), *aggs)
    cols = []
    for i, (q, name) in enumerate(zip(qs, names)):
        pos = (F.col("_n") - 1) * F.lit(float(q))
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos))).alias(name))
    return g.select(*by, F.col("_n").alias("n"), *cols)


def kth_largest(df: DataFrame, value: str, k: int) -> DataFrame:
    """One row: the k-th largest value (NULL when there are fewer)."""
    cum = running_totals(df, [], value, {"n": F.count("*")})
    reached = (F.col("cum_n") > F.col("all_n") - k) & (F.col("all_n") >= k) & F.lit(k >= 1)
    return cum.agg(F.min(F.when(reached, F.col(value))).alias("threshold"))


def auc(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUC per group; ties count one half. NULL when a side is empty."""
    flagged = df.withColumn("_p", positive.cast("boolean"))
    cum = running_totals(flagged, by, value, {"pos": F.count_if("_p"), "neg": F.count_if(~F.col("_p"))})
    below = F.col("cum_neg") - F.col("neg")
    g = cum.groupBy(*by).agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("_w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    return g.select(*by, "n_pos", "n_neg", F.expr("try_divide(_w, double(n_pos) * n_neg)").alias("auc"))


def auc_of_max(df: DataFrame, by: list[str], cols: list[str], positive: Column) -> DataFrame:
    return auc(df.withColumn("_m", F.greatest(*cols)), by, "_m", positive)


def best_threshold(df: DataFrame, score: str, label: str, decimals: int = 1) -> DataFrame:
    """Thresholds t for "score < t means label": the most agreeing one and the one with the largest TPR - FPR.

    Candidates are the scores rounded to ``decimals``; ties go to the smallest.
    """
    y = F.col(label).cast("boolean")
    values = df.select(F.col(score).alias("t"), F.when(y, 1).otherwise(0).alias("p"), F.when(~y, 1).otherwise(0).alias("q"), F.lit(0).alias("c"))
    cuts = df.select(F.bround(F.col(score), decimals).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(1).alias("c"))
    cum = running_totals(values.unionByName(cuts), [], "t", {"p": F.sum("p"), "q": F.sum("q"), "c": F.max("c")})
    rows = cum.filter("c = 1").withColumns({
        "_P": F.col("all_p"), "_Q": F.col("all_q"), "hit": F.col("cum_p") - F.col("p"), "false_hit": F.col("cum_q") - F.col("q"),
    })
    rows = rows.withColumns({
        "agreement": (F.col("hit") + F.col("_Q") - F.col("false_hit")) / (F.col("_P") + F.col("_Q")),
        "gain": F.expr("try_divide(hit, _P) - try_divide(false_hit, _Q)"),
    })
    return rows.agg(
        F.max_by("t", F.struct("agreement", -F.col("t"))).alias("agree_threshold"), F.max("agreement").alias("agreement"),
        F.max_by("t", F.struct("gain", -F.col("t"))).alias("gain_threshold"), F.max("gain").alias("gain"),
    )


def threshold_table(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    y, options = F.col(label).cast("boolean"), F.array(*[F.lit(float(t)) for t in thresholds])
    d = df.select(F.col(score).alias("_s"), y.alias("_y"), F.explode(options).alias("threshold"))
    hit = F.col("_s") < F.col("threshold")
    return d.groupBy("threshold").agg(
        F.count_if(hit).alias("flagged"), F.avg((hit == F.col("_y")).cast("int")).alias("agreement"),
        F.avg(F.when(F.col("_y"), hit.cast("int"))).alias("caught"), F.avg(F.when(~F.col("_y"), hit.cast("int"))).alias("false_flagged"),
    )


def salted_top_k(df: DataFrame, by: list[str], order: list[Column], k: int, salt: Column, salts: int = 32) -> DataFrame:
    """First ``k`` rows per group. Each salt keeps its own first k before the group is merged, so a hot group is cut down
    in parallel; the result is the same for any salting."""
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    kept = rows.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r", "_salt")
    return kept.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= k).drop("_r")


def top_k_per_image(scores: DataFrame, k: int = 200_000, value: str = "v", tie: list[str] = ["y", "x"]) -> DataFrame:
    order = [F.col(value).desc(), *[F.col(t) for t in tie]]
    return salted_top_k(scores, ["image"], order, k, F.concat_ws("|", *tie))


def calibrate_threshold(reference: DataFrame, candidate: DataFrame, constant: float, value: str = "v", cap: int | None = None) -> DataFrame:
    """Threshold at which the candidate scores yield as many strong points as the reference scores >= ``constant``."""
    n_ref = reference.filter(F.col(value) >= constant).count()
    kept = candidate if cap is None else top_k_per_image(candidate, cap, value)
    return kth_largest(kept, value, n_ref).withColumn("n_ref", F.lit(n_ref).cast("bigint"))


def sampled_percentiles(scores: DataFrame, images: DataFrame, n_images: int, k: int, qs: list[float], seed=0, value: str = "v") -> DataFrame:
    """Percentiles over the first ``n_images`` images with at most ``k`` hash-drawn values each (a sampling operator)."""
    first = images.select("image").orderBy("image").limit(n_images)
    picked = scores.join(first, "image", "left_semi").withColumn("_h", hash_key(seed, "image", "y", "x"))
    kept = salted_top_k(picked, ["image"], [F.col("_h")], k, F.col("_h"))
    return exact_percentiles(kept, [], value, qs)


def ordinals(df: DataFrame, by: list[str], seed, key: str, name: str = "ordinal", digits: int = 2) -> DataFrame:
    """0-based position of every row in the md5 order of its group.

    Leading hex digits of the md5 split a group into ordered buckets; positions are counted inside a bucket and shifted by
    the sizes of the buckets before it. More ``digits`` for larger groups.
    """
    rows = df.withColumn("_h", hash_key(seed, key)).withColumn("_b", hash_bucket(F.col("_h"), digits))
    keys, whole = _same(by)
    if whole:
        rows = rows.withColumn("_all", F.lit(0))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", key)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_k"))
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_o"))
    out = rows.withColumn("_pos", F.row_number().over(inside)).join(offsets, [*keys, "_b"])
    return out.withColumn(name, (F.col("_pos") - 1 + F.col("_o")).cast("bigint")).drop("_h", "_b", "_pos", "_o", "_all")
