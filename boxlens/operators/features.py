"""Feature ranking, cut rules, sweeps over parameter grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import ratios
from ..params import INSIDE_SHARE
from ..session import checkpoint, large
from .matching import GROUP_PAIR_LIMIT, _greedy_count, _greedy_in_rounds, as_truth, oversized_groups, overlap_pairs
from .ranks import auc, exact_percentiles


def feature_medians(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return exact_percentiles(long, by, value, [0.5], ["median"])


def cut_table(long: DataFrame, losses=(0.05, 0.10), feature: str = "feature", value: str = "value", real: str = "real") -> DataFrame:
    """Per feature: AUC, the side to drop, and for each accepted loss of real rows the threshold and share of fakes cut."""
    is_real = F.col(real).cast("boolean")
    ranked = auc(long, [feature], value, is_real).select(feature, "auc")
    qs, names = [], []
    for loss in losses:
        qs += [loss, 1 - loss]
        names += [f"_low_{loss}", f"_high_{loss}"]
    edges = exact_percentiles(long.filter(is_real), [feature], value, qs, [f"q{i}" for i in range(len(qs))]).drop("n")
    j = ranked.join(edges, feature).withColumn("drop_low", F.col("auc") >= 0.5)
    for i, loss in enumerate(losses):
        j = j.withColumn(f"threshold_{round(loss * 100)}", F.when(F.col("drop_low"), F.col(f"q{2 * i}")).otherwise(F.col(f"q{2 * i + 1}")))
    # one row per feature: bounded by the feature list
    limits = j.drop(*[f"q{i}" for i in range(len(qs))])
    fakes = long.filter(~is_real).join(limits, feature)
    cut = []
    for loss in losses:
        t = F.col(f"threshold_{round(loss * 100)}")
        out = F.when(F.col("drop_low"), F.col(value) < t).otherwise(F.col(value) > t)
        cut.append(F.avg(out.cast("int")).alias(f"cut_{round(loss * 100)}"))
    return limits.join(fakes.groupBy(feature).agg(*cut), feature)


def greedy_filters(rows: DataFrame, features: list[str], cap: float = 0.10, min_gain: float = 0.15, loss: float = 0.05, real: str = "real") -> list[dict]:
    """Add one-feature filters while they pay: each round takes the feature that cuts most remaining fakes at ``loss`` of
    the remaining real rows, if at least ``min_gain``; stop before the total loss of real rows passes ``cap``.

    Every round is a job over the remaining rows; the driver only sees one line per feature.
    """
    kept, left, steps = rows, list(features), []
    total = rows.filter(F.col(real).cast("boolean")).count()
    while left and total:
        long = kept.unpivot([real], left, "feature", "value")
        table = cut_table(long, (loss,), real=real).collect()
        name = f"{round(loss * 100)}"
        passing = [r for r in table if r[f"cut_{name}"] is not None and r[f"cut_{name}"] >= min_gain]
        if not passing:
            break
        best = min(passing, key=lambda r: (-r[f"cut_{name}"], left.index(r["feature"])))
        t = best[f"threshold_{name}"]
        col = F.col(best["feature"])
        narrowed = kept.filter(col >= t if best["drop_low"] else col <= t)
        size = narrowed.agg(F.count_if(F.col(real).cast("boolean")).alias("r"), F.count_if(~F.col(real).cast("boolean")).alias("f")).first()
        if 1 - size["r"] / total > cap:
            break
        kept = checkpoint(narrowed)  # the chain of filters stays one filter long
        left.remove(best["feature"])
        steps.append({
            "step": len(steps) + 1, "feature": best["feature"], "drop_low": best["drop_low"], "threshold": float(t),
            "gain": float(best[f"cut_{name}"]), "n_real": size["r"], "n_fake": size["f"],
        })
    return steps


def threshold_sweep(blobs: DataFrame, areas: list[float], elongs: list[float], n_boxes: int, upper: bool = False) -> DataFrame:
    """Kept count, purity, box recall and F1 for every area x elongation limit; best cell first by F1.

    ``blobs`` has area_ratio, elong, inside (boolean) and box (NULL outside). ``upper``: elongation is an upper limit.
    """
    cells = [(float(a), float(e)) for a in areas for e in elongs]
    shape = (lambda e: F.col("elong") < e) if upper else (lambda e: F.col("elong") >= e)
    passes = [F.coalesce((F.col("area_ratio") >= a) & shape(e), F.lit(False)) for a, e in cells]
    counts = blobs.agg(*[c for i, ok in enumerate(passes) for c in (
        F.count_if(ok).alias(f"_k{i}"), F.avg(F.when(ok, F.col("inside").cast("int"))).alias(f"_p{i}"))])
    # a box is one row with a bit for each cell that some blob of it passes
    words = range(-(-len(cells) // 62))
    bits = [sum((F.when(ok, F.lit(1 << i % 62)).otherwise(F.lit(0)).cast("bigint") for i, ok in enumerate(passes) if i // 62 == w), F.lit(0).cast("bigint")) for w in words]
    boxes = blobs.filter("box IS NOT NULL").select("box", *[c.alias(f"_w{w}") for w, c in enumerate(bits)]).groupBy("box").agg(*[F.bit_or(f"_w{w}").alias(f"_w{w}") for w in words])
    found = boxes.agg(*[F.count_if(F.getbit(F.col(f"_w{i // 62}"), F.lit(i % 62)) == 1).alias(f"_b{i}") for i in range(len(cells))])
    rows = F.array(*[F.struct(
        F.lit(a).alias("min_area"), F.lit(e).alias("elong_limit"), F.col(f"_k{i}").alias("kept"), F.coalesce(f"_p{i}", F.lit(0.0)).alias("purity"), F.col(f"_b{i}").alias("_b")
    ) for i, (a, e) in enumerate(cells)])
    out = counts.crossJoin(found).select(F.inline(rows)).withColumn("recall", F.col("_b") / max(n_boxes, 1)).drop("_b")
    return out.withColumn("f1", ratios.harmonic(F.col("purity"), F.col("recall")))


def best_cell(sweep: DataFrame) -> DataFrame:
    """The sweep row with the largest F1; ties go to the smaller area, then the smaller elongation limit."""
    cols = sweep.columns
    return sweep.agg(F.max_by(F.struct(*cols), F.struct("f1", -F.col("min_area"), -F.col("elong_limit"))).alias("b")).select("b.*")


def grid_search(
    cands: DataFrame, truth: DataFrame, images: DataFrame, grid: list[dict[str, float]], lower: list[str] = [], tile: float = 512.0,
    limit: int = GROUP_PAIR_LIMIT,
) -> DataFrame:
    """Hits, fakes, misses and fakes per image of every parameter setting on every split part.

    Each setting limits columns of ``cands`` (upper limits, or lower limits for the names in ``lower``). The overlap join
    runs once; settings multiply only the pairs that pass, and counts are combined before the shuffle.
    """
    names = list(grid[0])
    settings = F.array(*[F.struct(F.lit(i).alias("grid"), *[F.lit(float(g[n])).alias(f"_lim_{n}") for n in names]) for i, g in enumerate(grid)])
    ok = F.lit(True)
    for n in names:
        ok = ok & ((F.col(n) >= F.col(f"_lim_{n}")) if n in lower else (F.col(n) <= F.col(f"_lim_{n}")))

    def passing(df):
        return df.select("*", F.inline(settings)).filter(ok).drop(*[f"_lim_{n}" for n in names])

    split = images.select("image", "split")
    n_det = passing(cands).join(large(split), "image").groupBy("grid", "split").agg(F.count("*").alias("n_det"))
    pairs = overlap_pairs(cands, as_truth(truth.select("image", "kind", "gid", *B.DET_BOX)), ["image", "kind"], tile=tile)
    pairs = pairs.withColumn("inside", B.inside_share()).filter(F.col("inside") >= INSIDE_SHARE).select("image", "kind", "did", "gid", "inside", *names)
    by, keys = ["grid", "image", "kind"], ["image", "kind"]
    big = oversized_groups(cands, truth, keys, keys, limit)
    small = pairs if big is None else pairs.join(big, keys, "left_anti")
    grouped = passing(small).groupBy(*by).agg(
        F.collect_list(F.struct("inside", F.col("did").cast("bigint").alias("did"), F.col("gid").cast("bigint").alias("gid"))).alias("_p")
    )
    per_image = grouped.select(
        "grid", "image", _greedy_count(F.col("_p"), "inside").cast("bigint").alias("tp"),
        F.size(F.array_distinct(F.transform("_p", lambda p: p["did"]))).cast("bigint").alias("inside"),
    )
    if big is not None:
        hot = checkpoint(passing(pairs.join(big, keys, "left_semi")).select(*by, F.col("inside").alias("score"), "did", "gid"))
        tp = _greedy_in_rounds(hot, by).groupBy(*by).agg(F.count("*").alias("tp"))
        inside = hot.groupBy(*by).agg(F.count_distinct("did").alias("inside"))
        per_image = per_image.unionByName(inside.join(tp, by).select("grid", "image", "tp", "inside"))
    hits = per_image.join(large(split), "image").groupBy("grid", "split").agg(F.sum("tp").alias("tp"), F.sum("inside").alias("n_inside"))
    parts = split.groupBy("split").agg(F.count("*").alias("n_images"))
    n_gt = truth.join(large(split), "image").groupBy("split").agg(F.count("*").alias("n_gt"))
    base = parts.join(n_gt, "split", "left").withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    rows = base.join(n_det, ["grid", "split"], "left").join(hits, ["grid", "split"], "left").fillna(0)
    return rows.select(
        "grid", "split", "tp", (F.col("n_det") - F.col("n_inside")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"),
        ((F.col("n_det") - F.col("n_inside")) / F.col("n_images")).alias("fppi"),
    )


def pick_setting(results: DataFrame, budget: float, part: str = "tune") -> DataFrame:
    """Most hits within the fakes-per-image budget on ``part``, then fewest fakes; the row of every part of that setting."""
    results = checkpoint(results)  # a row for each setting and part, read twice
    fit = results.filter((F.col("split") == part) & (F.col("fppi") <= budget))
    best = fit.agg(F.max_by("grid", F.struct("tp", -F.col("fppi"), -F.col("grid"))).alias("grid"))
    return results.join(F.broadcast(best), "grid")
