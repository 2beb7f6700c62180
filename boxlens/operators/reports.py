"""Summaries: ledgers, tag tables, profiles, status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import ratios
from ..params import KINDS
from ..session import large
from .membership import touching
from .predicates import folder_of, row_tags
from .ranks import exact_percentiles


def ledger_metrics(scores: DataFrame, by: list[str] = ["detector", "kind"]) -> DataFrame:
    """One line per configuration and kind under the inside criterion, rounded as the ledger stores it."""
    g = scores.filter("criterion = 'in50'").groupBy(*by).agg(
        F.sum("n_gt").alias("gt"), F.sum("tp").alias("hit"), F.sum("fp").alias("fake"), F.sum("n_det").alias("cands"),
        F.sum("fn").alias("_fn"), F.count_distinct("image").alias("n_images"),
    )
    m = ratios.prf_inside("hit", "fake", "_fn", "cands")
    old = ratios.prf("hit", "fake", "_fn")["precision"]
    return g.select(
        *by, "n_images", "gt", "hit", "fake", "cands",
        F.bround(m["recall"], 4).alias("recall"), F.bround(m["precision"], 4).alias("precision"), F.bround(m["f1"], 4).alias("f1"),
        F.bround(F.col("fake") / F.col("n_images"), 2).alias("fake_per_img"),
        F.bround(ratios.ratio(F.col("cands") - F.col("fake"), "hit"), 2).alias("frag_per_hit"),
        F.bround(old, 4).alias("precision_hit"),
    )


def summarize(scores: DataFrame, images: DataFrame, sep: DataFrame | None = None, clean: DataFrame | None = None, config: str = "detector") -> DataFrame:
    """Scores per configuration, tag, kind and criterion: sums first, ratios of sums after.

    ``images`` carries image, has_gt, tags, viewpoint. An image counts once in every one of its tags. ``clean`` lists images
    known to hold no damage: detections there per image are ``clean_fppi``. ``sep`` adds the separation columns.
    """
    tags = row_tags(images.filter("has_gt")).groupBy("image").agg(F.array_sort(F.collect_list("tag")).alias("_tags"))
    key, sums = ["image", config, "kind"], ["n_gt", "n_cut", "n_det", "tp", "fp", "fn"]
    # one row goes to its image for all criteria, and tags multiply sums of images that share them, not the images
    rows = scores.groupBy(*key).agg(F.collect_list(F.struct("criterion", *sums)).alias("_s"))
    if sep is not None:
        rows = rows.join(large(sep), key, "left")
    rows = rows.join(large(tags), "image")
    if clean is None:
        most = F.max(F.array_max(F.transform("_s", lambda r: r["n_gt"]))).over(Window.partitionBy("image"))
        rows = rows.withColumn("clean", F.coalesce(most == 0, F.lit(False)))
    else:
        rows = rows.join(large(clean.select("image").withColumn("clean", F.lit(True))), "image", "left").fillna(False, ["clean"])
    by = [config, "tag", "kind", "criterion"]
    extra = {} if sep is None else {"_sn": F.sum("n"), "_sh": F.sum("hit"), "_sf": F.sum("fhit")}
    added = {
        "n_images": F.count("*"), "n_images_clean": F.count_if("clean"), **{c: F.sum(c) for c in sums}, "_cd": F.sum(F.when(F.col("clean"), F.col("n_det"))), **extra,
    }
    alike = rows.select("*", F.inline("_s")).groupBy(config, "kind", "criterion", "_tags").agg(*[c.alias(n) for n, c in added.items()])
    g = alike.withColumn("tag", F.explode("_tags")).groupBy(*by).agg(*[F.sum(c).alias(c) for c in added])
    plain, two = ratios.prf(), ratios.prf_inside()
    inside = F.col("criterion") == "in50"
    out = g.withColumns({
        "cut_ratio": ratios.ratio("n_cut", "n_gt"),
        **{n: F.when(inside, two[n]).otherwise(plain[n]) for n in ("precision", "recall", "f1")},
        "fppi": F.col("fp") / F.col("n_images"),
        "clean_fppi": ratios.ratio("_cd", "n_images_clean"),
    })
    if sep is not None:
        out = out.withColumns({"sep_tpr": ratios.ratio("_sh", "_sn"), "sep_fpr": ratios.ratio("_sf", "_sn")})
        out = out.withColumn("separation", F.col("sep_tpr") - F.col("sep_fpr"))
    return out.drop("_cd", "_sn", "_sh", "_sf")


def mean_columns(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Null-skipping means of measured columns."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_images"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def _finite(c: str) -> Column:
    v = F.col(c)
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def summarize_status(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Attempted, success, skipped and failed rows; per metric the finite count and mean over successes only."""
    ok = F.col("status") == "success"
    cols = []
    for m in metrics:
        v = F.when(ok, _finite(m))
        cols += [F.count(v).alias(f"{m}_n"), F.avg(v).alias(f"mean_{m}")]
    return rows.groupBy(*by).agg(
        F.count("*").alias("attempted_n"), F.count_if(ok).alias("success_n"), F.count_if(F.col("status") == "skipped").alias("skipped_n"),
        F.count_if(F.col("status") == "failed").alias("failed_n"), *cols,
    )


def run_summary(rows: DataFrame) -> DataFrame:
    """Outcome counts of a batch run in one row, with the time statistics of all and of successful images."""
    ok = F.col("status") == "success"
    flag = {"gamma_applied": F.col("gamma_applied"), "gaussian_applied": F.col("gaussian_applied")}
    timed = F.inline(F.array(
        F.struct(F.lit("all").alias("scope"), F.col("time_ms").alias("t")),
        F.struct(F.lit("success").alias("scope"), F.when(ok, F.col("time_ms")).alias("t")),
    ))
    medians = exact_percentiles(rows.select(timed).filter("t IS NOT NULL"), ["scope"], "t", [0.5], ["median"])
    counts = rows.agg(
        F.count("*").alias("n_images"), F.count_if(ok).alias("success"),
        F.count_if(F.col("auto_validation") == "PASS").alias("auto_mask_pass"), F.count_if(F.col("auto_validation") == "FAIL").alias("auto_mask_fail"),
        F.count_if(F.col("status") == "manual_required").alias("manual_correction_required"),
        F.count_if("manual_applied").alias("manual_correction_applied"), F.count_if(F.col("status") == "error").alias("errors"),
        *[F.count_if(ok & c).alias(n) for n, c in flag.items()],
        *[f(t).alias(f"{n}_ms_{s}") for s, t in (("all", F.col("time_ms")), ("success", F.when(ok, F.col("time_ms"))))
          for n, f in (("mean", lambda c: F.round(F.avg(c), 1)), ("min", lambda c: F.round(F.min(c), 1)), ("max", lambda c: F.round(F.max(c), 1)))],
    ).withColumn("_k", F.lit(0))
    wide = medians.groupBy(F.lit(0).alias("_k")).agg(*[
        F.round(F.max(F.when(F.col("scope") == s, F.col("median"))), 1).alias(f"median_ms_{s}") for s in ("all", "success")
    ])
    return counts.join(wide, "_k").drop("_k")


def fail_reasons(rows: DataFrame, column: str = "fail_reasons") -> DataFrame:
    """How often each reason occurs; a reason is the part of an entry before its first blank."""
    reason = F.explode(F.filter(F.split(F.coalesce(F.col(column), F.lit("")), ";"), lambda t: t != ""))
    return rows.select(reason.alias("r")).groupBy(F.split("r", " ")[0].alias("reason")).agg(F.count("*").alias("n"))


def scoped_summary(scores: DataFrame, images: DataFrame, path: str = "path") -> DataFrame:
    """Ledger metrics for all images, per quality tag, and per folder when there is more than one."""
    folder = folder_of(path)
    many = images.select(folder.alias("f")).distinct().limit(2).count() > 1
    labels = F.concat(F.array(F.lit("all")), F.transform(F.filter(F.split("tags", ";"), lambda t: t != ""), lambda t: F.concat(F.lit("group:"), t)))
    if many:
        labels = F.concat(labels, F.array(F.concat(F.lit("folder:"), folder)))
    scoped = images.select("image", F.explode(labels).alias("scope"))
    return ledger_metrics(scores.join(large(scoped), "image"), ["scope", "detector", "kind"])


def subtype_recall(truth: DataFrame, found: DataFrame, cls: str = "class_title") -> DataFrame:
    """Found share per class title; ``found`` lists (image, gid) of the truths some detection lies in."""
    hit = truth.join(large(found.select("image", "gid").distinct().withColumn("_h", F.lit(1))), ["image", "gid"], "left")
    return hit.groupBy(cls).agg(F.count("*").alias("n"), F.count("_h").alias("hit"), (F.count("_h") / F.count("*")).alias("recall"))


def fp_breakdown(fakes: DataFrame, conditions: tuple[str, str], n_images: int, condition: str = "condition") -> DataFrame:
    """Per kind and source: fakes per image and share in two conditions, and the per-image difference."""
    a, b = conditions
    g = fakes.groupBy("kind", "source").agg(*[F.count_if(F.col(condition) == c).alias(f"_{i}") for i, c in enumerate((a, b))])
    totals = fakes.groupBy("kind").agg(*[F.count_if(F.col(condition) == c).alias(f"_t{i}") for i, c in enumerate((a, b))])
    j = g.join(totals, "kind")
    return j.select(
        "kind", "source", (F.col("_0") / n_images).alias("per_img_a"), ratios.ratio("_0", "_t0").alias("share_a"),
        (F.col("_1") / n_images).alias("per_img_b"), ratios.ratio("_1", "_t1").alias("share_b"),
        ((F.col("_1") - F.col("_0")) / n_images).alias("delta"),
    )


def loss_table(stages: DataFrame, cls: str = "kind") -> DataFrame:
    """Truths per class and furthest stage with their share of the class; class NULL is the total over classes."""
    g = stages.rollup("stage", cls).agg(F.count("*").alias("n"), F.grouping(cls).alias("_g"), F.grouping("stage").alias("_s"))
    cells = g.filter("_s = 0").select(F.when(F.col("_g") == 0, F.col(cls)).alias(cls), "stage", "n")
    totals = cells.groupBy(F.coalesce(F.col(cls), F.lit("")).alias("_c")).agg(F.sum("n").alias("_t"))
    return cells.join(totals, F.coalesce(F.col(cls), F.lit("")) == F.col("_c")).select(cls, "stage", "n", (F.col("n") / F.col("_t")).alias("share"))


def annotation_totals(images: DataFrame, boxes: DataFrame) -> DataFrame:
    per = boxes.groupBy("image").agg(F.count("*").alias("_n"))
    return images.select("image").join(large(per), "image", "left").fillna(0, ["_n"]).agg(
        F.count("*").alias("images"), F.sum("_n").alias("boxes"), F.count_if(F.col("_n") == 0).alias("empty_images"),
        F.avg("_n").alias("mean_boxes"), F.max("_n").alias("max_boxes"),
    )


def annotation_countries(images: DataFrame, boxes: DataFrame, country: str = "country") -> DataFrame:
    """Images, resolutions and boxes per country. A country's distinct resolutions are few; they are deduplicated before
    they are listed."""
    per = boxes.groupBy("image").agg(F.count("*").alias("_n"))
    size = F.concat_ws("x", F.col("width").cast("bigint"), F.col("height").cast("bigint"))
    known = images.select(country, size.alias("s")).distinct().groupBy(country).agg(F.array_join(F.array_sort(F.collect_list("s")), ", ").alias("resolutions"))
    counts = images.join(large(per), "image", "left").groupBy(country).agg(F.count("*").alias("images"), F.coalesce(F.sum("_n"), F.lit(0)).alias("boxes"))
    return counts.join(known, country)


def annotation_classes(boxes: DataFrame, images: DataFrame, countries: list[str], cls: str = "kind", country: str = "country") -> DataFrame:
    return boxes.join(large(images.select("image", country)), "image").groupBy(cls).agg(
        F.count("*").alias("total"), *[F.count_if(F.col(country) == c).alias(f"n_{c}") for c in countries]
    )


def box_shapes(boxes: DataFrame) -> DataFrame:
    """Width, height, short side, aspect, area share and vertical centre of each box; expects width and height columns
    of the frame."""
    w, h = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    return boxes.withColumns({
        "w": w, "h": h, "short": F.least(w, h), "aspect": F.greatest(w, h) / F.greatest(F.lit(1.0), F.least(w, h)),
        "area_share": w * h / (F.col("width") * F.col("height")), "y_rel": (F.col("y1") + F.col("y2")) / 2 / F.col("height"),
    })


SHAPE_COLUMNS = ["w", "h", "short", "aspect", "area_share", "y_rel"]


def shape_percentiles(boxes: DataFrame, qs: list[float], cls: str = "kind", columns: list[str] = SHAPE_COLUMNS) -> DataFrame:
    long = box_shapes(boxes).unpivot([cls], columns, "measure", "value")
    return exact_percentiles(long, [cls, "measure"], "value", qs)


def profile_boxes(boxes: DataFrame, cls: str = "kind", gap: float = 10.0) -> DataFrame:
    """Per class: boxes, median and largest count per image, share of boxes touching another of the class."""
    per = boxes.groupBy("image", cls).agg(F.count("*").alias("c"))
    median = exact_percentiles(per, [cls], "c", [0.5], ["median_per_image"]).drop("n")
    top = per.groupBy(cls).agg(F.sum("c").alias("n"), F.max("c").alias("max_per_image"))
    near = touching(boxes, gap, cls).groupBy(cls).agg(F.count("*").alias("_t"))
    return top.join(median, cls).join(near, cls, "left").withColumn("touching_share", F.coalesce(F.col("_t"), F.lit(0)) / F.col("n")).drop("_t")


def tag_values(boxes: DataFrame, cls: str = "kind", value: str = "detail") -> DataFrame:
    return boxes.groupBy(cls, value).agg(F.count("*").alias("n"))


def profile_quality(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Percentile table (0, 10, 50, 90, 100) of every metric."""
    long = rows.unpivot([], metrics, "metric", "value")
    return exact_percentiles(long, ["metric"], "value", [0.0, 0.1, 0.5, 0.9, 1.0])


def limit_counts(rows: DataFrame, limits: dict[str, Column]) -> DataFrame:
    """How many rows pass each named limit, in one pass."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in limits.items()])


def quartiles_by_kind(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return exact_percentiles(rows, by, value, [0.25, 0.5, 0.75])


def binned_mean(rows: DataFrame, x: str, y: str, edges: list[float]) -> DataFrame:
    """Count, mean and median of y for each half-open range of x."""
    bin_of = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        hit = (F.col(x) >= lo) & (F.col(x) < hi)
        bin_of = F.when(hit, i) if bin_of is None else bin_of.when(hit, i)
    placed = rows.select(bin_of.alias("bin"), F.col(y).alias("y")).filter("bin IS NOT NULL AND y IS NOT NULL")
    med = exact_percentiles(placed, ["bin"], "y", [0.5], ["median"]).drop("n")
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("mean")).join(med, "bin")


def before_after(rows: DataFrame, means: list[str], rates: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Means of columns and scaled ratios of sums (name -> numerator, denominator, factor) in one pass."""
    return rows.agg(
        *[F.avg(m).alias(f"mean_{m}") for m in means],
        *[(F.sum(n) * f / F.greatest(F.sum(d), F.lit(1))).alias(name) for name, (n, d, f) in rates.items()],
    )


def gap_profile(pieces: DataFrame, by: list[str], limits=(10, 20, 30, 45), turn_limit: float = 30.0) -> DataFrame:
    """Distribution of the gap and turn to the closest other piece, with the shares under each limit."""
    gap = exact_percentiles(pieces, by, "gap", [0.1, 0.5, 0.9], ["gap_p10", "gap_p50", "gap_p90"])
    turn = exact_percentiles(pieces, by, "turn", [0.1, 0.5, 0.9], ["turn_p10", "turn_p50", "turn_p90"]).drop("n")
    shares = pieces.groupBy(*by).agg(
        *[F.avg((F.col("gap") <= t).cast("int")).alias(f"gap_le_{t}") for t in limits], F.avg((F.col("turn") <= turn_limit).cast("int")).alias("turn_le_30")
    )
    return gap.join(turn, by).join(shares, by)


def largest_share(components: DataFrame) -> DataFrame:
    """Biggest component's share of the trace pixels of each image. ``components`` has image, label, size."""
    return components.groupBy("image").agg((F.max("size") / F.sum("size")).alias("share"))


def median_share(shares: DataFrame, by: list[str]) -> DataFrame:
    """Median over images of the biggest component's share, with the number of images."""
    return exact_percentiles(shares, by, "share", [0.5], ["share"])


def quality_change(initial: DataFrame, final: DataFrame, metrics: list[str]) -> DataFrame:
    j = initial.select("image", *[F.col(m).alias(f"_a_{m}") for m in metrics]).join(
        final.select("image", *[F.col(m).alias(f"_b_{m}") for m in metrics]), "image"
    )
    return j.select("image", *[(F.col(f"_b_{m}") - F.col(f"_a_{m}")).alias(m) for m in metrics])


def state_shares(states: DataFrame, by: list[str]) -> DataFrame:
    """Shares of matchable, overflowing and short boxes among truths and controls, and their difference.

    ``states`` has by, is_truth and state (M, overflow, short or NULL); a truth without a state counts as none of them.
    """
    t, c = F.col("is_truth"), ~F.col("is_truth") & F.col("state").isNotNull()

    def share(side, value):
        return F.avg(F.when(side, F.coalesce(F.col("state") == value, F.lit(False)).cast("int")))

    g = states.groupBy(*by).agg(
        F.count_if(t).alias("n_truth"), F.count_if(c).alias("n_control"), share(t, "M").alias("m"), share(c, "M").alias("m_control"),
        share(t, "overflow").alias("overflow"), share(t, "short").alias("short"),
    )
    return g.withColumn("m_prime", F.col("m") - F.col("m_control"))


def review_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def flatten_metadata(meta: DataFrame, metrics: list[str]) -> DataFrame:
    """One flat row per image from the nested processing record."""
    errors = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["stage"], e["message"])), ";")
    return meta.select(
        "image_id", "input_path", "status", F.col("validation.status").alias("auto_validation"),
        F.array_join(F.coalesce(F.col("validation.fail_reasons"), F.array().cast("array<string>")), ";").alias("fail_reasons"),
        F.col("final_mask.source").alias("final_mask_source"), F.col("manual_correction.required").alias("manual_required"),
        F.col("manual_correction.applied").alias("manual_applied"), F.col("validation.metrics.n_seeds").alias("n_seeds"),
        F.col("analysis_mask.pixels").alias("analysis_pixels"), F.col("analysis_mask.sufficient").alias("analysis_sufficient"),
        F.col("gamma.applied").alias("gamma_applied"), F.col("gamma.value_used").alias("gamma_value"), F.col("gamma.reason").alias("gamma_reason"),
        F.col("gaussian.applied").alias("gaussian_applied"), F.col("gaussian.sigma_used").alias("gaussian_sigma"),
        F.col("gaussian.reason").alias("gaussian_reason"), F.col("timing_ms.total").alias("time_ms"),
        F.array_join(F.coalesce(F.col("warnings"), F.array().cast("array<string>")), ";").alias("warnings"), F.coalesce(errors, F.lit("")).alias("errors"),
        *[F.col(f"validation.metrics.{m}").alias(m) for m in ("mask_area_ratio", "largest_component_ratio", "hole_ratio", "seed_consistency")],
        *[F.col(f"quality.initial.{m}").alias(f"initial_{m}") for m in metrics], *[F.col(f"quality.final.{m}").alias(f"final_{m}") for m in metrics],
    )
