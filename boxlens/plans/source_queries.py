"""Queries over sources and sinks. Documents are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators.splits import hash_angle
from ..sources import images as I
from ..sources import runs as U
from ..sources import truth as T
from .boxes_queries import SCORES, scores_of
from .registry import query
from .stand_ins import Inputs, with_views
from .stats_queries import SPLIT, split_of

_FILE = "concat(source, '/', lang, CASE WHEN doc_id % 7 = 0 THEN '/.cache' ELSE '' END, '/', doc_id % 900, CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' ELSE '.webp' END)"


def files_of(i: Inputs):
    return i.table("documents").selectExpr("doc_id AS image", f"{_FILE} AS rel")


FILES = f"files AS (SELECT doc_id AS image, {_FILE} AS rel FROM documents)"


@query("A1_is_image", f"WITH {FILES} SELECT image, rel FROM files WHERE regexp_matches(lower(rel), '\\.(jpg|jpeg|png|bmp|tif|tiff|webp)$') AND NOT regexp_matches('/' || rel, '/\\.')")
def _(spark, sf):
    return files_of(Inputs(spark, sf)).filter(I.is_image("rel"))


@query("A3_subset", with_views("fx_strata", f", {SPLIT} SELECT image, source FROM fx_strata WHERE image IN (SELECT image FROM split WHERE split='dev')"))
def _(spark, sf):
    i = Inputs(spark, sf)
    return I.subset(i.strata, split_of(i).select("image", "split"), "dev").select("image", "source")


_TITLES = "['longitudinal crack','transverse crack','alligator crack','pothole','other corruption'][1 + gid % 5]"


def annotation_docs(i: Inputs):
    """One annotation document per image, corners in mixed order."""
    titles = F.array(*[F.lit(t) for t in ("longitudinal crack", "transverse crack", "alligator crack", "pothole", "other corruption")])
    flip = F.col("gid") % 2 == 0
    corner = lambda a, b, c, d: F.when(flip, F.array(F.array(a, b), F.array(c, d))).otherwise(F.array(F.array(c, b), F.array(a, d)))
    obj = F.struct(
        F.get(titles, (F.col("gid") % 5).cast("int")).alias("classTitle"), F.struct(corner("x1", "y1", "x2", "y2").alias("exterior")).alias("points"),
        F.array(F.struct(F.concat(F.lit("t"), (F.col("gid") % 3).cast("string")).alias("value"))).alias("tags"),
    )
    return i.truth.groupBy("image").agg(F.to_json(F.struct(F.collect_list(obj).alias("objects"))).alias("value"))


@query("A4_annotation_boxes", with_views("fx_truth", f""", t AS (SELECT *, {_TITLES} AS class_title FROM fx_truth) SELECT image, CASE WHEN class_title='pothole' THEN 'pothole' ELSE 'crack' END AS kind, x1, y1, x2, y2, class_title, 't' || CAST(gid % 3 AS VARCHAR) AS detail
    FROM t WHERE class_title <> 'other corruption'"""))
def _(spark, sf):
    docs = annotation_docs(Inputs(spark, sf)).select("image", F.from_json("value", T.ANNOTATION).alias("d")).select("image", "d.*")
    return T.annotation_boxes(docs).drop("gid")


_NAMED = "CASE WHEN image % 3 = 0 THEN concat('i', image, '.jpg') WHEN image % 3 = 1 THEN concat('i', image) ELSE concat('x', image, '.jpg') END"


@query("A5_truth_csv", with_views("fx_truth fx_images", """SELECT concat('i', t.image, '.jpg') AS image, kind, x1, y1, x2, y2 FROM fx_truth t JOIN fx_images i USING (image) WHERE t.image % 3 <> 2"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    rows = i.truth.selectExpr(f"{_NAMED} AS image", "x1 AS x", "y1 AS y", "x2-x1 AS w", "y2-y1 AS h", "CASE kind WHEN 'pothole' THEN 'Big Pothole' ELSE 'alligator' END AS type")
    return T.match_names(i.images.selectExpr("concat('i', image, '.jpg') AS image"), T.csv_boxes(rows))


@query("A6_truth_json", with_views("fx_truth fx_images", """SELECT CAST(i.image AS VARCHAR) AS image, kind, x1, y1, x2, y2 FROM fx_images i LEFT JOIN fx_truth t USING (image)"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    box = F.struct(F.col("kind").alias("class"), F.array("x2", "y1", "x1", "y2").alias("bbox_xyxy"))
    per = i.truth.groupBy("image").agg(F.collect_list(box).alias("boxes"))
    item = F.struct(F.col("image").cast("string").alias("source"), "boxes")
    docs = i.images.select("image").join(per, "image", "left").select(F.to_json(F.struct(F.array(item).alias("images"))).alias("value"))
    return T.truth_json_boxes(docs).drop("gid")


@query("A7_find_truth", with_views("fx_truth fx_images", """SELECT i.image, kind, gid, x1 + CASE WHEN i.image % 2 = 0 THEN 0 ELSE 100 END AS x1, CASE WHEN i.image % 2 = 0 THEN 0 ELSE 2 END AS source_rank
    FROM fx_images i LEFT JOIN fx_truth t ON t.image = i.image AND (i.image % 2 = 1 OR i.image % 4 = 0)"""))
def _(spark, sf):
    """The first source lists even images, half of them as undamaged; the last one stands for all the rest."""
    i = Inputs(spark, sf)
    first = (i.images.filter("image % 2 = 0"), i.truth.filter("image % 4 = 0"))
    return T.find_truth(i.images, [first, None, (None, i.truth.withColumn("x1", F.col("x1") + 100))]).select("image", "kind", "gid", "x1", "source_rank")


@query("A8_attach_viewpoint", with_views("fx_images", "SELECT image, CASE WHEN image % 5 = 0 THEN '' ELSE viewpoint END AS viewpoint FROM fx_images"))
def _(spark, sf):
    i = Inputs(spark, sf)
    return I.attach_viewpoint(i.images.select("image"), i.images.filter("image % 5 <> 0"))


@query("A9_image_id", f"WITH {FILES} SELECT image, replace(regexp_replace(rel, '\\.[^./]*$', ''), '/', '__') AS image_id FROM files")
def _(spark, sf):
    return files_of(Inputs(spark, sf)).select("image", I.image_id().alias("image_id"))


@query("A9_output_names", f"""WITH {FILES}, s AS (SELECT *, regexp_replace(regexp_extract(rel, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM files)
    SELECT image, CASE WHEN count(*) OVER (PARTITION BY stem) = 1 THEN stem ELSE replace(regexp_replace(rel, '\\.[^./]*$', ''), '/', '__') END AS output_name FROM s""")
def _(spark, sf):
    return I.output_names(files_of(Inputs(spark, sf))).select("image", "output_name")


@query("A10_guard_protected", with_views("fx_strata", f", {SPLIT} SELECT image, source FROM fx_strata WHERE image NOT IN (SELECT image FROM split WHERE split='test')"))
def _(spark, sf):
    i = Inputs(spark, sf)
    return I.guard_protected(i.strata, split_of(i).select("image", "split"))[0].select("image", "source")


@query("A10_blocked_count", with_views("fx_strata", f", {SPLIT} SELECT count(*) AS n_blocked FROM split WHERE split='test'"))
def _(spark, sf):
    i = Inputs(spark, sf)
    return I.guard_protected(i.strata, split_of(i).select("image", "split"))[1]


@query("A11_missing_names", with_views("fx_images fx_truth", "SELECT DISTINCT image + 7000 AS image FROM fx_truth WHERE image + 7000 NOT IN (SELECT image FROM fx_images)"))
def _(spark, sf):
    i = Inputs(spark, sf)
    return I.pick_names(i.images, i.truth.selectExpr("image + 7000 AS image"))[1]


@query("A12_first_n", with_views("fx_images", "SELECT image, tags FROM fx_images ORDER BY image LIMIT 40"))
def _(spark, sf):
    return I.first_n(Inputs(spark, sf).images, 40).select("image", "tags")


@query("A13_detections_json", with_views("fx_det fx_images", """SELECT CAST(i.image AS VARCHAR) AS image, kind, x1 AS x, y1 AS y, x2-x1 AS w, y2-y1 AS h FROM fx_images i LEFT JOIN fx_det d ON d.image=i.image AND d.detector='D2'"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    d = F.struct(F.col("kind").alias("type"), F.array(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"))
    per = i.det.filter("detector = 'D2'").groupBy("image").agg(F.collect_list(d).alias("ds"))
    docs = i.images.select("image").join(per, "image", "left").select(
        F.to_json(F.create_map(F.col("image").cast("string"), F.coalesce("ds", F.from_json(F.lit("[]"), "array<struct<type:string,bbox:array<double>>>")))).alias("value")
    )
    return T.detections_boxes(docs).drop("did")


@query("A14_read_run", with_views("fx_det fx_images", """SELECT i.image, d.did FROM fx_images i JOIN fx_det d ON d.image=i.image AND d.detector='D1' WHERE has_gt"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    rows = i.det.join(i.images.selectExpr("image", "CASE WHEN has_gt THEN 'True' ELSE 'False' END AS has_gt"), "image").withColumn("condition", F.lit("none"))
    return U.read_run(rows, "none/D1").select("image", "did")


@query("A15_different_images", with_views("fx_det", """, a AS (SELECT DISTINCT image FROM fx_det WHERE detector='D1'), b AS (SELECT DISTINCT image FROM fx_det WHERE detector='D2')
    SELECT coalesce(a.image, b.image) AS image, CASE WHEN b.image IS NULL THEN 'first' ELSE 'second' END AS only_in FROM a FULL JOIN b ON a.image=b.image WHERE a.image IS NULL OR b.image IS NULL"""))
def _(spark, sf):
    d = Inputs(spark, sf).det
    return U.different_images(d.filter("detector = 'D1'"), d.filter("detector = 'D2'"))


_WIDE = ", ".join(
    [f"max(CASE WHEN kind='{k}' THEN {c} END) AS {k}_{c}" for k in ("crack", "pothole") for c in ("n_gt", "n_cut", "n_det")]
    + [f"max(CASE WHEN kind='{k}' AND criterion='{c}' THEN {v} END) AS {k}_{c}_{v}" for k in ("crack", "pothole") for c in ("iou50", "iou30", "in50") for v in ("tp", "fp", "fn")]
)


@query("A16_wide_results", with_views("fx_det fx_truth fx_images", f", {SCORES} SELECT image, detector, {_WIDE} FROM scores GROUP BY ALL", recursive=True))
def _(spark, sf):
    return U.wide_results(scores_of(Inputs(spark, sf)))


@query("A17_ledger_rows", with_views("fx_det fx_truth fx_images", f""", {SCORES}, led AS (SELECT detector, kind, sum(n_gt) AS gt, sum(tp) AS hit, sum(fp) AS fake, sum(n_det) AS cands, count(DISTINCT image) AS n FROM scores WHERE criterion='in50' GROUP BY ALL)
    SELECT 'run_1' AS run, 'base' AS config, detector, CAST(max(n) AS BIGINT) AS n_images, CAST(max(CASE WHEN kind='crack' THEN hit END) AS BIGINT) AS crack_hit, CAST(max(CASE WHEN kind='pothole' THEN fake END) AS BIGINT) AS pothole_fake,
    max(CASE WHEN kind='crack' THEN round_even((cands-fake)/nullif(cands,0), 4) END) AS crack_precision, max(CASE WHEN kind='pothole' THEN round_even(fake/n, 2) END) AS pothole_fake_per_img FROM led GROUP BY detector""", recursive=True))
def _(spark, sf):
    rows = U.ledger_rows(scores_of(Inputs(spark, sf)), "run_1", {"config": "base"})
    return rows.select("run", "config", "detector", "n_images", "crack_hit", "pothole_fake", "crack_precision", "pothole_fake_per_img")


@query("A19_error_rows", """SELECT CAST(event_id AS VARCHAR) AS name, CASE WHEN user_id % 9 <> 0 THEN 'success' ELSE 'error' END AS status, CASE WHEN user_id % 9 = 0 THEN 'decode: not a readable image' END AS error FROM events""")
def _(spark, sf):
    e = Inputs(spark, sf).table("events").selectExpr("CAST(event_id AS STRING) AS name", "user_id % 9 <> 0 AS valid")
    return I.error_rows(e)


@query("E19_hash_angle", """, h AS (SELECT""".replace(", h", "WITH h") + """ doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)
    SELECT doc_id, list_reduce([CAST(('0x' || substr(h, 1 + 4*i, 4)) AS BIGINT) for i in range(0, 8)], lambda a, b: (a * 65536 + b) % 180) % 180 AS angle FROM h""")
def _(spark, sf):
    return Inputs(spark, sf).table("documents").select("doc_id", hash_angle("doc_id").alias("angle"))


@query("D23_flatten_metadata", """SELECT CAST(event_id AS VARCHAR) AS image_id, CASE WHEN user_id % 6 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN user_id % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS auto_validation,
    CASE WHEN user_id % 4 = 0 THEN 'no_seed;empty_mask' ELSE '' END AS fail_reasons, CASE WHEN user_id % 6 = 0 THEN 'gamma:failed' ELSE '' END AS errors, value AS initial_gray_mean, value * 2 AS final_gray_mean, user_id % 5 AS n_seeds FROM events""")
def _(spark, sf):
    from ..operators.reports import flatten_metadata

    strings = "array<string>"
    e = Inputs(spark, sf).table("events")
    null = F.lit(None)
    docs = e.select(
        F.col("event_id").cast("string").alias("image_id"), null.cast("string").alias("input_path"), F.expr("CASE WHEN user_id % 6 = 0 THEN 'error' ELSE 'success' END").alias("status"),
        F.struct(
            F.expr("CASE WHEN user_id % 4 = 0 THEN 'FAIL' ELSE 'PASS' END").alias("status"), F.expr("CASE WHEN user_id % 4 = 0 THEN array('no_seed', 'empty_mask') END").alias("fail_reasons"),
            F.struct((F.col("user_id") % 5).alias("n_seeds"), *[null.cast("double").alias(m) for m in ("mask_area_ratio", "largest_component_ratio", "hole_ratio", "seed_consistency")]).alias("metrics"),
        ).alias("validation"),
        F.struct(null.cast("string").alias("source")).alias("final_mask"), F.struct(F.lit(False).alias("required"), F.lit(False).alias("applied")).alias("manual_correction"),
        F.struct(F.lit(1).alias("pixels"), F.lit(True).alias("sufficient")).alias("analysis_mask"), F.struct(F.lit(True).alias("applied"), F.lit(0.8).alias("value_used"), F.lit("x").alias("reason")).alias("gamma"),
        F.struct(F.lit(True).alias("applied"), F.lit(0.8).alias("sigma_used"), F.lit("x").alias("reason")).alias("gaussian"), F.struct(F.lit(1.0).alias("total")).alias("timing_ms"),
        null.cast(strings).alias("warnings"), F.expr("CASE WHEN user_id % 6 = 0 THEN array(struct('gamma' AS stage, 'failed' AS message)) END").alias("errors"),
        F.struct(F.struct(F.col("value").alias("gray_mean")).alias("initial"), F.struct((F.col("value") * 2).alias("gray_mean")).alias("final")).alias("quality"),
    )
    flat = flatten_metadata(docs, ["gray_mean"])
    return flat.select("image_id", "status", "auto_validation", "fail_reasons", "errors", "initial_gray_mean", "final_gray_mean", "n_seeds")
