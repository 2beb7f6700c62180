"""Queries over row rules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import ratios
from ..operators import matching as M
from ..operators import membership as S
from ..operators import predicates as P
from ..operators import reports as D
from ..params import GammaRule, GaussianRule, PotholeRules
from ..session import large
from .boxes_queries import BEST, BY, CONTROL, INSIDE_T, SCORED, SCORES, STAGES, TRUTH_BY, frame_of, scores_of
from .registry import query
from .stand_ins import DETECTORS, Inputs, with_views
from .stats_queries import rounded

# measured rows: quality-like metrics per image from the orders table
QUALITY = """quality AS (SELECT o_orderkey AS image, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey % 130 + 0.0e0 END AS laplacian_variance,
    CASE WHEN o_custkey % 13 = 0 THEN NULL WHEN o_custkey % 17 = 0 THEN -1.0e0 ELSE o_custkey % 88 + 0.0e0 END AS block_mean_std_4x4,
    CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE o_custkey % 160 + 0.0e0 END AS gray_mean, o_custkey % 100 / 500.0e0 AS dark_ratio,
    CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE o_custkey % 20 / 10.0e0 END AS noise_sigma, o_custkey % 7 <> 0 AS sufficient FROM orders)"""


def quality_of(i: Inputs):
    return i.table("orders").selectExpr(
        "o_orderkey AS image", "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE double(o_custkey % 130) END AS laplacian_variance",
        "CASE WHEN o_custkey % 13 = 0 THEN NULL WHEN o_custkey % 17 = 0 THEN -1.0D ELSE double(o_custkey % 88) END AS block_mean_std_4x4",
        "CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE double(o_custkey % 160) END AS gray_mean", "o_custkey % 100 / 500.0D AS dark_ratio",
        "CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE o_custkey % 20 / 10.0D END AS noise_sigma", "o_custkey % 7 <> 0 AS sufficient",
    )


# candidates with shape and cue columns from the detections
SHAPED = """shaped AS (SELECT image, detector, did, kind, x1, y1, x2, y2, (x2-x1)*(y2-y1) AS area, greatest(x2-x1, y2-y1) AS length,
    greatest(x2-x1, y2-y1)/least(x2-x1, y2-y1) AS elong, CASE WHEN did // 10 % 3 = 0 THEN 'pothole' ELSE 'crack' END AS branch,
    CASE WHEN did // 10 % 5 <> 0 THEN did // 10 % 31 / 10.0e0 END AS energy, did // 10 % 13 / 10.0e0 AS depth, did // 10 % 37 / 20.0e0 AS chroma,
    did // 10 % 11 / 10.0e0 - 0.3e0 AS dark_p10, CASE WHEN did // 10 % 4 <> 0 THEN did // 10 % 29 / 10.0e0 END AS road_color, did // 10 % 10 / 10.0e0 AS share FROM fx_det)"""


def shaped_of(i: Inputs):
    return i.det.selectExpr(
        "*", "(x2-x1)*(y2-y1) AS area", "greatest(x2-x1, y2-y1) AS length", "greatest(x2-x1, y2-y1)/least(x2-x1, y2-y1) AS elong",
        "CASE WHEN did div 10 % 3 = 0 THEN 'pothole' ELSE 'crack' END AS branch",
        "CASE WHEN did div 10 % 5 <> 0 THEN did div 10 % 31 / 10.0D END AS energy", "did div 10 % 13 / 10.0D AS depth", "did div 10 % 37 / 20.0D AS chroma",
        "did div 10 % 11 / 10.0D - 0.3D AS dark_p10", "CASE WHEN did div 10 % 4 <> 0 THEN did div 10 % 29 / 10.0D END AS road_color",
        "did div 10 % 10 / 10.0D AS share",
    )


@query("B11_classify_shape", with_views("fx_det", f""", {SHAPED} SELECT image, detector, did, CASE WHEN area/1000000.0e0 < 0.0002 THEN 'noise'
    WHEN branch='crack' AND elong >= 3 THEN 'crack' WHEN branch='pothole' AND area/1000000.0e0 >= 0.002 AND elong < 3 THEN 'pothole' ELSE 'noise' END AS type FROM shaped"""))
def _(spark, sf):
    s = shaped_of(Inputs(spark, sf)).withColumn("frame_area", F.lit(1000000.0))
    return P.classify_shape(s).select("image", "detector", "did", "type")


@query("B12_cue_filter", with_views("fx_det", f", {SHAPED} SELECT image, detector, did FROM shaped WHERE coalesce(energy <= 1.608, true) AND depth >= 0.267"))
def _(spark, sf):
    s = shaped_of(Inputs(spark, sf)).withColumn("cues", F.create_map(F.lit("energy"), F.col("energy"), F.lit("depth"), F.col("depth")))
    return P.cue_filter(s, {"energy": 1.608, "depth_min": 0.267}).select("image", "detector", "did")


@query("B13_verify_pothole", with_views("fx_det", f""", {SHAPED} SELECT image, detector, did FROM shaped WHERE chroma <= 1 AND dark_p10 >= 0 AND elong <= 3
    AND (y1+y2)/2/440.0e0 >= 0.4 AND coalesce(road_color <= 2.0, true)"""))
def _(spark, sf):
    s = shaped_of(Inputs(spark, sf)).selectExpr("*", "elong AS aspect", "(y1+y2)/2/440.0D AS rel_y")
    return P.verify_pothole(s, PotholeRules(min_rel_y=0.4, road_color_max=2.0)).select("image", "detector", "did")


@query("B14_classify_quality", f"""WITH {QUALITY}, u AS (SELECT image, CASE WHEN laplacian_variance >= 0 THEN laplacian_variance END AS l,
    CASE WHEN block_mean_std_4x4 >= 0 THEN block_mean_std_4x4 END AS b FROM quality),
    t AS (SELECT image, concat_ws(';', CASE WHEN l < 50 THEN 'blur' END, CASE WHEN b > 44 THEN 'local_illumination' END, CASE WHEN l IS NULL OR b IS NULL THEN 'unclassified' END) AS tags FROM u)
    SELECT image, CASE WHEN tags = '' THEN 'normal' ELSE tags END AS tags FROM t""")
def _(spark, sf):
    return P.classify_quality(quality_of(Inputs(spark, sf))).select("image", F.array_join("tags", ";").alias("tags"))


_TAG_TEXT = """CASE o_custkey % 7 WHEN 0 THEN 'normal' WHEN 1 THEN ' blur ;local_illumination' WHEN 2 THEN 'normal;blur' WHEN 3 THEN 'blur;blur' WHEN 4 THEN ''
    WHEN 5 THEN 'local_illumination;;blur' ELSE 'dusty' END"""


@query("B15_parse_tags", """SELECT o_orderkey AS image, CASE o_custkey % 7 WHEN 0 THEN 'normal' WHEN 1 THEN 'blur,local_illumination' WHEN 5 THEN 'blur,local_illumination' END AS tags FROM orders""")
def _(spark, sf):
    t = Inputs(spark, sf).table("orders").selectExpr("o_orderkey AS image", f"{_TAG_TEXT} AS tags")
    return t.select("image", F.array_join(P.parse_tags("tags"), ",").alias("tags"))


@query("B16_row_tags", with_views("fx_images", """SELECT image, unnest(list_concat(['all'], string_split(tags, ';'), ['vp_' || viewpoint])) AS tag FROM fx_images"""))
def _(spark, sf):
    return P.row_tags(Inputs(spark, sf).images).select("image", "tag")


@query("B17_gate_steps", with_views("fx_images", """, s AS (SELECT * FROM (VALUES (0, 'clahe', 'blur'), (1, 'gaussian', 'not_blur_rt'), (2, 'line_close', 'all'), (3, 'unsharp', 'blur_rt')) v(ordinal, step, apply_to)),
    t AS (SELECT image, list_append(string_split(tags, ';'), CASE WHEN image % 90 < 50 THEN 'blur_rt' ELSE 'not_blur_rt' END) AS tags FROM fx_images)
    SELECT image, ordinal, step FROM t JOIN s ON apply_to = 'all' OR list_contains(tags, apply_to)"""))
def _(spark, sf):
    t = Inputs(spark, sf).images.select("image", F.split("tags", ";").alias("tags"), (F.col("image") % 90).cast("double").alias("sharpness"))
    steps = [("clahe", "blur"), ("gaussian", "not_blur_rt"), ("line_close", "all"), ("unsharp", "blur_rt")]
    return P.gate_steps(P.judged_tags(t), steps)


@query("B18_folder", r"SELECT page_id, regexp_extract(url, '([^/]+)/[^/]*$', 1) AS folder FROM pages")
def _(spark, sf):
    return Inputs(spark, sf).table("pages").select("page_id", P.folder_of("url").alias("folder"))


_NAME = "concat(source, '_', lang, '_', CAST(doc_id AS {t}), '.jpg')"


@query("B19_source_of", f"""SELECT doc_id, regexp_replace(regexp_replace({_NAME.format(t='VARCHAR')}, '\\.[^.]*$', ''), '_[0-9]+$', '') AS source,
    regexp_replace({_NAME.format(t='VARCHAR')}, '_[^_]*$', '') AS country FROM documents""")
def _(spark, sf):
    n = Inputs(spark, sf).table("documents").selectExpr("doc_id", f"{_NAME.format(t='STRING')} AS name")
    return n.select("doc_id", P.source_of("name").alias("source"), P.country_of("name").alias("country"))


SOURCES_SQL = """CASE WHEN share >= 0.7 THEN 'vegetation' WHEN y2 <= 0.25*440 THEN 'far' WHEN depth >= 1.0 THEN 'marking' WHEN chroma*30 >= 40 THEN 'shade_edge' ELSE 'on_road' END"""


def sourced(df):
    """Cue columns of the stand-in candidates under the names the attribution list expects."""
    return df.selectExpr("*", "CASE WHEN share >= 0.7 THEN 0.3D ELSE 0D END AS green", "440.0D AS frame_height", "depth / 20 AS bright", "chroma * 30 AS light_range")


@query("B20_false_alarm_source", with_views("fx_det", f", {SHAPED} SELECT image, detector, did, {SOURCES_SQL} AS source FROM shaped"))
def _(spark, sf):
    return sourced(shaped_of(Inputs(spark, sf))).select("image", "detector", "did", P.false_alarm_source().alias("source"))


@query("B20_discard_reason", with_views("fx_det", f""", {SHAPED} SELECT image, detector, did, CASE WHEN kind='crack' AND share >= 0.5 THEN 'kept' WHEN kind='crack' THEN 'off_road'
    WHEN length < 60 THEN 'short' WHEN elong < 1.2 THEN 'elongation' WHEN y1 <= 2 THEN 'border' WHEN road_color < 0.35 THEN 'one_sided' WHEN depth < 0.267 THEN 'depth' ELSE 'road_cues' END AS reason FROM shaped"""))
def _(spark, sf):
    s = shaped_of(Inputs(spark, sf)).selectExpr("*", "kind AS type", "share AS road_overlap", "y1 <= 2 AS border", "road_color AS valley")
    return s.select("image", "detector", "did", P.discard_reason(60, 1.2, 0.35, 0.267).alias("reason"))


@query("B20_crack_alarm_source", with_views("fx_det fx_truth", f""", {SHAPED}, hit AS (SELECT DISTINCT d.image, d.detector, d.did FROM fx_det d JOIN fx_truth t ON d.image=t.image
    AND d.x1 < t.x2 AND t.x1 < d.x2 AND d.y1 < t.y2 AND t.y1 < d.y2)
    SELECT s.image, s.detector, s.did, CASE WHEN h.did IS NOT NULL THEN 'touches_truth' WHEN share < 0.5 THEN 'off_road' WHEN chroma >= 1.5 THEN 'beside_paint' WHEN depth*10 >= 6 THEN 'shade_edge'
    WHEN length < 40 THEN 'on_road_short' ELSE 'on_road_long' END AS source FROM shaped s LEFT JOIN hit h USING (image, detector, did)"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    touched = M.overlap_pairs(i.det.drop("kind"), M.as_truth(i.truth.select("image", *B.DET_BOX)), ["image"]).select("image", "detector", "did").distinct()
    s = shaped_of(i).join(large(touched.withColumn("touches_truth", F.lit(True))), ["image", "detector", "did"], "left").fillna(False, ["touches_truth"])
    s = s.selectExpr("*", "share AS road", "chroma / 50 AS paint", "depth * 10 AS shade")
    return s.select("image", "detector", "did", P.crack_alarm_source().alias("source"))


@query("B21_decide_gamma", f"""WITH {QUALITY} SELECT image, CASE WHEN NOT sufficient THEN 'insufficient_analysis_pixels' WHEN gray_mean IS NULL THEN 'metric_unavailable'
    WHEN gray_mean < 80 AND dark_ratio > 0.07 THEN 'conditions_met' ELSE 'conditions_not_met' END AS gamma_reason,
    sufficient AND gray_mean IS NOT NULL AND coalesce(gray_mean < 80 AND dark_ratio > 0.07, false) AS gamma_apply FROM quality""")
def _(spark, sf):
    return P.decide_gamma(quality_of(Inputs(spark, sf)), GammaRule()).select("image", "gamma_reason", "gamma_apply")


@query("B21_decide_gaussian", f"""WITH {QUALITY} SELECT image, CASE WHEN NOT sufficient THEN 'insufficient_analysis_pixels' WHEN noise_sigma IS NULL THEN 'metric_unavailable'
    WHEN noise_sigma >= 0.6 THEN 'noise_sigma_at_or_above_threshold' ELSE 'noise_sigma_below_threshold' END AS gaussian_reason,
    sufficient AND coalesce(noise_sigma >= 0.6, false) AS gaussian_apply FROM quality""")
def _(spark, sf):
    return P.decide_gaussian(quality_of(Inputs(spark, sf)), GaussianRule(mode="conditional")).select("image", "gaussian_reason", "gaussian_apply")


PRF = """CASE WHEN tp+fp > 0 THEN tp/(tp+fp) END AS p, CASE WHEN tp+fn > 0 THEN tp/(tp+fn) END AS r"""


@query("D1_prf", with_views("fx_det fx_truth fx_images", f""", {SCORES}, a AS (SELECT image, detector, kind, criterion, {PRF} FROM scores)
    SELECT image, detector, kind, criterion, round(p, 6) AS "precision", round(r, 6) AS recall,
    round(CASE WHEN p + r > 0 THEN 2*p*r/(p+r) WHEN p IS NOT NULL AND r IS NOT NULL THEN 0 END, 6) AS f1 FROM a""", recursive=True))
def _(spark, sf):
    s = scores_of(Inputs(spark, sf)).withColumns(ratios.prf())
    return rounded(s.select(*BY, "criterion", "precision", "recall", "f1"), "precision", "recall", "f1")


@query("D2_prf_inside", with_views("fx_det fx_truth fx_images", f""", {SCORES}, a AS (SELECT image, detector, kind, CASE WHEN n_det > 0 THEN (n_det-fp)/n_det END AS p,
    CASE WHEN tp+fn > 0 THEN tp/(tp+fn) END AS r FROM scores WHERE criterion='in50')
    SELECT image, detector, kind, round(p, 6) AS "precision", round(r, 6) AS recall,
    round(CASE WHEN p + r > 0 THEN 2*p*r/(p+r) WHEN p IS NOT NULL AND r IS NOT NULL THEN 0 END, 6) AS f1 FROM a""", recursive=True))
def _(spark, sf):
    s = scores_of(Inputs(spark, sf)).filter("criterion = 'in50'").withColumns(ratios.prf_inside())
    return rounded(s.select(*BY, "precision", "recall", "f1"), "precision", "recall", "f1")


LEDGER = """sum(n_gt) AS gt, sum(tp) AS hit, sum(fp) AS fake, sum(n_det) AS cands, sum(fn) AS fn, count(DISTINCT image) AS n"""
LEDGER_OUT = """CAST(n AS BIGINT) AS n_images, CAST(gt AS BIGINT) AS gt, CAST(hit AS BIGINT) AS hit, CAST(fake AS BIGINT) AS fake, CAST(cands AS BIGINT) AS cands,
    round_even(r, 4) AS recall, round_even(p, 4) AS "precision", round_even(CASE WHEN p + r > 0 THEN 2*p*r/(p+r) WHEN p IS NOT NULL AND r IS NOT NULL THEN 0 END, 4) AS f1,
    round_even(fake/n, 2) AS fake_per_img, round_even((cands-fake)/nullif(hit,0), 2) AS frag_per_hit, round_even(hit/nullif(hit+fake,0), 4) AS precision_hit
    FROM (SELECT *, (cands-fake)/nullif(cands,0) AS p, hit/nullif(hit+fn,0) AS r FROM led)"""


@query("D3_ledger_metrics", with_views("fx_det fx_truth fx_images", f""", {SCORES}, led AS (SELECT detector, kind, {LEDGER} FROM scores WHERE criterion='in50' GROUP BY ALL)
    SELECT detector, kind, {LEDGER_OUT}""", recursive=True))
def _(spark, sf):
    return D.ledger_metrics(scores_of(Inputs(spark, sf)))


SEP_SQL = """c2 AS (SELECT c.* FROM ctl c JOIN big USING (image, kind, gid) JOIN scored USING (image))"""


@query("D4_summarize", with_views("fx_det fx_truth fx_images", f""", {SCORES}, {CONTROL}, {SEP_SQL},
tagged AS (SELECT image, unnest(list_concat(['all'], string_split(tags, ';'), ['vp_' || viewpoint])) AS tag FROM fx_images WHERE has_gt),
cl AS (SELECT image, sum(n_gt) = 0 AS clean FROM scores GROUP BY image),
h AS (SELECT image, kind, detector, count(*) AS hit FROM (SELECT DISTINCT d.image, d.kind, d.detector, t.gid FROM c2 JOIN fx_truth t USING (image, kind, gid)
    JOIN fx_det d ON d.image=t.image AND d.kind=t.kind AND {INSIDE_T}) GROUP BY ALL),
f AS (SELECT image, kind, detector, count(*) AS fhit FROM (SELECT DISTINCT d.image, d.kind, d.detector, t.gid
    FROM (SELECT image, kind, gid, cx1 AS x1, cy1 AS y1, cx2 AS x2, cy2 AS y2 FROM c2) t JOIN fx_det d ON d.image=t.image AND d.kind=t.kind AND {INSIDE_T}) GROUP BY ALL),
sn AS (SELECT image, kind, count(*) AS sn FROM c2 GROUP BY ALL),
g AS (SELECT s.detector, t.tag, s.kind, s.criterion, count(*) AS n_images, count_if(clean) AS n_images_clean, sum(n_gt) AS n_gt, sum(n_cut) AS n_cut, sum(n_det) AS n_det,
    sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(n_det) FILTER (clean) AS cd, sum(coalesce(sn,0)) AS sn, sum(coalesce(hit,0)) AS sh, sum(coalesce(fhit,0)) AS sf
    FROM scores s JOIN tagged t USING (image) JOIN cl USING (image) LEFT JOIN sn USING (image, kind) LEFT JOIN h USING (image, kind, detector) LEFT JOIN f USING (image, kind, detector) GROUP BY ALL),
p AS (SELECT *, CASE WHEN criterion='in50' THEN (n_det-fp)/nullif(n_det,0) ELSE tp/nullif(tp+fp,0) END AS pr, tp/nullif(tp+fn,0) AS r FROM g)
SELECT detector, tag, kind, criterion, n_images, CAST(n_images_clean AS BIGINT) AS n_images_clean, CAST(n_gt AS BIGINT) AS n_gt, CAST(n_cut AS BIGINT) AS n_cut, CAST(n_det AS BIGINT) AS n_det,
    CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(n_cut/nullif(n_gt,0), 6) AS cut_ratio, round(pr, 6) AS "precision", round(r, 6) AS recall,
    round(CASE WHEN pr+r > 0 THEN 2*pr*r/(pr+r) WHEN pr IS NOT NULL AND r IS NOT NULL THEN 0 END, 6) AS f1, round(fp/n_images, 6) AS fppi, round(cd/nullif(n_images_clean,0), 6) AS clean_fppi,
    round(sh/nullif(sn,0), 6) AS sep_tpr, round(sf/nullif(sn,0), 6) AS sep_fpr, round(sh/nullif(sn,0) - sf/nullif(sn,0), 6) AS separation FROM p""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    sep = S.separation(i.images, i.det, i.truth, frame_of(i), DETECTORS)
    out = D.summarize(scores_of(i), i.images, sep)
    return rounded(out, "cut_ratio", "precision", "recall", "f1", "fppi", "clean_fppi", "sep_tpr", "sep_fpr", "separation")


@query("D4_mean_columns", with_views("fx_images", f""", {QUALITY}, t AS (SELECT image, unnest(list_concat(['all'], string_split(tags, ';'), ['vp_' || viewpoint])) AS tag FROM fx_images)
    SELECT tag, count(*) AS n_images, round(avg(gray_mean), 6) AS mean_gray_mean, round(avg(laplacian_variance), 6) AS mean_laplacian_variance FROM t JOIN quality USING (image) GROUP BY tag"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    rows = P.row_tags(i.images).select("image", "tag").join(large(quality_of(i)), "image")
    out = D.mean_columns(rows, ["tag"], ["gray_mean", "laplacian_variance"])
    return rounded(out, "mean_gray_mean", "mean_laplacian_variance")


# batch rows from the event stream
RUNS = """runs AS (SELECT event_id, event_type AS dataset, CASE user_id % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'success' END AS status, value AS gray_mean,
    CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 9 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value / 2 END AS noise_sigma FROM events)"""


def runs_of(i: Inputs):
    return i.table("events").selectExpr(
        "event_id", "event_type AS dataset", "CASE user_id % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'success' END AS status", "value AS gray_mean",
        "CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 9 = 0 THEN double('NaN') ELSE value / 2 END AS noise_sigma",
    )


@query("D5_summarize_status", f"""WITH {RUNS} SELECT dataset, count(*) AS attempted_n, count(*) FILTER (status='success') AS success_n, count(*) FILTER (status='skipped') AS skipped_n,
    count(*) FILTER (status='failed') AS failed_n, count(gray_mean) FILTER (status='success') AS gray_mean_n, round(avg(gray_mean) FILTER (status='success'), 6) AS mean_gray_mean,
    count(noise_sigma) FILTER (status='success' AND NOT isnan(noise_sigma)) AS noise_sigma_n, round(avg(noise_sigma) FILTER (status='success' AND NOT isnan(noise_sigma)), 6) AS mean_noise_sigma FROM runs GROUP BY dataset""")
def _(spark, sf):
    out = D.summarize_status(runs_of(Inputs(spark, sf)), ["dataset"], ["gray_mean", "noise_sigma"])
    return rounded(out, "mean_gray_mean", "mean_noise_sigma")


BATCH = """batch AS (SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'manual_required' WHEN 1 THEN 'error' ELSE 'success' END AS status, CASE WHEN user_id % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS auto_validation,
    user_id % 9 = 0 AS manual_applied, user_id % 7 = 0 AS gamma_applied, user_id % 11 = 0 AS gaussian_applied, CASE WHEN event_id % 8 <> 0 THEN value END AS time_ms,
    CASE user_id % 4 WHEN 0 THEN 'mask_area_ratio 0.05 < 0.1;hole_ratio 0.3 > 0.15' WHEN 1 THEN 'hole_ratio 0.2 > 0.15' END AS fail_reasons FROM events)"""


def batch_of(i: Inputs):
    body = BATCH[BATCH.index("SELECT ") + 7:BATCH.rindex(" FROM events")]
    return i.table("events").select(*[F.expr(e) for e in _split_top(body)])


def _split_top(text):
    """Top-level commas of a select list."""
    out, depth, quote, last = [], 0, False, 0
    for n, ch in enumerate(text):
        if ch == "'":
            quote = not quote
        elif not quote and ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "," and not quote and depth == 0:
            out.append(text[last:n])
            last = n + 1
    return out + [text[last:]]


@query("D6_run_summary", f"""WITH {BATCH} SELECT count(*) AS n_images, count(*) FILTER (status='success') AS success, count(*) FILTER (auto_validation='PASS') AS auto_mask_pass,
    count(*) FILTER (auto_validation='FAIL') AS auto_mask_fail, count(*) FILTER (status='manual_required') AS manual_correction_required, count(*) FILTER (manual_applied) AS manual_correction_applied,
    count(*) FILTER (status='error') AS errors, count(*) FILTER (status='success' AND gamma_applied) AS gamma_applied, count(*) FILTER (status='success' AND gaussian_applied) AS gaussian_applied,
    round(avg(time_ms), 1) AS mean_ms_all, round(min(time_ms), 1) AS min_ms_all, round(max(time_ms), 1) AS max_ms_all, round(avg(time_ms) FILTER (status='success'), 1) AS mean_ms_success,
    round(min(time_ms) FILTER (status='success'), 1) AS min_ms_success, round(max(time_ms) FILTER (status='success'), 1) AS max_ms_success, round(quantile_cont(time_ms, 0.5), 1) AS median_ms_all,
    round(quantile_cont(time_ms, 0.5) FILTER (status='success'), 1) AS median_ms_success FROM batch""")
def _(spark, sf):
    return D.run_summary(batch_of(Inputs(spark, sf)))


@query("D6_fail_reasons", f"""WITH {BATCH}, r AS (SELECT unnest(string_split(fail_reasons, ';')) AS r FROM batch) SELECT split_part(r, ' ', 1) AS reason, count(*) AS n FROM r GROUP BY 1""")
def _(spark, sf):
    return D.fail_reasons(batch_of(Inputs(spark, sf)))


@query("A18_review_counts", f"WITH {BATCH} SELECT status, count(*) AS n FROM batch GROUP BY status")
def _(spark, sf):
    return D.review_counts(batch_of(Inputs(spark, sf)))


@query("D7_scoped_summary", with_views("fx_det fx_truth fx_images", f""", {SCORES},
    sc AS (SELECT image, unnest(list_concat(['all'], list_transform(string_split(tags, ';'), lambda t: 'group:' || t), ['folder:' || viewpoint])) AS scope FROM fx_images),
    led AS (SELECT scope, detector, kind, {LEDGER} FROM scores JOIN sc USING (image) WHERE criterion='in50' GROUP BY ALL) SELECT scope, detector, kind, {LEDGER_OUT}""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    return D.scoped_summary(scores_of(i), i.images.withColumn("path", F.concat_ws("/", F.lit("img"), "viewpoint", "image")))


@query("D8_subtype_recall", with_views("fx_det fx_truth", f""", hit AS (SELECT DISTINCT d.image, t.gid FROM fx_det d JOIN fx_truth t ON d.image=t.image AND d.detector='D2' AND d.kind='crack' AND {INSIDE_T}),
    c AS (SELECT image, gid, ['longitudinal crack','transverse crack','alligator crack'][1 + gid % 3] AS class_title FROM fx_truth WHERE kind='crack')
    SELECT class_title, count(*) AS n, count(h.gid) AS hit, round(count(h.gid)/count(*), 6) AS recall FROM c LEFT JOIN hit h USING (image, gid) GROUP BY class_title"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    names = F.array(*[F.lit(n) for n in ("longitudinal crack", "transverse crack", "alligator crack")])
    cracks = i.truth.filter("kind = 'crack'").withColumn("class_title", F.get(names, (F.col("gid") % 3).cast("int")))
    found = S.members(i.det.filter("detector = 'D2' AND kind = 'crack'").drop("kind"), M.as_truth(cracks.select("image", "gid", *B.DET_BOX)), ["image"])
    return rounded(D.subtype_recall(cracks, found), "recall")


@query("D9_fp_breakdown", with_views("fx_det fx_truth fx_images", f""", {SHAPED}, {BEST}, f AS (SELECT b.kind, b.detector, {SOURCES_SQL} AS source FROM best b JOIN shaped s USING (image, detector, did) WHERE gt_overlap < 0.5),
    n AS (SELECT count(*) AS n FROM fx_images), t AS (SELECT kind, count(*) FILTER (detector='D1') AS t0, count(*) FILTER (detector='D2') AS t1 FROM f GROUP BY kind),
    g AS (SELECT kind, source, count(*) FILTER (detector='D1') AS a, count(*) FILTER (detector='D2') AS b FROM f GROUP BY ALL)
    SELECT kind, source, round(a/n, 6) AS per_img_a, round(a/nullif(t0,0), 6) AS share_a, round(b/n, 6) AS per_img_b, round(b/nullif(t1,0), 6) AS share_b, round((b-a)/n, 6) AS delta FROM g JOIN t USING (kind), n"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    f = S.best_inside(i.det, i.truth, BY, TRUTH_BY).filter("gt_overlap < 0.5").select("image", "detector", "did")
    rows = sourced(shaped_of(i).join(large(f), ["image", "detector", "did"])).select("kind", F.col("detector").alias("condition"), P.false_alarm_source().alias("source"))
    out = D.fp_breakdown(rows, ("D1", "D2"), i.images.count())
    return rounded(out, "per_img_a", "share_a", "per_img_b", "share_b", "delta")


@query("D10_loss_table", with_views("fx_det fx_truth", f""", st AS (SELECT t.image, t.kind, t.gid, ['none','found_small','found_short','found_border','found'][coalesce(max(1 + d.did % 4), 0) + 1] AS stage
    FROM fx_truth t LEFT JOIN fx_det d ON d.image=t.image AND d.detector='D1' AND {INSIDE_T} GROUP BY ALL),
    c AS (SELECT kind, stage, count(*) AS n FROM st GROUP BY ALL UNION ALL SELECT NULL, stage, count(*) FROM st GROUP BY ALL)
    SELECT kind, stage, n, round(n / sum(n) OVER (PARTITION BY kind), 6) AS share FROM c"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    cands = i.det.filter("detector = 'D1'").withColumn("stage_ord", (1 + F.col("did") % 4).cast("int"))
    return rounded(D.loss_table(S.stage_of_truth(cands, i.truth, STAGES)), "share")


def sized_images(i: Inputs):
    return i.images.selectExpr("image", "viewpoint AS country", "double(600 + image % 3 * 200) AS width", "double(400 + image % 2 * 100) AS height")


SIZED = "sized AS (SELECT image, viewpoint AS country, 600 + image % 3 * 200 AS width, 400 + image % 2 * 100 AS height FROM fx_images)"


@query("D11_annotation_totals", with_views("fx_truth fx_images", """, p AS (SELECT i.image, count(t.gid) AS n FROM fx_images i LEFT JOIN fx_truth t USING (image) GROUP BY i.image)
    SELECT count(*) AS images, CAST(sum(n) AS BIGINT) AS boxes, count(*) FILTER (n=0) AS empty_images, round(avg(n), 6) AS mean_boxes, max(n) AS max_boxes FROM p"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    return rounded(D.annotation_totals(i.images, i.truth), "mean_boxes")


@query("D11_annotation_countries", with_views("fx_truth fx_images", f""", {SIZED}, r AS (SELECT country, string_agg(s, ', ' ORDER BY s) AS resolutions FROM (SELECT DISTINCT country, width || 'x' || height AS s FROM sized) GROUP BY country)
    SELECT country, count(DISTINCT s.image) AS images, count(t.gid) AS boxes, any_value(resolutions) AS resolutions FROM sized s LEFT JOIN fx_truth t USING (image) JOIN r USING (country) GROUP BY country"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    return D.annotation_countries(sized_images(i), i.truth)


@query("D11_annotation_classes", with_views("fx_truth fx_images", """SELECT kind, count(*) AS total, count(*) FILTER (viewpoint='far') AS n_far, count(*) FILTER (viewpoint='road_full') AS n_road_full,
    count(*) FILTER (viewpoint='ambiguous') AS n_ambiguous FROM fx_truth JOIN fx_images USING (image) GROUP BY kind"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    return D.annotation_classes(i.truth, sized_images(i), ["far", "road_full", "ambiguous"])


SHAPES = f"""{SIZED}, sh AS (SELECT kind, x2-x1 AS w, y2-y1 AS h, least(x2-x1, y2-y1) AS short, greatest(x2-x1, y2-y1)/greatest(1, least(x2-x1, y2-y1)) AS aspect,
    (x2-x1)*(y2-y1)/(width*height) AS area_share, (y1+y2)/2/height AS y_rel FROM fx_truth JOIN sized USING (image)),
    lng AS (UNPIVOT sh ON w, h, short, aspect, area_share, y_rel INTO NAME measure VALUE value)"""


@query("D11_shape_medians", with_views("fx_truth fx_images", f", {SHAPES} SELECT kind, measure, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50 FROM lng GROUP BY ALL"))
def _(spark, sf):
    i = Inputs(spark, sf)
    return rounded(D.shape_percentiles(i.truth.join(large(sized_images(i)), "image"), [0.5]), "p50")


@query("D13_shape_percentiles", with_views("fx_truth fx_images", f""", {SHAPES} SELECT kind, measure, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.9), 6) AS p90 FROM lng GROUP BY ALL"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    return rounded(D.shape_percentiles(i.truth.join(large(sized_images(i)), "image"), [0.1, 0.5, 0.9]), "p10", "p50", "p90")


@query("D13_profile_boxes", with_views("fx_truth", """, c AS (SELECT image, kind, count(*) AS c FROM fx_truth GROUP BY ALL),
    t AS (SELECT kind, count(*) AS t FROM (SELECT DISTINCT a.image, a.kind, a.gid FROM fx_truth a JOIN fx_truth b ON a.image=b.image AND a.kind=b.kind AND a.gid <> b.gid
    AND greatest(a.x1,b.x1) - least(a.x2,b.x2) <= 10 AND greatest(a.y1,b.y1) - least(a.y2,b.y2) <= 10) GROUP BY kind)
    SELECT kind, CAST(sum(c) AS BIGINT) AS n, quantile_cont(c, 0.5) AS median_per_image, max(c) AS max_per_image, round(any_value(t)/sum(c), 6) AS touching_share FROM c JOIN t USING (kind) GROUP BY kind"""))
def _(spark, sf):
    return rounded(D.profile_boxes(Inputs(spark, sf).truth), "touching_share")


@query("D13_tag_values", with_views("fx_truth", "SELECT kind, 'd' || CAST(gid % 5 AS VARCHAR) AS detail, count(*) AS n FROM fx_truth GROUP BY ALL"))
def _(spark, sf):
    return D.tag_values(Inputs(spark, sf).truth.withColumn("detail", F.concat(F.lit("d"), (F.col("gid") % 5).cast("string"))))


@query("D12_profile_quality", with_views("fx_cells", """, l AS (SELECT 'mean_v' AS metric, mean_v AS value FROM fx_cells UNION ALL SELECT 'std_v', std_v FROM fx_cells)
    SELECT metric, count(*) AS n, round(min(value), 6) AS p0, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS p100 FROM l GROUP BY metric"""))
def _(spark, sf):
    table = D.profile_quality(Inputs(spark, sf).cells, ["mean_v", "std_v"])
    return rounded(table, "p0", "p10", "p50", "p90", "p100")


@query("D12_quality_limits", with_views("fx_cells", "SELECT count(*) FILTER (mean_v < 10) AS dim, count(*) FILTER (std_v > 20) AS uneven FROM fx_cells"))
def _(spark, sf):
    return D.limit_counts(Inputs(spark, sf).cells, {"dim": F.col("mean_v") < 10, "uneven": F.col("std_v") > 20})


@query("D15_binned_mean", with_views("fx_det", """, r AS (SELECT did % 1000 / 400.0e0 AS x, (x2-x1) AS y FROM fx_det), e AS (SELECT * FROM (VALUES (0, 0.0e0, 0.5e0), (1, 0.5e0, 1.0e0), (2, 1.0e0, 1.5e0), (3, 1.5e0, 2.0e0), (4, 2.0e0, 99.0e0)) v(bin, lo, hi))
    SELECT bin, count(*) AS n, round(avg(y), 6) AS mean, round(quantile_cont(y, 0.5), 6) AS median FROM r JOIN e ON x >= lo AND x < hi GROUP BY bin"""))
def _(spark, sf):
    rows = Inputs(spark, sf).det.selectExpr("did % 1000 / 400.0D AS x", "x2-x1 AS y")
    return rounded(D.binned_mean(rows, "x", "y", [0.0, 0.5, 1.0, 1.5, 2.0, 99.0]), "mean", "median")


@query("D16_before_after", with_views("fx_lines", """SELECT round(avg(pk), 6) AS mean_pk, round(avg(sk), 6) AS mean_sk, round(1000.0e0*sum(q)/sum(pk), 6) AS q_per_1000, round(sum(sk)*1.0e0/sum(q), 6) AS sk_per_q FROM fx_lines"""))
def _(spark, sf):
    out = D.before_after(Inputs(spark, sf).lines, ["pk", "sk"], {"q_per_1000": ("q", "pk", 1000.0), "sk_per_q": ("sk", "q", 1.0)})
    return rounded(out, *out.columns)


@query("D20_gap_profile", with_views("fx_points", """, d AS (SELECT a.image, a.label, b.label AS other, sqrt(CAST((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS DOUBLE)) AS gap FROM fx_points a JOIN fx_points b ON a.image=b.image AND a.label <> b.label),
    g AS (SELECT image, label, other, min(gap) AS gap FROM d GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY gap, other) AS z FROM g),
    t AS (SELECT CASE WHEN image % 2 = 0 THEN 'truth' ELSE 'control' END AS place, gap, CAST(least(abs(label*13%180 - other*13%180), 180 - abs(label*13%180 - other*13%180)) AS DOUBLE) AS turn FROM m WHERE z = 1)
    SELECT place, count(*) AS n, round(quantile_cont(gap, 0.1), 6) AS gap_p10, round(quantile_cont(gap, 0.5), 6) AS gap_p50, round(quantile_cont(gap, 0.9), 6) AS gap_p90, round(quantile_cont(turn, 0.1), 6) AS turn_p10,
    round(quantile_cont(turn, 0.5), 6) AS turn_p50, round(quantile_cont(turn, 0.9), 6) AS turn_p90, round(avg((gap <= 10)::INT), 6) AS gap_le_10, round(avg((gap <= 20)::INT), 6) AS gap_le_20, round(avg((gap <= 30)::INT), 6) AS gap_le_30,
    round(avg((gap <= 45)::INT), 6) AS gap_le_45, round(avg((turn <= 30)::INT), 6) AS turn_le_30 FROM t GROUP BY place"""))
def _(spark, sf):
    from ..operators.points import nearest_piece

    pts = Inputs(spark, sf).points.selectExpr("*", "double(label*13%180) AS angle")
    near = nearest_piece(pts).withColumn("place", F.when(F.col("image") % 2 == 0, "truth").otherwise("control"))
    out = D.gap_profile(near, ["place"])
    return rounded(out, *[c for c in out.columns if c not in ("place", "n")])


@query("D22_quality_change", f"""WITH {QUALITY} SELECT image, gray_mean * 1.2e0 + 3 - gray_mean AS gray_mean, CASE WHEN image % 5 <> 0 THEN noise_sigma / 2 - noise_sigma END AS noise_sigma FROM quality""")
def _(spark, sf):
    a = quality_of(Inputs(spark, sf))
    b = a.selectExpr("image", "gray_mean * 1.2D + 3 AS gray_mean", "CASE WHEN image % 5 <> 0 THEN noise_sigma / 2 END AS noise_sigma")
    return D.quality_change(a, b, ["gray_mean", "noise_sigma"])


@query("D24_region_max", with_views("fx_det fx_truth fx_images", f""", {SHAPED}, {CONTROL}, reg AS (SELECT t.image, t.kind, t.gid, true AS is_truth, t.x1, t.y1, t.x2, t.y2 FROM big t JOIN ctl USING (image, kind, gid)
    UNION ALL SELECT image, kind, c.gid, false, cx1, cy1, cx2, cy2 FROM ctl c JOIN big USING (image, kind, gid)),
    d AS (SELECT * FROM shaped WHERE detector='D1')
    SELECT t.image, t.kind, t.gid, t.is_truth, coalesce(bool_or(d.kind = t.kind), false) AS hit, round(coalesce(max(elong), 0), 6) AS best FROM reg t LEFT JOIN d ON d.image=t.image AND {INSIDE_T} GROUP BY ALL"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    return rounded(S.region_max(shaped_of(i).filter("detector = 'D1'"), i.truth, frame_of(i)), "best")
