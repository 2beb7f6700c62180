"""Queries over ranks, resampling, splits, filters and curves."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators import features as X
from ..operators import geometry as G
from ..operators import matching as M
from ..operators import membership as S
from ..operators import ranks as R
from ..operators import resample as E
from ..operators import splits as P
from ..operators.predicates import row_tags
from ..session import large
from .boxes_queries import AREA_D, CONTROL, INSIDE_T, INTER, SCORES, frame_of, scores_of
from .registry import query
from .stand_ins import DETECTORS, Inputs, with_views

N_BOOT = 1000
CONFIGS = [(d, k, c) for d in DETECTORS for k in ("crack", "pothole") for c in ("iou50", "iou30", "in50")]
INSIDE_CONFIGS = [c for c in CONFIGS if c[2] == "in50"]


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def groups_of(i: Inputs):
    return row_tags(i.images.filter("has_gt")).select("tag", "image")


TAGS = """tagged AS (SELECT image, unnest(list_concat(['all'], string_split(tags, ';'), ['vp_' || viewpoint])) AS tag FROM fx_images WHERE has_gt)"""

BOOT = f"""{TAGS},
placed AS (SELECT tag, image, row_number() OVER (PARTITION BY tag ORDER BY md5('20261006|' || image), image) - 1 AS ordinal,
    count(*) OVER (PARTITION BY tag) AS n FROM tagged),
drawn AS (SELECT p.tag, b, CAST(floor((('0x' || substr(md5('20261006|' || p.tag || '|' || b || '|' || k), 1, 13))::UBIGINT / 4503599627370496.0e0) * n) AS BIGINT) AS ordinal
    FROM (SELECT tag, max(n) AS n FROM placed GROUP BY tag) p, range(1, {N_BOOT + 1}) t(b), range(0, n) u(k)),
times AS (SELECT tag, b, ordinal, count(*) AS times FROM drawn GROUP BY ALL
    UNION ALL SELECT tag, 0, ordinal, 1 FROM placed),
reps AS (SELECT t.tag, t.b, s.detector, s.kind, s.criterion, CAST(sum(s.tp*times) AS BIGINT) AS tp, CAST(sum(s.fp*times) AS BIGINT) AS fp,
    CAST(sum(s.fn*times) AS BIGINT) AS fn, CAST(sum(s.n_det*times) AS BIGINT) AS n_det
    FROM times t JOIN placed p ON t.tag=p.tag AND t.ordinal=p.ordinal JOIN scores s ON s.image=p.image GROUP BY ALL)"""

PR = "(n_det-fp)/nullif(n_det,0)"
RC = "tp/nullif(tp+fn,0)"
F1S = f"""f1s AS (SELECT *, CASE WHEN criterion='in50' THEN CASE WHEN {PR}+{RC} > 0 THEN 2*({PR})*({RC})/({PR}+{RC})
    WHEN {PR} IS NOT NULL AND {RC} IS NOT NULL THEN 0 END ELSE 2*tp/nullif(2*tp+fp+fn,0) END AS f1, {PR} AS p, {RC} AS r FROM reps)"""


@query("E1_bootstrap_ci", with_views("fx_det fx_truth fx_images", f""", {SCORES}, {BOOT}, {F1S}
    SELECT tag, detector, kind, criterion, round(max(f1) FILTER (b=0), 6) AS f1, round(quantile_cont(f1, 0.025) FILTER (b>0), 6) AS lo,
    round(quantile_cont(f1, 0.975) FILTER (b>0), 6) AS hi FROM f1s GROUP BY ALL""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    return rounded(E.bootstrap_ci(E.replicates(scores_of(i), groups_of(i), CONFIGS, N_BOOT)), "f1", "lo", "hi")


@query("E1_replicate_sums", with_views("fx_det fx_truth fx_images", f", {SCORES}, {BOOT} SELECT * FROM reps WHERE criterion='in50'", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    return E.replicates(scores_of(i), groups_of(i), INSIDE_CONFIGS, N_BOOT).withColumn("b", F.col("b").cast("bigint"))


_STEPS = enumerate(accumulate(exp(-1) / factorial(k) for k in range(20)))
_POISSON = "CASE " + " ".join(f"WHEN u < {t!r} THEN {k}" for k, t in _STEPS) + " ELSE 20 END"


@query("E1_bootstrap_poisson", with_views("fx_det fx_truth fx_images", f""", {SCORES}, {TAGS},
times AS (SELECT image, b, {_POISSON} AS times FROM (SELECT image, b, ('0x' || substr(md5('20261006|' || image || '|' || b), 1, 13))::UBIGINT / 4503599627370496.0e0 AS u
    FROM fx_images, range(1, {N_BOOT + 1}) t(b) WHERE has_gt) UNION ALL SELECT image, 0, 1 FROM fx_images WHERE has_gt)
SELECT g.tag, t.b, s.detector, s.kind, s.criterion, CAST(sum(s.tp*times) AS BIGINT) AS tp, CAST(sum(s.fp*times) AS BIGINT) AS fp,
    CAST(sum(s.fn*times) AS BIGINT) AS fn, CAST(sum(s.n_det*times) AS BIGINT) AS n_det
FROM tagged g JOIN times t USING (image) JOIN scores s USING (image) WHERE criterion='in50' GROUP BY ALL""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    return E.replicates(scores_of(i), groups_of(i), INSIDE_CONFIGS, N_BOOT, method="poisson").withColumn("b", F.col("b").cast("bigint"))


@query("E2_bootstrap_compare", with_views("fx_det fx_truth fx_images", f""", {SCORES}, {BOOT}, {F1S},
d AS (SELECT a.tag, a.detector, a.kind, a.criterion, a.b, a.f1, r.f1 AS rf, a.f1 - r.f1 AS d FROM f1s a JOIN f1s r USING (tag, kind, criterion, b)
    WHERE a.detector='D2' AND r.detector='D1')
SELECT *, delta_lo > 0 OR delta_hi < 0 AS significant FROM (SELECT tag, detector, kind, criterion, round(max(f1) FILTER (b=0), 6) AS f1,
    round(max(rf) FILTER (b=0), 6) AS f1_reference, round(max(d) FILTER (b=0), 6) AS delta, round(quantile_cont(d, 0.025) FILTER (b>0), 6) AS delta_lo,
    round(quantile_cont(d, 0.975) FILTER (b>0), 6) AS delta_hi FROM d GROUP BY ALL)""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    out = E.bootstrap_compare(E.replicates(scores_of(i), groups_of(i), CONFIGS, N_BOOT), "D1")
    return rounded(out, "f1", "f1_reference", "delta", "delta_lo", "delta_hi")


# tune / val parts, quality tags inside them, and a listed subset, as one set of overlapping groups
PARTS = f"""tagged AS (SELECT image, unnest([part, part || ':' || CASE WHEN tags LIKE '%blur%' THEN 'blur' ELSE 'rest' END, CASE WHEN listed THEN 'in_list' ELSE 'not_in_list' END]) AS tag
    FROM (SELECT image, tags, CASE WHEN image % 10 < 7 THEN 'tune' ELSE 'val' END AS part, image % 4 = 0 AS listed FROM fx_images WHERE has_gt))"""

COMPARED = f"""{SCORES}, {BOOT.replace(TAGS, PARTS)}, {F1S},
j AS (SELECT a.*, a.r - q.r AS dr, a.p - q.p AS dp, a.fp - q.fp AS df FROM f1s a JOIN f1s q USING (tag, kind, criterion, b) WHERE a.criterion='in50' AND q.detector='D1'),
compared AS (SELECT tag, detector, kind, max(r) FILTER (b=0) AS recall, max(p) FILTER (b=0) AS "precision", max(f1) FILTER (b=0) AS f1,
    max(tp) FILTER (b=0) AS hits, max(dr) FILTER (b=0) AS delta_recall, quantile_cont(dr, 0.025) FILTER (b>0) AS delta_recall_lo,
    quantile_cont(dr, 0.975) FILTER (b>0) AS delta_recall_hi, max(dp) FILTER (b=0) AS delta_precision,
    quantile_cont(dp, 0.025) FILTER (b>0) AS delta_precision_lo, quantile_cont(dp, 0.975) FILTER (b>0) AS delta_precision_hi,
    max(n_det) FILTER (b=0) AS nd, max(fp) FILTER (b=0) AS nf, max(df) FILTER (b=0) AS ndf FROM j GROUP BY ALL),
sizes AS (SELECT tag, count(*) AS n_images FROM tagged GROUP BY ALL),
compare AS (SELECT tag, detector, kind, round(recall, 6) AS recall, round("precision", 6) AS "precision", round(f1, 6) AS f1, hits, round(delta_recall, 6) AS delta_recall,
    round(delta_recall_lo, 6) AS delta_recall_lo, round(delta_recall_hi, 6) AS delta_recall_hi, round(delta_precision, 6) AS delta_precision,
    round(delta_precision_lo, 6) AS delta_precision_lo, round(delta_precision_hi, 6) AS delta_precision_hi, n_images,
    round(nd / n_images, 6) AS cands_per_img, round(nf / n_images, 6) AS fake_per_img, round(ndf / n_images, 6) AS delta_fake_per_img, round((nd - nf) / nullif(hits, 0), 6) AS frag_per_hit,
    delta_recall_lo > 0 OR delta_recall_hi < 0 AS recall_significant, delta_precision_lo > 0 OR delta_precision_hi < 0 AS precision_significant
    FROM compared JOIN sizes USING (tag))"""


def parts_of(i: Inputs):
    return i.images.filter("has_gt").selectExpr(
        "image", "CASE WHEN image % 10 < 7 THEN 'tune' ELSE 'val' END AS part", "CASE WHEN tags LIKE '%blur%' THEN 'blur' ELSE 'rest' END AS q",
        "CASE WHEN image % 4 = 0 THEN 'in_list' ELSE 'not_in_list' END AS listed",
    ).select("image", F.explode(F.array("part", F.concat_ws(":", "part", "q"), "listed")).alias("tag"))


def compared_of(i: Inputs):
    groups = parts_of(i)
    reps = E.replicates(scores_of(i), groups, INSIDE_CONFIGS, N_BOOT)
    return E.compare_runs(reps, groups.groupBy("tag").agg(F.count("*").alias("n_images")), "D1")


FLOATS = ["recall", "precision", "f1", "delta_recall", "delta_recall_lo", "delta_recall_hi", "delta_precision", "delta_precision_lo",
          "delta_precision_hi", "cands_per_img", "fake_per_img", "delta_fake_per_img", "frag_per_hit"]


@query("E3_compare_runs", with_views("fx_det fx_truth fx_images", f", {COMPARED} SELECT * FROM compare WHERE detector <> 'D1'", recursive=True))
def _(spark, sf):
    return rounded(compared_of(Inputs(spark, sf)).filter("detector <> 'D1'"), *FLOATS)


@query("E4_paired_recall_delta", with_views("fx_det fx_truth fx_images", f""", {SCORES}, {BOOT}, {F1S},
j AS (SELECT a.tag, a.detector, a.kind, a.criterion, a.b, a.r - q.r AS d FROM f1s a JOIN f1s q USING (tag, kind, criterion, b)
    WHERE a.criterion='in50' AND a.detector='D2' AND q.detector='D1')
SELECT tag, detector, kind, criterion, round(max(d) FILTER (b=0), 6) AS delta, round(quantile_cont(d, 0.025) FILTER (b>0), 6) AS lo,
    round(quantile_cont(d, 0.975) FILTER (b>0), 6) AS hi FROM j GROUP BY ALL""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    return rounded(E.paired_recall_delta(E.replicates(scores_of(i), groups_of(i), INSIDE_CONFIGS, N_BOOT), "D1"), "delta", "lo", "hi")


_SAMPLES = "samples AS (SELECT doc_id AS key, real = 1 AS side, f_len AS a, f_words * 7 AS c FROM fx_features)"


@query("E5_bootstrap_two_sample", with_views("fx_features", f""", {_SAMPLES},
placed AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY md5('20261006|' || key), key) - 1 AS ordinal FROM samples),
n AS (SELECT side, count(*) AS n FROM samples GROUP BY ALL),
drawn AS (SELECT side, b, CAST(floor((('0x' || substr(md5('20261006|' || side || '|' || b || '|' || k), 1, 13))::UBIGINT / 4503599627370496.0e0) * n) AS BIGINT) AS ordinal
    FROM n, range(1, {N_BOOT + 1}) t(b), range(0, n) u(k)),
rows_ AS (SELECT d.b, p.side, p.a, p.c FROM drawn d JOIN placed p USING (side, ordinal) UNION ALL SELECT 0, side, a, c FROM samples),
long AS (SELECT b, side, 'a' AS m, a AS v FROM rows_ UNION ALL SELECT b, side, 'c', c FROM rows_),
ranked AS (SELECT *, rank() OVER (PARTITION BY b, m ORDER BY v) + (count(*) OVER (PARTITION BY b, m, v) - 1) / 2.0e0 AS rk FROM long),
st AS (SELECT b, m, avg(CASE WHEN v >= 800 THEN 1.0e0 ELSE 0 END) FILTER (side) - avg(CASE WHEN v >= 800 THEN 1.0e0 ELSE 0 END) FILTER (NOT side) AS share,
    (sum(rk) FILTER (side) - count(*) FILTER (side) * (count(*) FILTER (side) + 1) / 2.0e0) / (count(*) FILTER (side) * count(*) FILTER (NOT side)) AS auc FROM ranked GROUP BY ALL),
d AS (SELECT y.b, y.share - x.share AS ds, y.auc - x.auc AS da FROM st x JOIN st y USING (b) WHERE x.m='a' AND y.m='c'),
l AS (SELECT b, 'share' AS statistic, ds AS d FROM d UNION ALL SELECT b, 'auc', da FROM d)
SELECT statistic, round(max(d) FILTER (b=0), 6) AS delta, round(quantile_cont(d, 0.025) FILTER (b>0), 6) AS lo, round(quantile_cont(d, 0.975) FILTER (b>0), 6) AS hi FROM l GROUP BY ALL"""))
def _(spark, sf):
    s = Inputs(spark, sf).features.selectExpr("doc_id AS key", "real = 1 AS side", "f_len AS a", "f_words * 7 AS c")
    return rounded(E.bootstrap_two_sample(s, "key", "side", {"first": "a", "second": "c"}, N_BOOT, 800.0), "delta", "lo", "hi")


AUC_SQL = """r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0e0 AS rk FROM fx_long),
aucs AS (SELECT feature, CAST(sum(real) AS BIGINT) AS n_pos, CAST(count(*) - sum(real) AS BIGINT) AS n_neg,
    (sum(CASE WHEN real = 1 THEN rk END) - sum(real) * (sum(real) + 1) / 2.0e0) / (sum(real) * (count(*) - sum(real))) AS auc FROM r GROUP BY feature)"""


@query("E6_auc", with_views("fx_long", f", {AUC_SQL} SELECT feature, n_pos, n_neg, round(auc, 6) AS auc FROM aucs"))
def _(spark, sf):
    return rounded(R.auc(Inputs(spark, sf).long_features, ["feature"], "value", F.col("real") == 1), "auc")


@query("E7_auc_of_max", with_views("fx_features", """, m AS (SELECT real, greatest(f_len, f_tie * 20, f_words * 6) AS v FROM fx_features),
r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0e0 AS rk FROM m)
SELECT CAST(sum(real) AS BIGINT) AS n_pos, CAST(count(*) - sum(real) AS BIGINT) AS n_neg,
    round((sum(CASE WHEN real = 1 THEN rk END) - sum(real) * (sum(real) + 1) / 2.0e0) / (sum(real) * (count(*) - sum(real))), 6) AS auc FROM r"""))
def _(spark, sf):
    f = Inputs(spark, sf).features.selectExpr("real", "f_len AS a", "f_tie * 20 AS b", "f_words * 6 AS c")
    return rounded(R.auc_of_max(f, [], ["a", "b", "c"], F.col("real") == 1), "auc")


@query("E8_cut_table", with_views("fx_long", f""", {AUC_SQL},
q AS (SELECT feature, quantile_cont(value, 0.05) AS l5, quantile_cont(value, 0.95) AS h5, quantile_cont(value, 0.10) AS l10, quantile_cont(value, 0.90) AS h10
    FROM fx_long WHERE real = 1 GROUP BY feature),
t AS (SELECT feature, auc, auc >= 0.5 AS drop_low, CASE WHEN auc >= 0.5 THEN l5 ELSE h5 END AS t5, CASE WHEN auc >= 0.5 THEN l10 ELSE h10 END AS t10 FROM aucs JOIN q USING (feature))
SELECT t.feature, round(any_value(auc), 6) AS auc, any_value(drop_low) AS drop_low, round(any_value(t5), 6) AS threshold_5, round(any_value(t10), 6) AS threshold_10,
    round(avg(CASE WHEN drop_low THEN (value < t5)::INT ELSE (value > t5)::INT END), 6) AS cut_5,
    round(avg(CASE WHEN drop_low THEN (value < t10)::INT ELSE (value > t10)::INT END), 6) AS cut_10
FROM t JOIN fx_long f ON f.feature = t.feature AND f.real = 0 GROUP BY t.feature"""))
def _(spark, sf):
    return rounded(X.cut_table(Inputs(spark, sf).long_features), "auc", "threshold_5", "threshold_10", "cut_5", "cut_10")


FILTERS = ["f_len", "f_tie", "f_words"]


def greedy_sql(cap: float, min_gain: float, loss: float = 0.05) -> str:
    """The rounds of the greedy filter written out, one for each feature: each holds the documents left by the one before."""
    parts, order = ["d0 AS (SELECT doc_id, real FROM fx_features)", "total AS (SELECT sum(real) AS n FROM d0)"], " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FILTERS))
    for r in range(1, len(FILTERS) + 1):
        used = " ".join(f"AND feature NOT IN (SELECT feature FROM s{k})" for k in range(1, r))
        before = f"AND EXISTS (SELECT 1 FROM s{r - 1})" if r > 1 else ""
        parts.append(f"""l{r} AS (SELECT f.doc_id, f.real, feature, value FROM fx_long f JOIN d{r - 1} USING (doc_id) WHERE true {used}),
a{r} AS (SELECT feature, (sum(rk) FILTER (real = 1) - sum(real)*(sum(real)+1)/2.0e0) / (sum(real)*(count(*)-sum(real))) AS auc FROM
    (SELECT feature, real, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1)/2.0e0 AS rk FROM l{r}) GROUP BY feature),
t{r} AS (SELECT feature, auc >= 0.5 AS drop_low, CASE WHEN auc >= 0.5 THEN quantile_cont(value, {loss}) ELSE quantile_cont(value, {1 - loss}) END AS t FROM l{r} JOIN a{r} USING (feature) WHERE real = 1 GROUP BY feature, auc),
b{r} AS (SELECT feature, drop_low, t, avg(CASE WHEN drop_low THEN (value < t)::INT ELSE (value > t)::INT END) AS gain FROM l{r} JOIN t{r} USING (feature) WHERE real = 0 {before}
    GROUP BY feature, drop_low, t HAVING gain >= {min_gain} ORDER BY gain DESC, CASE feature {order} END LIMIT 1),
d{r} AS (SELECT l.doc_id, l.real FROM l{r} l JOIN b{r} b ON l.feature = b.feature WHERE CASE WHEN drop_low THEN value >= t ELSE value <= t END),
s{r} AS (SELECT {r} AS step, feature, drop_low, t AS threshold, gain, n_real, n_fake FROM b{r}, total,
    (SELECT CAST(count(*) FILTER (real = 1) AS BIGINT) AS n_real, CAST(count(*) FILTER (real = 0) AS BIGINT) AS n_fake FROM d{r}) WHERE 1 - n_real / n <= {cap})""")
    return ", " + ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM s{r}" for r in range(1, len(FILTERS) + 1))


@query("E9_greedy_filters", with_views("fx_features fx_long", greedy_sql(0.15, 0.02)))
def _(spark, sf):
    rows = Inputs(spark, sf).features
    steps = X.greedy_filters(rows, FILTERS, cap=0.15, min_gain=0.02)
    return spark.createDataFrame(steps, "step int, feature string, drop_low boolean, threshold double, gain double, n_real long, n_fake long")


# an operating curve: the ledger of each detector over detection-id cut-offs
CURVE_SQL = """led AS (SELECT detector AS family, cut.k AS config, sum(d.n) / 1000.0e0 AS fake_per_img, sum(d.good) / 1000.0e0 AS recall FROM
    (SELECT detector, uid_band, count(*) AS n, sum(CASE WHEN kind = 'crack' THEN 1 ELSE 0 END) AS good FROM (SELECT detector, kind, did % 97 AS uid_band FROM fx_det) GROUP BY ALL) d
    JOIN (SELECT unnest([10, 25, 40, 60, 80, 96]) AS k) cut ON d.uid_band <= cut.k GROUP BY ALL)"""


def curve_of(i: Inputs):
    bands = i.det.selectExpr("detector", "kind", "did % 97 AS band", "explode(array(10, 25, 40, 60, 80, 96)) AS config").filter("band <= config")
    return bands.groupBy(F.col("detector").alias("family"), "config").agg(
        (F.count("*") / 1000.0).alias("fake_per_img"), (F.count_if(F.col("kind") == "crack") / 1000.0).alias("recall")
    )


LEVELS = [20.0, 40.0, 55.0, 500.0]


@query("E10_interp_at", with_views("fx_det", f""", {CURVE_SQL},
seg AS (SELECT family, fake_per_img AS x0, recall AS y0, lead(fake_per_img) OVER w AS x1, lead(recall) OVER w AS y1, row_number() OVER w AS i FROM led WINDOW w AS (PARTITION BY family ORDER BY fake_per_img)),
lv AS (SELECT unnest([20.0e0, 40.0e0, 55.0e0, 500.0e0]) AS level),
hit AS (SELECT family, level, CASE WHEN coalesce(x1, x0) = x0 THEN y0 ELSE y0 + (level - x0) / (x1 - x0) * (y1 - y0) END AS y, i FROM seg JOIN lv ON level >= x0 AND level <= coalesce(x1, x0))
SELECT f.family, lv.level, round(h.y, 6) AS recall FROM (SELECT DISTINCT family FROM led) f CROSS JOIN lv LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY family, level ORDER BY i) AS z FROM hit) h
    ON h.family = f.family AND h.level = lv.level AND h.z = 1"""))
def _(spark, sf):
    return rounded(C.interp_at(curve_of(Inputs(spark, sf)), LEVELS), "recall")


@query("E11_nearest_operating_points", with_views("fx_det", f""", {CURVE_SQL},
lv AS (SELECT unnest([20.0e0, 40.0e0, 55.0e0, 500.0e0]) AS level),
near AS (SELECT * FROM (SELECT family, config, fake_per_img, level, row_number() OVER (PARTITION BY family, level ORDER BY abs(fake_per_img - level), config) AS z FROM led CROSS JOIN lv) WHERE z = 1)
SELECT family, level, config, round(fake_per_img, 6) AS fake_per_img FROM near WHERE level IN (SELECT level FROM near GROUP BY level HAVING max(fake_per_img) - min(fake_per_img) <= 10)"""))
def _(spark, sf):
    return rounded(C.nearest_operating_points(curve_of(Inputs(spark, sf)), LEVELS, tolerance=10.0), "fake_per_img")


@query("E12_best_threshold", with_views("fx_features", """, t AS (SELECT DISTINCT round_even(f_words / 7, 1) AS t FROM fx_features),
s AS (SELECT t, avg((((f_words / 7) < t) = (real = 1))::INT) AS agreement,
    avg(((f_words / 7) < t)::INT) FILTER (real = 1) - avg(((f_words / 7) < t)::INT) FILTER (real <> 1) AS gain FROM t CROSS JOIN fx_features GROUP BY t)
SELECT (SELECT t FROM s ORDER BY round(agreement, 12) DESC, t LIMIT 1) AS agree_threshold, round(max(agreement), 6) AS agreement,
    (SELECT t FROM s ORDER BY round(gain, 12) DESC, t LIMIT 1) AS gain_threshold, round(max(gain), 6) AS gain FROM s"""))
def _(spark, sf):
    f = Inputs(spark, sf).features.selectExpr("f_words / 7 AS score", "real = 1 AS label")
    return rounded(R.best_threshold(f, "score", "label"), "agreement", "gain")


@query("E12_threshold_table", with_views("fx_features", """SELECT t.threshold, count(*) FILTER (f_words < threshold) AS flagged, round(avg(((f_words < threshold) = (real = 1))::INT), 6) AS agreement,
    round(avg((f_words < threshold)::INT) FILTER (real = 1), 6) AS caught, round(avg((f_words < threshold)::INT) FILTER (real <> 1), 6) AS false_flagged
    FROM fx_features CROSS JOIN (SELECT unnest([20.0e0, 50.0e0, 100.0e0]) AS threshold) t GROUP BY ALL"""))
def _(spark, sf):
    f = Inputs(spark, sf).features.selectExpr("f_words AS score", "real = 1 AS label")
    return rounded(R.threshold_table(f, "score", "label", [20.0, 50.0, 100.0]), "agreement", "caught", "false_flagged")


@query("E13_calibrate_threshold", with_views("fx_pixels", """, n AS (SELECT count(*) AS n FROM fx_pixels WHERE v >= 140),
    c AS (SELECT v * 1.5e0 + (image * 8 + y * 3 + x) % 11 AS s FROM fx_pixels)
    SELECT (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s DESC) AS z FROM c) WHERE z = (SELECT n FROM n)) AS threshold, (SELECT n FROM n) AS n_ref"""))
def _(spark, sf):
    p = Inputs(spark, sf).pixels
    changed = p.withColumn("v", F.col("v") * 1.5 + (F.col("image") * 8 + F.col("y") * 3 + F.col("x")) % 11)
    return R.calibrate_threshold(p, changed, 140.0)


@query("E14_top_k_per_image", with_views("fx_pixels", """SELECT image, y, x, v FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY v DESC, y, x) AS z FROM fx_pixels) WHERE z <= 12"""))
def _(spark, sf):
    return R.top_k_per_image(Inputs(spark, sf).pixels, 12)


@query("E15_sampled_percentiles", with_views("fx_pixels", """, f AS (SELECT DISTINCT image FROM fx_pixels ORDER BY image LIMIT 60),
    p AS (SELECT v FROM (SELECT v, row_number() OVER (PARTITION BY image ORDER BY md5('0|' || image || '|' || y || '|' || x)) AS z FROM fx_pixels WHERE image IN (SELECT image FROM f)) WHERE z <= 20)
    SELECT count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.97), 6) AS p97 FROM p"""))
def _(spark, sf):
    p = Inputs(spark, sf).pixels
    out = R.sampled_percentiles(p, p.select("image").distinct(), 60, 20, [0.5, 0.9, 0.97])
    return rounded(out, "p50", "p90", "p97")


SPLIT = """u AS (SELECT ('0x' || substr(md5('20261006|start'), 1, 13))::UBIGINT / 4503599627370496.0e0 AS u),
pos AS (SELECT *, row_number() OVER (ORDER BY source, grp, has_damage, md5('20261006|' || image), image) AS n FROM fx_strata),
split AS (SELECT image, source, grp, has_damage, CASE WHEN floor(u + n * 0.3e0) > floor(u + (n - 1) * 0.3e0) THEN 'test' ELSE 'dev' END AS split FROM pos, u)"""


def split_of(i: Inputs):
    return P.stratified_systematic_split(i.strata, ["source", "grp", "has_damage"], 0.3)


@query("E16_stratified_systematic_split", with_views("fx_strata", f", {SPLIT} SELECT * FROM split"))
def _(spark, sf):
    return split_of(Inputs(spark, sf))


@query("E17_split_balance", with_views("fx_strata", f""", {SPLIT}, l AS (SELECT split, 'source' AS "column", source AS level FROM split
    UNION ALL SELECT split, 'grp', grp FROM split UNION ALL SELECT split, 'has_damage', CAST(has_damage AS VARCHAR) FROM split)
    SELECT "column", level, count(*) FILTER (split='dev') AS n_dev, count(*) FILTER (split='test') AS n_test, round(count(*) FILTER (split='test') / count(*), 6) AS share FROM l GROUP BY ALL"""))
def _(spark, sf):
    return rounded(P.split_balance(split_of(Inputs(spark, sf)), ["source", "grp", "has_damage"], ("dev", "test")), "share")


@query("E18_sample_n", with_views("fx_det fx_truth", """, k AS (SELECT *, image || '/' || detector || '/' || did AS key FROM fx_det)
    SELECT image, detector, did FROM k ORDER BY md5('20261010|' || key), key LIMIT 150"""))
def _(spark, sf):
    keyed = Inputs(spark, sf).det.withColumn("key", F.concat_ws("/", "image", "detector", "did"))
    return P.sample_n(keyed, 150, 20261010, "key").select("image", "detector", "did")


@query("E19_hash_subset", with_views("fx_images", """, h AS (SELECT image, md5('mixed:' || image) AS h FROM fx_images),
    v AS (SELECT image, list_reduce([CAST(('0x' || substr(h, 1 + 4*i, 4)) AS BIGINT) for i in range(0, 8)], lambda a, b: (a * 65536 + b) % 20000) AS r FROM h)
    SELECT image, CASE WHEN (r // 10000) % 2 = 0 THEN 2.0e0 ELSE 3.5e0 END AS level FROM v WHERE (r % 10000) / 10000 < 0.25"""))
def _(spark, sf):
    return P.hash_subset(Inputs(spark, sf).images.select("image"), 0.25, [2.0, 3.5])


@query("E20_closest_to_target", with_views("fx_cells", """, m AS (SELECT c AS level, quantile_cont(std_v, 0.5) AS median, c % 3 AS kind FROM fx_cells GROUP BY c)
    SELECT kind, level, round(median, 6) AS median FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(median - 4.5), level) AS z FROM m) WHERE z = 1"""))
def _(spark, sf):
    med = R.exact_percentiles(Inputs(spark, sf).cells, ["c"], "std_v", [0.5], ["median"]).selectExpr("c % 3 AS kind", "c AS level", "median")
    return rounded(P.closest_to_target(med, ["kind"], "level", "median", 4.5), "median")


VERDICT = """CASE WHEN "precision" < 0.108 THEN 'below_precision_floor' WHEN recall_significant AND delta_recall < 0 THEN 'recall_loss'
    WHEN (recall_significant AND delta_recall > 0) OR (precision_significant AND delta_precision > 0 AND delta_fake_per_img <= 0) THEN 'improvement' ELSE 'no_difference' END"""


@query("E21_verdict", with_views("fx_det fx_truth fx_images", f", {COMPARED} SELECT tag, detector, kind, {VERDICT} AS verdict FROM compare WHERE detector <> 'D1'", recursive=True))
def _(spark, sf):
    return compared_of(Inputs(spark, sf)).filter("detector <> 'D1'").select("tag", "detector", "kind", C.verdict().alias("verdict"))


# a third detector that never splits a find in pieces, so that a setting can win against D2
def with_whole_pieces(i: Inputs):
    return i.det.unionByName(i.det.filter("detector = 'D1' AND did % 10 = 0").withColumn("detector", F.lit("D3")))


DET3 = "det3 AS (SELECT * FROM fx_det UNION ALL SELECT image, 'D3', kind, did, x1, y1, x2, y2 FROM fx_det WHERE detector='D1' AND did % 10 = 0)"
COMPARED3 = COMPARED.replace("fx_det", "det3").replace("('D1'),('D2')", "('D1'),('D2'),('D3')").replace("q.detector='D1'", "q.detector='D2'")


@query("E22_pick_config", with_views("fx_det fx_truth fx_images", f""", {DET3}, {COMPARED3},
judged AS (SELECT *, {VERDICT} AS verdict FROM compare WHERE detector <> 'D2'),
ok AS (SELECT c.* FROM judged c JOIN compare r ON r.tag='tune' AND r.detector='D2' AND r.kind=c.kind WHERE c.tag='tune' AND c.verdict='improvement' AND c.frag_per_hit <= r.frag_per_hit),
best AS (SELECT kind, detector FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY fake_per_img, detector) AS z FROM ok) WHERE z = 1)
SELECT b.kind, b.detector, v.delta_recall AS val_delta_recall, v."precision" AS val_precision, v.delta_recall >= 0 AND v."precision" >= 0.108 AS confirmed
FROM best b LEFT JOIN compare v ON v.tag='val' AND v.kind=b.kind AND v.detector=b.detector""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    names, groups = ["D1", "D2", "D3"], parts_of(i)
    scores = M.evaluate(i.images, with_whole_pieces(i), i.truth, names)
    reps = E.replicates(scores, groups, [(d, k, "in50") for d in names for k in ("crack", "pothole")], N_BOOT)
    c = E.compare_runs(reps, groups.groupBy("tag").agg(F.count("*").alias("n_images")), "D2")
    return rounded(C.pick_config(c.filter("detector <> 'D2'"), c.filter("detector = 'D2'")), "val_delta_recall", "val_precision")


@query("D14_quartiles_by_kind", with_views("fx_det", """SELECT kind, detector, count(*) AS n, round(quantile_cont((x2-x1)*(y2-y1), 0.25), 6) AS p25,
    round(quantile_cont((x2-x1)*(y2-y1), 0.5), 6) AS p50, round(quantile_cont((x2-x1)*(y2-y1), 0.75), 6) AS p75 FROM fx_det GROUP BY ALL"""))
def _(spark, sf):
    d = Inputs(spark, sf).det.selectExpr("kind", "detector", "(x2-x1)*(y2-y1) AS area")
    return rounded(R.exact_percentiles(d, ["kind", "detector"], "area", [0.25, 0.5, 0.75]), "p25", "p50", "p75")


@query("D17_feature_medians", with_views("fx_long", """SELECT feature, real, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM fx_long GROUP BY ALL"""))
def _(spark, sf):
    return rounded(X.feature_medians(Inputs(spark, sf).long_features, ["feature", "real"]), "median")


_BLOBS = f"""blobs AS (SELECT d.image, d.did, (x2-x1)*(y2-y1)/(640.0e0*440) AS area_ratio, greatest(x2-x1, y2-y1)/least(x2-x1, y2-y1) AS elong,
    (SELECT min(t.gid) FROM fx_truth t WHERE t.image=d.image AND {INSIDE_T}) AS g FROM fx_det d WHERE detector='D1')"""
AREAS, ELONGS = [0.005, 0.01, 0.02, 0.03], [1.0, 1.5, 2.0, 3.0]


@query("D18_threshold_sweep", with_views("fx_det fx_truth", f""", {_BLOBS},
b AS (SELECT area_ratio, elong, g IS NOT NULL AS inside, image || '/' || g AS box FROM blobs),
grid AS (SELECT a AS min_area, e AS elong_limit FROM (SELECT unnest([0.005e0, 0.01e0, 0.02e0, 0.03e0]) AS a), (SELECT unnest([1.0e0, 1.5e0, 2.0e0, 3.0e0]) AS e)),
s AS (SELECT min_area, elong_limit, count(*) AS kept, avg(inside::INT) AS purity, count(DISTINCT box) / (SELECT count(*) FROM fx_truth) AS recall
    FROM grid JOIN b ON area_ratio >= min_area AND elong >= elong_limit GROUP BY ALL)
SELECT min_area, elong_limit, kept, round(purity, 6) AS purity, round(recall, 6) AS recall, round(CASE WHEN purity + recall > 0 THEN 2*purity*recall/(purity+recall) ELSE 0 END, 6) AS f1 FROM s"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    truth = i.truth
    inside = S.members(i.det.filter("detector = 'D1'").drop("kind"), M.as_truth(truth.drop("kind")), ["image"]).groupBy("image", "did").agg(F.min("gid").alias("g"))
    blobs = i.det.filter("detector = 'D1'").join(large(inside), ["image", "did"], "left").selectExpr(
        "(x2-x1)*(y2-y1)/(640.0D*440) AS area_ratio", "greatest(x2-x1, y2-y1)/least(x2-x1, y2-y1) AS elong", "g IS NOT NULL AS inside",
        "CASE WHEN g IS NOT NULL THEN concat(image, '/', g) END AS box",
    )
    return rounded(X.threshold_sweep(blobs, AREAS, ELONGS, truth.count()), "purity", "recall", "f1")


GRID = [{"chroma": c, "aspect": a, "rel_y": y} for c in (99.0, 60.0, 30.0) for a in (99.0, 3.0, 2.0) for y in (0.0, 0.3, 0.5)]
_CANDS = """cands AS (SELECT image, kind, did, x1, y1, x2, y2, did // 10 % 97 + 0.0e0 AS chroma, greatest(x2-x1, y2-y1)/least(x2-x1, y2-y1) AS aspect, (y1+y2)/2/440.0e0 AS rel_y
    FROM fx_det WHERE detector='D1' AND kind='pothole'), parts AS (SELECT image, CASE WHEN image % 10 < 7 THEN 'tune' ELSE 'val' END AS split FROM fx_images)"""
_GRID_ROWS = ", ".join(f"({n}, {g['chroma']}e0, {g['aspect']}e0, {g['rel_y']}e0)" for n, g in enumerate(GRID))
GRID_SQL = f"""{_CANDS}, grid(grid, mc, ma, my) AS (VALUES {_GRID_ROWS}),
truths AS (SELECT t.* FROM fx_truth t WHERE kind='pothole'),
pass AS (SELECT g.grid, c.image, c.did FROM cands c JOIN grid g ON chroma <= mc AND aspect <= ma AND rel_y >= my),
pr AS (SELECT d.image, d.did, t.gid, ({INTER})/greatest({AREA_D},1) AS f FROM cands d JOIN truths t ON d.image=t.image AND {INSIDE_T}),
ranked AS (SELECT p.grid, p.image, pr.did, pr.gid, row_number() OVER (PARTITION BY p.grid, p.image ORDER BY f DESC, pr.did DESC, pr.gid DESC) AS rn FROM pass p JOIN pr USING (image, did)),
walk AS (SELECT grid, image, rn, [did] AS ds, [gid] AS gs FROM ranked WHERE rn = 1 UNION ALL SELECT r.grid, r.image, r.rn,
    CASE WHEN list_contains(w.ds, r.did) OR list_contains(w.gs, r.gid) THEN w.ds ELSE list_append(w.ds, r.did) END,
    CASE WHEN list_contains(w.ds, r.did) OR list_contains(w.gs, r.gid) THEN w.gs ELSE list_append(w.gs, r.gid) END
    FROM walk w JOIN ranked r ON r.grid=w.grid AND r.image=w.image AND r.rn=w.rn+1),
tp AS (SELECT grid, split, sum(n) AS tp FROM (SELECT grid, image, max(len(gs)) AS n FROM walk GROUP BY ALL) JOIN parts USING (image) GROUP BY ALL),
ins AS (SELECT grid, split, count(*) AS n FROM (SELECT DISTINCT grid, image, did FROM ranked) JOIN parts USING (image) GROUP BY ALL),
nd AS (SELECT grid, split, count(*) AS n FROM pass JOIN parts USING (image) GROUP BY ALL),
ng AS (SELECT split, count(*) AS n FROM truths JOIN parts USING (image) GROUP BY ALL),
ni AS (SELECT split, count(*) AS n FROM parts GROUP BY ALL),
res AS (SELECT g.grid, ni.split, CAST(coalesce(tp.tp, 0) AS BIGINT) AS tp, CAST(coalesce(nd.n, 0) - coalesce(ins.n, 0) AS BIGINT) AS fp,
    CAST(ng.n - coalesce(tp.tp, 0) AS BIGINT) AS fn, round((coalesce(nd.n, 0) - coalesce(ins.n, 0)) / ni.n, 6) AS fppi
    FROM grid g CROSS JOIN ni LEFT JOIN ng USING (split) LEFT JOIN tp ON tp.grid=g.grid AND tp.split=ni.split LEFT JOIN nd ON nd.grid=g.grid AND nd.split=ni.split
    LEFT JOIN ins ON ins.grid=g.grid AND ins.split=ni.split)"""


def grid_of(i: Inputs):
    cands = i.det.filter("detector = 'D1' AND kind = 'pothole'").selectExpr(
        "image", "kind", "did", "x1", "y1", "x2", "y2", "double(did div 10 % 97) AS chroma",
        "greatest(x2-x1, y2-y1)/least(x2-x1, y2-y1) AS aspect", "(y1+y2)/2/440.0D AS rel_y",
    )
    parts = i.images.selectExpr("image", "CASE WHEN image % 10 < 7 THEN 'tune' ELSE 'val' END AS split")
    return X.grid_search(cands, i.truth.filter("kind = 'pothole'"), parts, GRID, lower=["rel_y"])


@query("D19_grid_search", with_views("fx_det fx_truth fx_images", f", {GRID_SQL} SELECT * FROM res", recursive=True))
def _(spark, sf):
    return rounded(grid_of(Inputs(spark, sf)), "fppi")


@query("D19_pick_setting", with_views("fx_det fx_truth fx_images", f""", {GRID_SQL},
    best AS (SELECT grid FROM res WHERE split='tune' AND fppi <= 0.05 ORDER BY tp DESC, fppi, grid LIMIT 1) SELECT res.* FROM res JOIN best USING (grid)""", recursive=True))
def _(spark, sf):
    return rounded(X.pick_setting(grid_of(Inputs(spark, sf)), 0.05), "fppi")
