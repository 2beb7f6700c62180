"""Queries over boxes: crops, overlap, matching, control boxes, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import ratios
from ..functions.hashing import hash_key, hash_uniform
from ..operators import geometry as G
from ..operators import matching as M
from ..operators import membership as S
from ..operators import points as P
from ..params import KINDS
from ..session import large
from .registry import query
from .stand_ins import DETECTORS, Inputs, with_views

BY, TRUTH_BY = ["image", "detector", "kind"], ["image", "kind"]

# --- shared oracle text -------------------------------------------------------------------------------------------
INTER = "greatest(least(d.x2,t.x2)-greatest(d.x1,t.x1),0)*greatest(least(d.y2,t.y2)-greatest(d.y1,t.y1),0)"
AREA_D = "(greatest(d.x2-d.x1,0)*greatest(d.y2-d.y1,0))"
AREA_T = "(greatest(t.x2-t.x1,0)*greatest(t.y2-t.y1,0))"

PAIRS = f"""pairs AS (SELECT d.image, d.detector, d.kind, d.did, t.gid, {INTER} AS inter,
    ({INTER})/({AREA_D}+{AREA_T}-({INTER})) AS iou, ({INTER})/greatest({AREA_D},1) AS inside
    FROM fx_det d JOIN fx_truth t ON d.image=t.image AND d.kind=t.kind AND {INTER} > 0)"""

SCORED = "scored AS (SELECT image FROM fx_images WHERE has_gt)"

# best-first matching: rank the pairs of a group, then step through the ranks carrying the used ids
GREEDY = """cand AS (SELECT image, detector, kind, did, gid, 'iou50' AS criterion, iou AS f FROM pairs WHERE iou > 0.5
    UNION ALL SELECT image, detector, kind, did, gid, 'iou30', iou FROM pairs WHERE iou > 0.3
    UNION ALL SELECT image, detector, kind, did, gid, 'in50', inside FROM pairs WHERE inside >= 0.5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image, detector, kind, criterion ORDER BY f DESC, did DESC, gid DESC) AS rn FROM cand),
walk AS (
    SELECT image, detector, kind, criterion, rn, [did] AS ds, [gid] AS gs FROM ranked WHERE rn = 1
    UNION ALL
    SELECT r.image, r.detector, r.kind, r.criterion, r.rn,
        CASE WHEN list_contains(w.ds, r.did) OR list_contains(w.gs, r.gid) THEN w.ds ELSE list_append(w.ds, r.did) END,
        CASE WHEN list_contains(w.ds, r.did) OR list_contains(w.gs, r.gid) THEN w.gs ELSE list_append(w.gs, r.gid) END
    FROM walk w JOIN ranked r ON r.image=w.image AND r.detector=w.detector AND r.kind=w.kind AND r.criterion=w.criterion AND r.rn=w.rn+1),
tps AS (SELECT image, detector, kind, criterion, max(len(gs)) AS tp FROM walk GROUP BY ALL),
ins AS (SELECT image, detector, kind, count(DISTINCT did) AS n_inside FROM pairs WHERE inside >= 0.5 GROUP BY ALL)"""

SCORES = f"""{PAIRS}, {SCORED}, {GREEDY},
nd AS (SELECT image, detector, kind, count(*) AS n FROM fx_det GROUP BY ALL),
ng AS (SELECT image, kind, count(*) AS n FROM fx_truth GROUP BY ALL),
spine AS (SELECT image, detector, kind, criterion FROM scored, (VALUES ('D1'),('D2')) a(detector), (VALUES ('crack'),('pothole')) b(kind),
    (VALUES ('iou50'),('iou30'),('in50')) c(criterion)),
scores AS (SELECT s.image, s.detector, s.kind, s.criterion, CAST(coalesce(tp,0) AS BIGINT) AS tp,
    CAST(coalesce(nd.n,0) - CASE WHEN s.criterion='in50' THEN coalesce(n_inside,0) ELSE coalesce(tp,0) END AS BIGINT) AS fp,
    CAST(coalesce(ng.n,0) - coalesce(tp,0) AS BIGINT) AS fn, CAST(coalesce(ng.n,0) AS BIGINT) AS n_gt, CAST(0 AS BIGINT) AS n_cut,
    CAST(coalesce(nd.n,0) AS BIGINT) AS n_det
    FROM spine s LEFT JOIN tps USING (image, detector, kind, criterion) LEFT JOIN ins USING (image, detector, kind)
    LEFT JOIN nd USING (image, detector, kind) LEFT JOIN ng USING (image, kind))"""


def scores_of(i: Inputs):
    return M.evaluate(i.images, i.det, i.truth, DETECTORS)


CROPPED = """cropped AS (SELECT * FROM (SELECT t.image, t.kind, t.gid,
    greatest(0.0, (t.x1-g.crop_x)*g.scale_x) AS x1, greatest(0.0, (t.y1-g.crop_y)*g.scale_y) AS y1,
    least(g.output_width, (t.x2-g.crop_x)*g.scale_x) AS x2, least(g.output_height, (t.y2-g.crop_y)*g.scale_y) AS y2
    FROM fx_truth t JOIN fx_geometry g USING (image)) WHERE x2 > x1 AND y2 > y1)"""


@query("B1_to_crop", with_views("fx_truth fx_geometry", f", {CROPPED} SELECT * FROM cropped"))
def _(spark, sf):
    i = Inputs(spark, sf)
    return G.to_crop(i.truth, i.geometry)


@query("B2_count_cut", with_views("fx_truth fx_geometry", f""", {CROPPED}
    SELECT a.image, a.kind, CAST(a.n - coalesce(b.n, 0) AS BIGINT) AS n_cut FROM (SELECT image, kind, count(*) n FROM fx_truth GROUP BY ALL) a
    LEFT JOIN (SELECT image, kind, count(*) n FROM cropped GROUP BY ALL) b USING (image, kind)"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    truth = i.truth.join(large(i.geometry.select("image")), "image", "left_semi")
    return G.count_cut(truth, G.to_crop(truth, i.geometry))


@query("B3_to_original", with_views("fx_det fx_geometry", """SELECT d.image, d.detector, d.did, round(d.x1/g.scale_x+g.crop_x, 6) AS x,
    round(d.y1/g.scale_y+g.crop_y, 6) AS y, round((d.x2-d.x1)/g.scale_x, 6) AS w, round((d.y2-d.y1)/g.scale_y, 6) AS h
    FROM fx_det d JOIN fx_geometry g USING (image)"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    xywh = i.det.selectExpr("image", "detector", "did", "x1 AS x", "y1 AS y", "x2-x1 AS w", "y2-y1 AS h")
    out = G.to_original(xywh, i.geometry)
    return out.select("image", "detector", "did", *[F.round(c, 6).alias(c) for c in "xywh"])


@query("B4_box_expressions", with_views("fx_det", """SELECT image, detector, did, greatest(x2-x1,0)*greatest(y2-y1,0) AS area,
    greatest(least(x2,400)-greatest(x1,100),0)*greatest(least(y2,300)-greatest(y1,80),0) AS inter,
    (x1 < 400 AND x2 > 100 AND y1 < 300 AND y2 > 80) AS touches FROM fx_det"""))
def _(spark, sf):
    window = tuple(F.lit(float(v)) for v in (100, 80, 400, 300))
    return Inputs(spark, sf).det.select(
        "image", "detector", "did", B.area().alias("area"), B.intersection(B.DET_BOX, window).alias("inter"), B.overlaps(B.DET_BOX, window).alias("touches")
    )


_ROI = """CASE o_custkey % 6 WHEN 0 THEN 'full' WHEN 1 THEN 'bottom_half' WHEN 2 THEN 'bottom_' || CAST(o_custkey % 120 AS VARCHAR)
    WHEN 3 THEN '10,20,300,200' WHEN 4 THEN '400,10,500,300' END"""


@query("B5_crop_geometry", f"""WITH a AS (SELECT o_orderkey AS image, 600 + o_custkey % 401 AS w, 401 + o_custkey % 300 AS h,
    coalesce({_ROI}, 'bottom_half') AS roi, o_custkey % 120 AS pct FROM orders),
b AS (SELECT *, greatest(1, CAST(round_even(h * pct / 100.0, 0) AS BIGINT)) AS kept, roi LIKE 'bottom_%' AND roi <> 'bottom_half' AS is_pct FROM a),
c AS (SELECT image, w, h,
    CAST(CASE WHEN is_pct AND pct NOT BETWEEN 1 AND 100 THEN NULL WHEN roi='10,20,300,200' THEN 10 WHEN roi='400,10,500,300' THEN 400 ELSE 0 END AS BIGINT) AS x,
    CASE WHEN roi='full' THEN 0 WHEN roi='bottom_half' THEN h // 2 WHEN is_pct AND pct BETWEEN 1 AND 100 THEN h - kept
        WHEN roi='10,20,300,200' THEN 20 WHEN roi='400,10,500,300' THEN 10 END AS y,
    CASE WHEN is_pct AND pct NOT BETWEEN 1 AND 100 THEN NULL WHEN roi='10,20,300,200' THEN 300 WHEN roi='400,10,500,300' THEN 500 ELSE w END AS cw,
    CASE WHEN roi='full' THEN h WHEN roi='bottom_half' THEN h - h // 2 WHEN is_pct AND pct BETWEEN 1 AND 100 THEN kept
        WHEN roi='10,20,300,200' THEN 200 WHEN roi='400,10,500,300' THEN 300 END AS ch FROM b),
d AS (SELECT *, coalesce(x + cw <= w AND y + ch <= h, false) AS valid, 1024.0e0 / greatest(cw, ch) AS s FROM c),
e AS (SELECT *, CASE WHEN valid THEN greatest(1, CAST(round_even(cw * s, 0) AS BIGINT)) END AS ow,
    CASE WHEN valid THEN greatest(1, CAST(round_even(ch * s, 0) AS BIGINT)) END AS oh FROM d)
SELECT image, w AS original_width, h AS original_height, x AS crop_x, y AS crop_y, cw AS crop_width, ch AS crop_height,
    ow AS output_width, oh AS output_height, round(ow / cw, 6) AS scale_x, round(oh / ch, 6) AS scale_y, valid FROM e""")
def _(spark, sf):
    roi = _ROI.replace("VARCHAR", "STRING")
    images = Inputs(spark, sf).table("orders").selectExpr(
        "o_orderkey AS image", "600 + o_custkey % 401 AS original_width", "401 + o_custkey % 300 AS original_height", f"{roi} AS roi"
    )
    return G.crop_geometry(images).withColumns({"scale_x": F.round("scale_x", 6), "scale_y": F.round("scale_y", 6)})


@query("B9_rings", with_views("fx_truth", """SELECT image, gid, 'double' AS ring,
    greatest(0, trunc((x1+x2)/2-(x2-x1+6))) AS ox1, greatest(0, trunc((y1+y2)/2-(y2-y1+6))) AS oy1,
    least(640, trunc((x1+x2)/2+(x2-x1+6))) AS ox2, least(440, trunc((y1+y2)/2+(y2-y1+6))) AS oy2,
    greatest(0, x1-2) AS ix1, greatest(0, y1-2) AS iy1, least(640, x2+2) AS ix2, least(440, y2+2) AS iy2 FROM fx_truth
    UNION ALL SELECT image, gid, 'half', greatest(0, x1-floor((x2-x1)/2)), greatest(0, y1-floor((y2-y1)/2)),
    least(640, x2+floor((x2-x1)/2)), least(440, y2+floor((y2-y1)/2)), x1, y1, x2, y2 FROM fx_truth
    UNION ALL SELECT image, gid, 'grown', greatest(0, floor(x1-(x2-x1)*0.5-8)), greatest(0, floor(y1-(y2-y1)*0.5-8)),
    least(640, ceil(x2+(x2-x1)*0.5+8)), least(440, ceil(y2+(y2-y1)*0.5+8)), x1, y1, x2, y2 FROM fx_truth"""))
def _(spark, sf):
    truth = Inputs(spark, sf).truth
    w, h = F.lit(640.0), F.lit(440.0)
    rings = {
        "double": B.ring_double(B.DET_BOX, w, h), "half": B.ring_half(B.DET_BOX, w, h),
        "grown": B.ring_grown(B.DET_BOX, w, h, factor=2.0, pixels=8.0),
    }
    options = F.array(*[F.struct(F.lit(n).alias("ring"), *[c.alias(k) for k, c in r.items()]) for n, r in rings.items()])
    return truth.select("image", "gid", F.inline(options))


@query("B10_touches_border", with_views("fx_det", """SELECT image, detector, did, (y1 <= 2) AS top, (y2 >= 298 OR x1 <= 2) AS bottom_left,
    (x2 >= 598) AS "right" FROM fx_det"""))
def _(spark, sf):
    d = Inputs(spark, sf).det.selectExpr("*", "x1 AS x", "y1 AS y", "x2-x1 AS w", "y2-y1 AS h")
    w, h = F.lit(600.0), F.lit(300.0)
    return d.select(
        "image", "detector", "did", B.touches_border(w, h, "t").alias("top"), B.touches_border(w, h, "bl").alias("bottom_left"),
        B.touches_border(w, h, "r").alias("right"),
    )


# cut to six digits by a floor: ratios that lie on exact halves round alike in every engine
@query("C1_overlap_pairs", with_views("fx_det fx_truth", f", {PAIRS} SELECT image, detector, kind, did, gid, inter, floor(iou*1e6+0.5e0)/1e6 AS iou, floor(inside*1e6+0.5e0)/1e6 AS inside FROM pairs"))
def _(spark, sf):
    i = Inputs(spark, sf)
    p = M.scored_pairs(i.det, i.truth, TRUTH_BY)
    return p.select(*BY, "did", "gid", "inter", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("iou", "inside")])


@query("C2_greedy_one_to_one", with_views("fx_det fx_truth", f""", {PAIRS}, {GREEDY},
    last AS (SELECT *, row_number() OVER (PARTITION BY image, detector, kind ORDER BY rn DESC) AS z FROM walk WHERE criterion='in50')
    SELECT image, detector, kind, unnest(ds) AS did, unnest(gs) AS gid FROM last WHERE z = 1""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    pairs = M.scored_pairs(i.det, i.truth, TRUTH_BY).filter("inside >= 0.5").withColumn("score", F.col("inside"))
    big = M.oversized_groups(i.det, i.truth, BY, TRUTH_BY)
    return M.greedy_one_to_one(pairs, BY, big).drop("score")


def _match_sql(criterion):
    return with_views("fx_det fx_truth fx_images", f""", {SCORES} SELECT image, detector, kind, tp, fp, fn, n_det, n_gt FROM scores
        WHERE criterion='{criterion}' AND n_det > 0""", recursive=True)


def _match(name, criterion):
    @query(name, _match_sql(criterion))
    def _(spark, sf):
        i = Inputs(spark, sf)
        scored = i.images.filter("has_gt").select("image")
        return M.match_one(i.det.join(large(scored), "image", "left_semi"), i.truth, BY, TRUTH_BY, criterion)


_match("C3_match_iou50", "iou50")
_match("C3_match_iou30", "iou30")
_match("C4_match_inside", "in50")


@query("C5_evaluate", with_views("fx_det fx_truth fx_images", f", {SCORES} SELECT * FROM scores", recursive=True))
def _(spark, sf):
    return scores_of(Inputs(spark, sf))


CUT_DET = """d2 AS (SELECT * FROM (SELECT d.image, d.detector, d.kind, d.did,
    greatest(0.0, (d.x1-g.crop_x)*g.scale_x) AS x1, greatest(0.0, (d.y1-g.crop_y)*g.scale_y) AS y1,
    least(g.output_width, (d.x2-g.crop_x)*g.scale_x) AS x2, least(g.output_height, (d.y2-g.crop_y)*g.scale_y) AS y2
    FROM fx_det d JOIN fx_geometry g USING (image)) WHERE x2 > x1 AND y2 > y1)"""


@query("C5_evaluate_cropped", with_views("fx_det fx_truth fx_images fx_geometry",
    f", {CROPPED}, {CUT_DET}, " + SCORES.replace("fx_det", "d2").replace("fx_truth t", "cropped t").replace("FROM fx_truth GROUP", "FROM cropped GROUP")
    + """, cuts AS (SELECT image, kind, CAST(count(*) AS BIGINT) AS n_all FROM fx_truth GROUP BY ALL)
    SELECT s.image, s.detector, s.kind, s.criterion, s.tp, s.fp, CAST(coalesce(n_all,0) - s.tp AS BIGINT) AS fn,
        CAST(coalesce(n_all,0) AS BIGINT) AS n_gt, CAST(coalesce(n_all,0) - s.n_gt AS BIGINT) AS n_cut, s.n_det
    FROM scores s LEFT JOIN cuts USING (image, kind)""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    truth = i.truth.join(large(i.geometry.select("image")), "image", "left_semi")
    kept = G.to_crop(truth, i.geometry)
    return M.evaluate(i.images, G.to_crop(i.det, i.geometry), kept, DETECTORS, cut=G.count_cut(truth, kept))


CONTROL = """big AS (SELECT * FROM fx_truth WHERE (x2-x1)*(y2-y1) >= 400),
opts AS (SELECT image, kind, gid, 0 AS ord, x1-(x2-x1) AS cx1, y1 AS cy1, x1 AS cx2, y2 AS cy2 FROM fx_truth
    UNION ALL SELECT image, kind, gid, 1, x2, y1, x2+(x2-x1), y2 FROM fx_truth
    UNION ALL SELECT image, kind, gid, 2, x1, y2, x2, y2+(y2-y1) FROM fx_truth
    UNION ALL SELECT image, kind, gid, 3, x1, y1-(y2-y1), x2, y1 FROM fx_truth),
fit AS (SELECT * FROM opts o WHERE cx1 >= 0 AND cy1 >= 0 AND cx2 <= 640 AND cy2 <= 440 AND NOT EXISTS (
    SELECT 1 FROM fx_truth t WHERE t.image=o.image AND t.x1 < o.cx2 AND t.x2 > o.cx1 AND t.y1 < o.cy2 AND t.y2 > o.cy1)),
ctl AS (SELECT image, kind, gid, cx1, cy1, cx2, cy2 FROM (SELECT *, row_number() OVER (PARTITION BY image, gid ORDER BY ord) AS z FROM fit) WHERE z = 1)"""


def frame_of(i: Inputs):
    return i.images.select("image", F.lit(640.0).alias("width"), F.lit(440.0).alias("height"))


@query("C6_control_box_side", with_views("fx_truth fx_images", f", {CONTROL} SELECT * FROM ctl"))
def _(spark, sf):
    i = Inputs(spark, sf)
    return S.control_box_side(i.truth, frame_of(i))


INSIDE_T = f"({INTER}) > 0 AND ({INTER}) >= 0.5*greatest({AREA_D},1)"


@query("C7_has_member", with_views("fx_det fx_truth", f"""SELECT DISTINCT d.image, d.detector, d.kind, t.gid FROM fx_det d JOIN fx_truth t
    ON d.image=t.image AND d.kind=t.kind AND {INSIDE_T}"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    regions = M.as_truth(i.truth.select("image", "kind", "gid", *B.DET_BOX))
    return S.has_member(i.det.select(*BY, *B.DET_BOX), regions, TRUTH_BY, ["detector", "gid"])


@query("C8_separation", with_views("fx_det fx_truth fx_images", f""", {SCORED}, {CONTROL},
c2 AS (SELECT c.* FROM ctl c JOIN big USING (image, kind, gid) JOIN scored USING (image)),
n AS (SELECT image, kind, count(*) AS n FROM c2 GROUP BY ALL),
h AS (SELECT image, kind, detector, count(*) AS hit FROM (SELECT DISTINCT d.image, d.kind, d.detector, t.gid FROM c2 JOIN fx_truth t USING (image, kind, gid)
    JOIN fx_det d ON d.image=t.image AND d.kind=t.kind AND {INSIDE_T}) GROUP BY ALL),
f AS (SELECT image, kind, detector, count(*) AS fhit FROM (SELECT DISTINCT d.image, d.kind, d.detector, t.gid
    FROM (SELECT image, kind, gid, cx1 AS x1, cy1 AS y1, cx2 AS x2, cy2 AS y2 FROM c2) t
    JOIN fx_det d ON d.image=t.image AND d.kind=t.kind AND {INSIDE_T}) GROUP BY ALL)
SELECT s.image, b.kind, a.detector, CAST(coalesce(n,0) AS BIGINT) AS n, CAST(coalesce(hit,0) AS BIGINT) AS hit, CAST(coalesce(fhit,0) AS BIGINT) AS fhit
FROM scored s CROSS JOIN (VALUES ('D1'),('D2')) a(detector) CROSS JOIN (VALUES ('crack'),('pothole')) b(kind)
LEFT JOIN n ON n.image=s.image AND n.kind=b.kind LEFT JOIN h ON h.image=s.image AND h.kind=b.kind AND h.detector=a.detector
LEFT JOIN f ON f.image=s.image AND f.kind=b.kind AND f.detector=a.detector"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    return S.separation(i.images, i.det, i.truth, frame_of(i), DETECTORS)


@query("C9_control_box_random", with_views("fx_truth fx_images", """, tries AS (SELECT image, kind, gid, k,
    (('0x' || substr(md5('7|' || image || '|' || gid || '|' || k), 1, 13))::UBIGINT / 4503599627370496.0e0) * (640.0e0 - (x2 - x1)) AS cx1, x2 - x1 AS w, y1, y2
    FROM fx_truth JOIN fx_images USING (image) CROSS JOIN range(1, 21) r(k)),
ok AS (SELECT * FROM tries c WHERE NOT EXISTS (SELECT 1 FROM fx_truth t WHERE t.image=c.image AND t.x1 < c.cx1 + c.w AND t.x2 > c.cx1 AND t.y1 < c.y2 AND t.y2 > c.y1))
SELECT image, kind, gid, round(cx1, 6) AS cx1, y1 AS cy1, round(cx1 + w, 6) AS cx2, y2 AS cy2 FROM (SELECT *, row_number() OVER (PARTITION BY image, gid ORDER BY k) AS z FROM ok) WHERE z = 1"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    c = S.control_box_random(i.truth, frame_of(i), seed=7)
    return c.withColumns({"cx1": F.round("cx1", 6), "cx2": F.round("cx2", 6)})


@query("C10_touching", with_views("fx_truth", """SELECT DISTINCT a.image, a.kind, a.gid FROM fx_truth a JOIN fx_truth b ON a.image=b.image AND a.kind=b.kind AND a.gid <> b.gid
    AND greatest(a.x1,b.x1) - least(a.x2,b.x2) <= 10 AND greatest(a.y1,b.y1) - least(a.y2,b.y2) <= 10"""))
def _(spark, sf):
    return S.touching(Inputs(spark, sf).truth).select("image", "kind", "gid")


BEST = f"""best AS (SELECT d.image, d.detector, d.kind, d.did, coalesce(max(CASE WHEN t.gid IS NOT NULL THEN ({INTER})/greatest({AREA_D},1) END), 0) AS gt_overlap
    FROM fx_det d LEFT JOIN fx_truth t ON d.image=t.image AND d.kind=t.kind AND {INTER} > 0 GROUP BY ALL)"""


@query("C11_fakes", with_views("fx_det fx_truth", f""", {BEST}, f AS (SELECT * FROM best WHERE gt_overlap < 0.5)
    SELECT image, detector, kind, did, round(gt_overlap, 6) AS gt_overlap, count(*) OVER (PARTITION BY image, detector) AS n_fake_in_image FROM f"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    f = S.fakes(i.det, i.truth, BY, TRUTH_BY, ["image", "detector"])
    return f.select(*BY, "did", F.round("gt_overlap", 6).alias("gt_overlap"), "n_fake_in_image")


@query("C12_nearest_box", with_views("fx_det fx_truth", """SELECT image, qid, did, distance FROM (
    SELECT t.image, t.gid AS qid, d.did, abs(d.x1-t.x1)+abs(d.y1-t.y1)+abs((d.x2-d.x1)-(t.x2-t.x1))+abs((d.y2-d.y1)-(t.y2-t.y1)) AS distance,
    row_number() OVER (PARTITION BY t.image, t.gid ORDER BY abs(d.x1-t.x1)+abs(d.y1-t.y1)+abs((d.x2-d.x1)-(t.x2-t.x1))+abs((d.y2-d.y1)-(t.y2-t.y1)), d.did) AS z
    FROM fx_truth t JOIN fx_det d ON d.image=t.image AND d.detector='D1') WHERE z = 1"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    xywh = ["x1 AS x", "y1 AS y", "x2-x1 AS w", "y2-y1 AS h"]
    return S.nearest_box(i.det.filter("detector = 'D1'").selectExpr("image", "did", *xywh), i.truth.selectExpr("image", "gid AS qid", *xywh))


@query("C16_label_real_fake", with_views("fx_det fx_truth", f", {BEST} SELECT image, detector, kind, did, gt_overlap >= 0.5 AS real FROM best"))
def _(spark, sf):
    i = Inputs(spark, sf)
    return S.label_real(i.det, i.truth, BY, TRUTH_BY).select(*BY, "did", "real")


@query("C17_pair_runs", with_views("fx_det fx_truth fx_images", f""", {SCORES},
    one AS (SELECT image, kind, detector, tp, fp, fn, n_det FROM scores WHERE criterion='in50')
    SELECT a.image, a.kind, a.tp AS ref_tp, a.fp AS ref_fp, b.tp AS new_tp, b.fp AS new_fp FROM one a JOIN one b USING (image, kind)
    WHERE a.detector='D1' AND b.detector='D2'""", recursive=True))
def _(spark, sf):
    s = scores_of(Inputs(spark, sf)).filter("criterion = 'in50'")
    key = F.struct("image", "kind")
    a, b = (s.filter(F.col("detector") == d).withColumn("key", key) for d in DETECTORS)
    return S.pair_runs(a, b, ["tp", "fp"], key="key").select("key.*", "ref_tp", "ref_fp", "new_tp", "new_fp")


@query("C18_overlap_hit_score", with_views("fx_det fx_truth", f""", {PAIRS}
    SELECT d.image, d.detector, d.kind, d.n_det, coalesce(g.n_gt, 0) AS n_gt, coalesce(p.n_hit, 0) AS n_hit, coalesce(p.n_correct, 0) AS n_correct
    FROM (SELECT image, detector, kind, count(*) AS n_det FROM fx_det GROUP BY ALL) d LEFT JOIN (SELECT image, kind, count(*) AS n_gt FROM fx_truth GROUP BY ALL) g USING (image, kind)
    LEFT JOIN (SELECT image, detector, kind, count(DISTINCT gid) AS n_hit, count(DISTINCT did) AS n_correct FROM pairs GROUP BY ALL) p USING (image, detector, kind)"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    return M.overlap_hit_score(i.det, i.truth, BY, TRUTH_BY)


STAGES = ["none", "found_small", "found_short", "found_border", "found"]


@query("C21_stage_of_truth", with_views("fx_det fx_truth", f"""SELECT t.image, t.kind, t.gid,
    ['none','found_small','found_short','found_border','found'][coalesce(max(1 + d.did % 4), 0) + 1] AS stage
    FROM fx_truth t LEFT JOIN fx_det d ON d.image=t.image AND d.detector='D1' AND {INSIDE_T} GROUP BY ALL"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    cands = i.det.filter("detector = 'D1'").withColumn("stage_ord", (1 + F.col("did") % 4).cast("int"))
    return S.stage_of_truth(cands, i.truth, STAGES)


@query("C22_attach_subset", with_views("fx_images", """SELECT image, tags, (image IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) AS in_list FROM fx_images"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    listed = i.table("lineitem").filter("l_quantity > 45").selectExpr("l_orderkey AS image")
    return S.attach_subset(i.images.select("image", "tags"), listed)


@query("C13_near_pairs", with_views("fx_points", """SELECT a.image, a.pid AS pid, b.pid AS other FROM fx_points a JOIN fx_points b
    ON a.image=b.image AND a.pid < b.pid AND abs(a.x-b.x) <= 45 AND abs(a.y-b.y) <= 45"""))
def _(spark, sf):
    return P.near_pairs(Inputs(spark, sf).points, 45).select("image", "pid", "other")


_PTS = """pts AS (SELECT image, pid, x, y, label, cos(pid % 360 * pi() / 180) AS ux, sin(pid % 360 * pi() / 180) AS uy FROM fx_points)"""


@query("C14_link_endpoints", with_views("fx_points", f""", {_PTS},
cand AS (SELECT a.image, a.pid AS i, b.pid AS j, sqrt(CAST((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS DOUBLE)) AS dist,
    a.ux*(b.x-a.x)+a.uy*(b.y-a.y) AS fa, b.ux*(a.x-b.x)+b.uy*(a.y-b.y) AS fb
    FROM pts a JOIN pts b ON a.image=b.image AND a.pid < b.pid AND abs(a.x-b.x) <= 90 AND abs(a.y-b.y) <= 90 AND a.label <> b.label),
ok AS (SELECT image, i, j, dist FROM cand WHERE dist > 0 AND dist <= 90 AND fa/dist >= cos(radians(60)) AND fb/dist >= cos(radians(60))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY dist, i, j) AS rn FROM ok),
walk AS (SELECT image, rn, [i, j] AS used FROM ranked WHERE rn = 1 UNION ALL
    SELECT r.image, r.rn, CASE WHEN list_contains(w.used, r.i) OR list_contains(w.used, r.j) THEN w.used ELSE list_append(list_append(w.used, r.i), r.j) END
    FROM walk w JOIN ranked r ON r.image=w.image AND r.rn=w.rn+1),
fin AS (SELECT image, used FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY rn DESC) AS z FROM walk) WHERE z = 1)
SELECT f.image, used[k*2+1] AS pid, used[k*2+2] AS other FROM fin f, LATERAL (SELECT unnest(range(len(used)//2)) AS k)""", recursive=True))
def _(spark, sf):
    pts = Inputs(spark, sf).points.selectExpr("*", "cos(pid % 360 * pi() / 180) AS ux", "sin(pid % 360 * pi() / 180) AS uy")
    return P.link_endpoints(pts, distance=90, angle=60).select("image", "pid", "other")


@query("C15_nearest_piece", with_views("fx_points", """, e AS (SELECT image, label, pid, x, y, (pid * 7) % 180 AS angle FROM fx_points),
d AS (SELECT a.image, a.label, b.label AS other, sqrt(CAST((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS DOUBLE)) AS gap
    FROM e a JOIN e b ON a.image=b.image AND a.label <> b.label),
g AS (SELECT image, label, other, min(gap) AS gap FROM d GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY gap, other) AS z FROM g)
SELECT m.image, m.label, m.other, round(m.gap, 6) AS gap,
    CAST(least(abs(m.label*13%180 - m.other*13%180), 180 - abs(m.label*13%180 - m.other*13%180)) AS DOUBLE) AS turn FROM m WHERE z = 1"""))
def _(spark, sf):
    pts = Inputs(spark, sf).points.selectExpr("*", "double(label*13%180) AS angle")
    out = P.nearest_piece(pts)
    return out.select("image", "label", "other", F.round("gap", 6).alias("gap"), "turn")


@query("E23_circular_alignment", with_views("fx_points", """SELECT image, round(atan2(sum(w*sin(2*t)), sum(w*cos(2*t)))/2, 6) AS direction,
    round(sqrt(sum(w*sin(2*t))*sum(w*sin(2*t)) + sum(w*cos(2*t))*sum(w*cos(2*t)))/sum(w), 6) AS alignment
    FROM (SELECT image, x * pi() / 2000 AS t, 1.0e0 + y / 2000.0e0 AS w FROM fx_points) GROUP BY image"""))
def _(spark, sf):
    pts = Inputs(spark, sf).points.selectExpr("image", "x * pi() / 2000 AS theta", "1.0D + y / 2000.0D AS weight")
    out = P.circular_alignment(pts, ["image"])
    return out.select("image", F.round("direction", 6).alias("direction"), F.round("alignment", 6).alias("alignment"))
