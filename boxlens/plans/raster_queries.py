"""Queries over pixel and cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import geometry as GE
from ..operators import reports as D
from ..operators.raster import cells as CE
from ..operators.raster import colour as CO
from ..operators.raster import components as CC
from ..operators.raster import cues as CU
from ..operators.raster import grid as G
from ..operators.raster import lines as LI
from ..operators.raster import quality as Q
from ..params import GammaRule, MaskRules
from .registry import query
from .stand_ins import Inputs, with_views
from .stats_queries import rounded

FRAME8 = {"w": "8L", "h": "8L"}


def framed(df):
    return df.withColumns({n: F.expr(e) for n, e in FRAME8.items()})


LIMIT = 130.0


def px_of(i: Inputs):
    """8 x 8 rasters with the frame size, a gray value v and colour channels derived from it."""
    return framed(i.pixels).select(
        "*", F.col("v").alias("b"), F.expr("double((bigint(v)*7 + x*3 + y) % 256)").alias("g"), F.expr("double((bigint(v)*11 + y*5) % 256)").alias("r")
    )


PX = """px AS (SELECT *, 8 AS w, 8 AS h, v AS b, CAST((CAST(v AS BIGINT)*7 + x*3 + y) % 256 AS DOUBLE) AS g, CAST((CAST(v AS BIGINT)*11 + y*5) % 256 AS DOUBLE) AS r FROM fx_pixels)"""


def refl(k, axis):
    """SQL position of the neighbour at offset k under reflect-101 on a line of eight."""
    return f"(CASE WHEN {axis}+({k}) < 0 THEN -({axis}+({k})) WHEN {axis}+({k}) > 7 THEN 14-({axis}+({k})) ELSE {axis}+({k}) END)"


def conv_sql(src, col, kx, ky, table="px"):
    """Oracle for a separable filter with reflect-101 borders: two self joins on weight lists."""
    rx, ry = len(kx) // 2, len(ky) // 2
    vx = ", ".join(f"({i - rx}, {w!r})" for i, w in enumerate(kx))
    vy = ", ".join(f"({i - ry}, {w!r})" for i, w in enumerate(ky))
    px, py = refl("k", "a.x"), refl("k", "a.y")
    return f"""{src}_h AS (SELECT a.image, a.y, a.x, sum(p.{col} * wt) AS s FROM {table} a CROSS JOIN (VALUES {vx}) t(k, wt) JOIN {table} p ON p.image=a.image AND p.y=a.y AND p.x={px} GROUP BY ALL),
{src} AS (SELECT a.image, a.y, a.x, sum(p.s * wt) AS s FROM {src}_h a CROSS JOIN (VALUES {vy}) t(k, wt) JOIN {src}_h p ON p.image=a.image AND p.x=a.x AND p.y={py} GROUP BY ALL)"""


ONE = [0.0, 1.0, 0.0]


@query("R2_channels", with_views("fx_pixels", f""", {PX}, c AS (SELECT *, greatest(b,g,r) AS mx, least(b,g,r) AS mn FROM px)
    SELECT image, y, x, CAST(floor(b*0.114e0 + g*0.587e0 + r*0.299e0 + 0.5) AS DOUBLE) AS gray, round(CASE WHEN mx=mn THEN 0 WHEN mx=r THEN CASE WHEN g < b THEN (g-b)*60.0e0/(mx-mn) + 360 ELSE (g-b)*60.0e0/(mx-mn) END
    WHEN mx=g THEN 120 + (b-r)*60.0e0/(mx-mn) ELSE 240 + (r-g)*60.0e0/(mx-mn) END, 6) AS hue, round(CASE WHEN mx=0 THEN 0 ELSE (mx-mn)*255.0e0/mx END, 6) AS sat, mx AS val,
    round(r/(b+g+r+1), 6) AS cr, round(g/(b+g+r+1), 6) AS cg FROM c"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumns(CO.hsv()).withColumns(CO.chroma_plane()).withColumn("gray", CO.gray())
    return rounded(p.select("image", "y", "x", "gray", "hue", "sat", "val", "cr", "cg"), "hue", "sat", "cr", "cg")


def _lin(c):
    return f"(CASE WHEN {c}/255.0e0 <= 0.04045 THEN {c}/255.0e0/12.92e0 ELSE pow(({c}/255.0e0+0.055e0)/1.055e0, 2.4e0) END)"


@query("R2_lab", with_views("fx_pixels", f""", {PX}, l AS (SELECT image, y, x, {_lin('b')} AS lb, {_lin('g')} AS lg, {_lin('r')} AS lr FROM px),
    t AS (SELECT image, y, x, (lr*0.412453e0+lg*0.357580e0+lb*0.180423e0)/0.950456e0 AS tx, lr*0.212671e0+lg*0.715160e0+lb*0.072169e0 AS ty, (lr*0.019334e0+lg*0.119193e0+lb*0.950227e0)/1.088754e0 AS tz FROM l),
    f AS (SELECT *, CASE WHEN tx > 0.008856 THEN cbrt(tx) ELSE tx*7.787e0+16/116.0e0 END AS fx, CASE WHEN ty > 0.008856 THEN cbrt(ty) ELSE ty*7.787e0+16/116.0e0 END AS fy, CASE WHEN tz > 0.008856 THEN cbrt(tz) ELSE tz*7.787e0+16/116.0e0 END AS fz FROM t)
    SELECT image, y, x, round(CASE WHEN ty > 0.008856 THEN cbrt(ty)*116-16 ELSE ty*903.3e0 END, 5) AS "L", round((fx-fy)*500, 5) AS a, round((fy-fz)*200, 5) AS bb FROM f"""))
def _(spark, sf):
    return rounded(px_of(Inputs(spark, sf)).select("image", "y", "x", *[c.alias(n) for n, c in CO.lab().items()]), "L", "a", "bb", digits=5)


@query("R3_downsample", with_views("fx_pixels", """, c AS (SELECT image, v, y, x, t.ty, t.tx, greatest(least((x+1)*3/8.0e0, tx+1) - greatest(x*3/8.0e0, tx), 0) * greatest(least((y+1)*3/8.0e0, ty+1) - greatest(y*3/8.0e0, ty), 0) AS s
    FROM fx_pixels CROSS JOIN (SELECT a.i AS ty, b.i AS tx FROM range(3) a(i), range(3) b(i)) t)
    SELECT image, ty AS y, tx AS x, 3 AS w, 3 AS h, round(sum(v*s)/sum(s), 6) AS v FROM c WHERE s > 1e-12 GROUP BY ALL"""))
def _(spark, sf):
    out = G.downsample(px_of(Inputs(spark, sf)), ["v"], 3)
    return rounded(out.withColumns({"w": F.col("w").cast("int"), "h": F.col("h").cast("int")}), "v")


@query("R3_resize_nearest", with_views("fx_pixels", """SELECT image, t.i AS y, u.i AS x, v > 130 AS mask FROM fx_pixels p JOIN range(13) t(i) ON p.y = floor(t.i * 8 / 13) JOIN range(5) u(i) ON p.x = floor(u.i * 8 / 5)"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("mask", F.col("v") > LIMIT)
    sizes = p.select("image").distinct().select("image", F.lit(5).cast("bigint").alias("w"), F.lit(13).cast("bigint").alias("h"))
    return G.resize_nearest(p, ["mask"], sizes).select("image", "y", "x", "mask")


@query("R4_crop", with_views("fx_pixels", "SELECT image, y - image % 3 AS y, x - 2 AS x, v FROM fx_pixels WHERE x >= 2 AND x < 7 AND y >= image % 3 AND y < image % 3 + 4"))
def _(spark, sf):
    p = px_of(Inputs(spark, sf))
    rects = p.select("image").distinct().selectExpr("image", "2 AS crop_x", "image % 3 AS crop_y", "5 AS crop_width", "4 AS crop_height")
    return G.crop(p, rects).select("image", "y", "x", "v")


@query("R5_box_sum", with_views("fx_pixels", """SELECT a.image, a.y, a.x, sum(p.v) AS total, round(sum(p.v) FILTER (abs(p.x-a.x) <= 1 AND abs(p.y-a.y) <= 1), 6) AS small FROM fx_pixels a JOIN fx_pixels p
    ON p.image=a.image AND abs(p.x-a.x) <= 2 AND abs(p.y-a.y) <= 2 GROUP BY ALL"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf))
    return G.box_sum(G.box_sum(p, {"total": "v"}, 5), {"small": "v"}, 3).select("image", "y", "x", "total", "small")


@query("R5_integral", with_views("fx_pixels", """SELECT image, y, x, sum(r) OVER (PARTITION BY image, x ORDER BY y) AS sat FROM (SELECT *, sum(v) OVER (PARTITION BY image, y ORDER BY x) AS r FROM fx_pixels)"""))
def _(spark, sf):
    return G.integral(px_of(Inputs(spark, sf)), "v").select("image", "y", "x", "sat")


@query("R5_box_mean", with_views("fx_pixels", f", {PX}, {conv_sql('m', 'v', [0.2] * 5, [0.2] * 5)} SELECT image, y, x, round(s, 6) AS mean FROM m"))
def _(spark, sf):
    return rounded(G.box_mean(px_of(Inputs(spark, sf)), {"mean": "v"}, 5).select("image", "y", "x", "mean"), "mean")


GK = G.gaussian_kernel(1.0, 3)


@query("R6_gaussian", with_views("fx_pixels", f", {PX}, {conv_sql('m', 'v', GK, GK)} SELECT image, y, x, round(s, 6) AS v FROM m"))
def _(spark, sf):
    return rounded(G.gaussian(px_of(Inputs(spark, sf)), ["v"], 1.0, 3).select("image", "y", "x", "v"), "v")


@query("R6_gradients", with_views("fx_pixels", f""", {PX}, {conv_sql('gx', 'v', G.DIFF, G.SMOOTH)}, {conv_sql('gy', 'v', G.SMOOTH, G.DIFF)}, {conv_sql('lx', 'v', G.SECOND, ONE)}, {conv_sql('ly', 'v', ONE, G.SECOND)}
    SELECT gx.image, gx.y, gx.x, gx.s AS gx, gy.s AS gy, lx.s + ly.s AS lap, round(sqrt(gx.s*gx.s + gy.s*gy.s), 6) AS grad FROM gx JOIN gy USING (image, y, x) JOIN lx USING (image, y, x) JOIN ly USING (image, y, x)"""))
def _(spark, sf):
    p = G.laplacian(G.gradient_magnitude(G.sobel(px_of(Inputs(spark, sf)), "v"), "v"), "v")
    return rounded(p.select("image", "y", "x", "gx", "gy", "lap", "grad"), "grad")


QUALITY_SQL = f"""{PX}, {conv_sql('lx', 'v', G.SECOND, ONE)}, {conv_sql('ly', 'v', ONE, G.SECOND)}, {conv_sql('nz', 'v', G.SECOND, G.SECOND)},
    r AS (SELECT p.image, p.y, p.x, p.v, greatest(p.b, p.g, p.r) AS val, lx.s + ly.s AS lap, nz.s AS nz FROM px p JOIN lx USING (image, y, x) JOIN ly USING (image, y, x) JOIN nz USING (image, y, x))"""


@query("R7_quality", with_views("fx_pixels", f""", {QUALITY_SQL}, bl AS (SELECT image, stddev_pop(m) AS s FROM (SELECT image, y // 2, x // 2, avg(v) AS m FROM px GROUP BY ALL) GROUP BY image)
    SELECT r.image, round(avg(v), 6) AS gray_mean, round(stddev_pop(v), 6) AS gray_std, round(any_value(bl.s), 6) AS block_mean_std_4x4, round(avg((v=0 OR v=255)::INT), 6) AS saturation_ratio, round(avg((v<100)::INT), 6) AS dark_ratio,
    round(avg((v>150)::INT), 6) AS bright_ratio, round(avg(val), 6) AS hsv_v_mean, round(var_pop(lap), 4) AS laplacian_variance,
    round(sum(abs(nz)) FILTER (x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6) * sqrt(pi()/2) / (6*36), 6) AS noise_sigma FROM r JOIN bl USING (image) GROUP BY r.image"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumns({"gray": F.col("v"), "val": F.greatest("b", "g", "r")})
    out = Q.quality(p, dark=100, bright=150)
    return rounded(rounded(out, *[c for c in out.columns if c not in ("image", "laplacian_variance")]), "laplacian_variance", digits=4)


@query("R8_quality_masked", with_views("fx_pixels", f""", {QUALITY_SQL}, m AS (SELECT * FROM r WHERE v > 115 AND NOT (image % 50 = 0)), bx AS (SELECT image, min(y) AS y0, max(y)-min(y)+1 AS bh, min(x) AS x0, max(x)-min(x)+1 AS bw FROM m GROUP BY image),
    blk AS (SELECT image, CASE WHEN y-y0 < (bh%4)*(bh//4+1) THEN (y-y0)//(bh//4+1) ELSE bh%4 + (y-y0-(bh%4)*(bh//4+1))//(bh//4) END AS b_y, CASE WHEN x-x0 < (bw%4)*(bw//4+1) THEN (x-x0)//(bw//4+1) ELSE bw%4 + (x-x0-(bw%4)*(bw//4+1))//(bw//4) END AS b_x, v FROM m JOIN bx USING (image) WHERE bh >= 4 AND bw >= 4),
    bs AS (SELECT image, CASE WHEN count(*) >= 2 THEN stddev_pop(a) END AS s FROM (SELECT image, b_y, b_x, avg(v) AS a FROM blk GROUP BY ALL HAVING count(*) >= 2) GROUP BY image),
    q AS (SELECT image, avg(v) AS gm, stddev_pop(v) AS gs, avg((v<130)::INT) AS d, avg((v>150)::INT) AS b, avg((v=0 OR v=255)::INT) AS s, var_pop(lap) FILTER (v > 120) AS lv,
        sum(abs(nz)) FILTER (v > 120 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6) * sqrt(pi()/2) / (6*nullif(count(*) FILTER (v > 120 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6), 0)) AS ns FROM m GROUP BY image)
    SELECT i.image, round(gm, 6) AS gray_mean, round(gs, 6) AS gray_std, round(bs.s, 6) AS block_mean_std_4x4, round(d, 6) AS dark_ratio, round(b, 6) AS bright_ratio, round(q.s, 6) AS saturation_ratio, round(lv, 4) AS laplacian_variance, round(ns, 6) AS noise_sigma
    FROM (SELECT DISTINCT image FROM px) i LEFT JOIN q USING (image) LEFT JOIN bs USING (image)"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumns({"gray": F.col("v"), "mask": (F.col("v") > 115) & (F.col("image") % 50 != 0), "support": F.col("v") > 120})
    out = Q.quality_masked(p, support="support", dark=130, bright=150, min_block=2)
    return rounded(rounded(out, *[c for c in out.columns if c not in ("image", "laplacian_variance")]), "laplacian_variance", digits=4)


def window_sql(name, col, r, fn, table):
    return f"{name} AS (SELECT a.image, a.y, a.x, {fn}(p.{col}) AS {col} FROM {table} a JOIN {table} p ON p.image=a.image AND abs(p.x-a.x) <= {r} AND abs(p.y-a.y) <= {r} GROUP BY ALL)"


@query("R9_sharpness", with_views("fx_pixels", f""", {PX}, {conv_sql('lx', 'v', G.SECOND, ONE)}, {conv_sql('ly', 'v', ONE, G.SECOND)}, mk AS (SELECT image, y, x, (v > 105)::INT AS m FROM px), {window_sql('er', 'm', 1, 'min', 'mk')}
    SELECT image, round(CASE WHEN count(*) FILTER (m = 1) > 5 THEN var_pop(lx.s + ly.s) FILTER (m = 1) ELSE var_pop(lx.s + ly.s) END, 4) AS sharpness FROM lx JOIN ly USING (image, y, x) JOIN er USING (image, y, x) GROUP BY image"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumns({"gray": F.col("v"), "mask": F.col("v") > 105})
    return rounded(Q.sharpness(p, kernel=3, min_pixels=5), "sharpness", digits=4)


@query("R10_morphology", with_views("fx_pixels", f""", {window_sql('mn', 'v', 1, 'min', 'fx_pixels')}, {window_sql('mx', 'v', 1, 'max', 'fx_pixels')}, {window_sql('op', 'v', 1, 'max', 'mn')}, {window_sql('cl', 'v', 1, 'min', 'mx')},
    el AS (SELECT a.image, a.y, a.x, min(p.v) AS v FROM fx_pixels a JOIN fx_pixels p ON p.image=a.image AND abs(p.y-a.y) <= 2 AND ((p.y=a.y AND abs(p.x-a.x) <= 2) OR (abs(p.y-a.y) = 1 AND abs(p.x-a.x) <= 2) OR (abs(p.y-a.y) = 2 AND p.x=a.x)) GROUP BY ALL)
    SELECT mn.image, mn.y, mn.x, mn.v AS eroded, mx.v AS dilated, op.v AS opened, cl.v AS closed, cl.v - p.v AS blackhat, el.v AS ellipse FROM mn JOIN mx USING (image, y, x) JOIN op USING (image, y, x) JOIN cl USING (image, y, x) JOIN el USING (image, y, x) JOIN fx_pixels p USING (image, y, x)"""))
def _(spark, sf):
    p, k = px_of(Inputs(spark, sf)), G.rect_spans(3)
    out = G.closed(G.opened(G.dilate(G.erode(p, "v", k, "eroded"), "v", k, "dilated"), "v", k, "opened"), "v", k, "closed")
    out = G.erode(G.black_hat(out, "v", k), "v", G.ellipse_spans(5), "ellipse")
    return out.select("image", "y", "x", "eroded", "dilated", "opened", "closed", "blackhat", "ellipse")


@query("R10_bars", with_views("fx_pixels", """, h AS (SELECT a.image, a.y, a.x, min(p.v) AS v FROM fx_pixels a JOIN fx_pixels p ON p.image=a.image AND p.y=a.y AND abs(p.x-a.x) <= 1 GROUP BY ALL),
    ho AS (SELECT a.image, a.y, a.x, max(p.v) AS v FROM h a JOIN h p ON p.image=a.image AND p.y=a.y AND abs(p.x-a.x) <= 1 GROUP BY ALL), k AS (SELECT a.image, a.y, a.x, min(p.v) AS v FROM fx_pixels a JOIN fx_pixels p ON p.image=a.image AND p.x=a.x AND abs(p.y-a.y) <= 1 GROUP BY ALL),
    ko AS (SELECT a.image, a.y, a.x, max(p.v) AS v FROM k a JOIN k p ON p.image=a.image AND p.x=a.x AND abs(p.y-a.y) <= 1 GROUP BY ALL) SELECT ho.image, ho.y, ho.x, greatest(ho.v, ko.v) AS v FROM ho JOIN ko USING (image, y, x)"""))
def _(spark, sf):
    return G.bars(px_of(Inputs(spark, sf)), "v", 3, 2, "open", "bar").select("image", "y", "x", F.col("bar").alias("v"))


@query("R11_analysis_mask", with_views("fx_pixels", f""", mk AS (SELECT image, y, x, (v > 110)::INT AS m FROM fx_pixels), {window_sql('er', 'm', 1, 'min', 'mk')}, g AS (SELECT image, count(*) FILTER (er.m = 1) AS pixels, count(*) FILTER (mk.m = 1) AS road_pixels FROM mk JOIN er USING (image, y, x) GROUP BY image)
    SELECT image, pixels, road_pixels, round(pixels/road_pixels, 6) AS ratio_of_road, pixels >= 6 AND pixels/road_pixels >= 0.3 AS sufficient FROM g"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("mask", F.col("v") > 110)
    return Q.analysis_info(Q.analysis_mask(p, kernel=3), min_pixels=6)


@query("R12_gamma", with_views("fx_pixels", "SELECT image, y, x, CASE WHEN v > 100 THEN round_even(pow(v/255.0e0, 0.8e0)*255, 0) ELSE v END AS v FROM fx_pixels"))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("mask", F.col("v") > 100)
    return G.gamma(p, ["v"], 0.8, "mask").select("image", "y", "x", "v")


GSTEP = [0.9, 0.8, 0.7]


@query("R12_choose_gamma", with_views("fx_pixels", f""", c AS (SELECT image, g, avg(o) AS m, avg((o < 40)::INT) AS d, avg((o = 0 OR o = 255)::INT) AS s, avg((v = 0 OR v = 255)::INT) AS s0 FROM (SELECT image, v, g, round_even(pow(v/255.0e0, g)*255, 0) AS o FROM fx_pixels CROSS JOIN (SELECT unnest([0.9e0, 0.8e0, 0.7e0]) AS g) WHERE x < 6) GROUP BY ALL),
    f AS (SELECT *, m >= 140 AND d <= 0.07 AS ok, s > 0.02 AND s > s0 AS guard FROM c), o AS (SELECT image, max(g) FILTER (guard) AS stop FROM f GROUP BY image), l AS (SELECT f.* FROM f JOIN o USING (image) WHERE stop IS NULL OR g > stop)
    SELECT image, coalesce(max(g) FILTER (ok), min(g)) AS gamma FROM l GROUP BY image"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumns({"gray": F.col("v"), "mask": F.col("x") < 6})
    return Q.choose_gamma(p, rule=GammaRule(gray_mean_below=140.0))


K3 = G.gaussian_kernel(0.8, 1)


@query("R13_masked_gaussian", with_views("fx_pixels", f""", {PX}, mm AS (SELECT image, y, x, v, (v > 110)::INT * 1.0e0 AS m, CASE WHEN v > 110 THEN v ELSE 0 END AS vm FROM px), {conv_sql('cm', 'm', K3, K3, 'mm')}, {conv_sql('cv', 'vm', K3, K3, 'mm')}
    SELECT image, y, x, CASE WHEN mm.m = 1 THEN least(255, greatest(0, round_even(cv.s/greatest(cm.s, 1e-6), 0))) ELSE v END AS v FROM mm JOIN cm USING (image, y, x) JOIN cv USING (image, y, x)"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("mask", F.col("v") > 110)
    return G.masked_gaussian(p, ["v"], "mask", 3, 0.8).select("image", "y", "x", "v")


@query("R13_unsharp", with_views("fx_pixels", f", {PX}, {conv_sql('m', 'v', GK, GK)} SELECT image, y, x, least(255, greatest(0, round_even(px.v + 0.7e0*(px.v - m.s), 0))) AS v FROM px JOIN m USING (image, y, x)"))
def _(spark, sf):
    return G.unsharp(px_of(Inputs(spark, sf)), ["v"], 0.7, 1.0, 3).select("image", "y", "x", "v")


@query("R13_equalize_tiles")
def _(spark, sf):
    return G.equalize_tiles(px_of(Inputs(spark, sf)), "v", 2.0, 2).select("image", "y", "x", "v")


COMP = """on_ AS (SELECT image, y, x, y*4294967296+x AS id FROM fx_pixels WHERE {cond}),
    nb AS (SELECT a.image, a.id AS u, b.id AS v FROM on_ a JOIN on_ b ON a.image=b.image AND {near}),
    reach AS (SELECT image, id AS node, id AS src FROM on_ UNION SELECT r.image, nb.v, r.src FROM reach r JOIN nb ON nb.image=r.image AND nb.u=r.node WHERE nb.v > r.src),
    low AS (SELECT image, node, min(src) AS label FROM reach GROUP BY ALL),
    lab AS (SELECT o.image, o.y, o.x, low.label FROM on_ o JOIN low ON low.image=o.image AND low.node=o.id)"""
NEAR8, NEAR4 = "abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1", "abs(a.y-b.y) + abs(a.x-b.x) <= 1"


@query("R14_components", with_views("fx_pixels", f", {COMP.format(cond='v > 130', near=NEAR8)} SELECT * FROM lab", recursive=True))
def _(spark, sf):
    return CC.components(px_of(Inputs(spark, sf)).filter(F.col("v") > LIMIT))


@query("R14_components_4", with_views("fx_pixels", f", {COMP.format(cond='v > 130', near=NEAR4)} SELECT * FROM lab", recursive=True))
def _(spark, sf):
    return CC.components(px_of(Inputs(spark, sf)).filter(F.col("v") > LIMIT), 4)


@query("R15_fill_holes", with_views("fx_pixels", f""", {COMP.format(cond='v <= 115', near=NEAR4)}, s AS (SELECT image, label, count(*) AS n, bool_or(x IN (0, 7) OR y IN (0, 7)) AS open FROM lab GROUP BY ALL),
    f AS (SELECT image, y, x FROM lab JOIN s USING (image, label) WHERE NOT open AND n <= 0.05*64) SELECT p.image, p.y, p.x, p.v > 115 OR f.x IS NOT NULL AS mask FROM fx_pixels p LEFT JOIN f ON f.image=p.image AND f.y=p.y AND f.x=p.x""", recursive=True))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("mask", F.col("v") > 115)
    return CC.fill_holes(p, max_ratio=0.05).select("image", "y", "x", "mask")


@query("R15_drop_small", with_views("fx_pixels", f""", {COMP.format(cond='v > 130', near=NEAR8)}, s AS (SELECT image, label FROM lab GROUP BY ALL HAVING count(*) >= 0.1*64)
    SELECT p.image, p.y, p.x, l.x IS NOT NULL AS mask FROM fx_pixels p LEFT JOIN (SELECT lab.* FROM lab JOIN s USING (image, label)) l ON l.image=p.image AND l.y=p.y AND l.x=p.x""", recursive=True))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("mask", F.col("v") > LIMIT)
    return CC.drop_small(p, min_ratio=0.1).select("image", "y", "x", "mask")


METRICS_SQL = f"""{COMP.format(cond='v > 118', near=NEAR8)}, bg AS (SELECT image, y, x, y*4294967296+x AS id FROM fx_pixels WHERE v <= 118), bn AS (SELECT a.image, a.id AS u, b.id AS v FROM bg a JOIN bg b ON a.image=b.image AND {NEAR4}),
    br AS (SELECT image, id AS node, id AS src FROM bg UNION SELECT r.image, bn.v, r.src FROM br r JOIN bn ON bn.image=r.image AND bn.u=r.node WHERE bn.v > r.src), bl AS (SELECT image, node, min(src) AS label FROM br GROUP BY ALL),
    hs AS (SELECT image, sum(n) AS h FROM (SELECT b.image, l.label, count(*) AS n FROM bg b JOIN bl l ON l.image=b.image AND l.node=b.id GROUP BY ALL HAVING NOT bool_or(x IN (0, 7) OR y IN (0, 7))) GROUP BY image),
    sz AS (SELECT image, max(n) AS mx, count(*) AS k FROM (SELECT image, label, count(*) AS n FROM lab GROUP BY ALL) GROUP BY image), b AS (SELECT image, count(*) FILTER (v > 118) AS road, count(*) FILTER (v > 118 AND ((x=2 AND y=3) OR (x=5 AND y=6))) AS hit FROM fx_pixels GROUP BY image),
    met AS (SELECT b.image, road AS road_pixels, coalesce(k, 0) AS n_components, 2 AS n_seeds, road/64 AS mask_area_ratio, CASE WHEN road > 0 THEN mx/road END AS largest_component_ratio, CASE WHEN road > 0 THEN coalesce(h, 0)/(road+coalesce(h, 0)) END AS hole_ratio, hit/2 AS seed_consistency FROM b LEFT JOIN sz USING (image) LEFT JOIN hs USING (image))"""


def metrics_of(i: Inputs):
    p = px_of(i).withColumn("mask", F.col("v") > 118)
    at = F.inline(F.array(F.struct(F.lit(2.0).alias("x"), F.lit(3.0).alias("y")), F.struct(F.lit(5.0).alias("x"), F.lit(6.0).alias("y"))))
    return CC.mask_metrics(p, seeds=p.select("image").distinct().select("image", at))


@query("R16_mask_metrics", with_views("fx_pixels", f""", {METRICS_SQL} SELECT image, road_pixels, n_components, CAST(n_seeds AS BIGINT) AS n_seeds, round(mask_area_ratio, 6) AS mask_area_ratio, round(largest_component_ratio, 6) AS largest_component_ratio,
    round(hole_ratio, 6) AS hole_ratio, round(seed_consistency, 6) AS seed_consistency FROM met""", recursive=True))
def _(spark, sf):
    return rounded(metrics_of(Inputs(spark, sf)), "mask_area_ratio", "largest_component_ratio", "hole_ratio", "seed_consistency")


@query("R16_validate_mask", with_views("fx_pixels", f""", {METRICS_SQL}, w AS (SELECT image, concat_ws(';', CASE WHEN road_pixels = 0 THEN 'empty_mask' END, CASE WHEN mask_area_ratio < 0.6 THEN 'mask_area_ratio<0.6 (' || printf('%.4f', mask_area_ratio) || ')' END,
    CASE WHEN largest_component_ratio IS NULL THEN 'largest_component_ratio:undefined' END, CASE WHEN largest_component_ratio < 0.8 THEN 'largest_component_ratio<0.8 (' || printf('%.4f', largest_component_ratio) || ')' END,
    CASE WHEN hole_ratio IS NULL THEN 'hole_ratio:undefined' END, CASE WHEN hole_ratio > 0.05 THEN 'hole_ratio>0.05 (' || printf('%.4f', hole_ratio) || ')' END, CASE WHEN seed_consistency < 0.6 THEN 'seed_consistency<0.6 (' || printf('%.4f', seed_consistency) || ')' END) AS r FROM met)
    SELECT image, r AS fail_reasons, CASE WHEN r = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM w""", recursive=True))
def _(spark, sf):
    out = CC.validate_mask(metrics_of(Inputs(spark, sf)), MaskRules(mask_area_ratio_min=0.6, hole_ratio_max=0.05))
    return out.select("image", F.array_join("fail_reasons", ";").alias("fail_reasons"), "status")


CP = CE.FeatureParams(cell_size=3, edge_threshold=20.0)


def cell_maps(i: Inputs):
    """Map columns read straight from the channels, so that cells can be checked apart from the filters."""
    return px_of(i).selectExpr("image", "y", "x", "w", "h", "b / 3 AS L", "g / 8 - 16 AS a", "r / 8 - 16 AS bb", "g / 9 AS texture", "r / 8 AS gradient")


CELLS_SQL = f"""{PX}, mp AS (SELECT image, y, x, b/3 AS "L", g/8-16 AS a, r/8-16 AS bb, g/9 AS texture, r/8 AS gradient FROM px),
    ce AS (SELECT image, y // 3 AS "row", x // 3 AS col, avg("L") AS ml, avg(a) AS ma, avg(bb) AS mb, stddev_pop("L") AS sl, stddev_pop(a) AS sa, stddev_pop(bb) AS sb, avg(texture) AS texture, avg(gradient) AS grad_mean, avg((gradient > 20)::INT) AS edge_density, count(*)/9 AS fill FROM mp GROUP BY ALL),
    cd AS (SELECT *, (col*3 + least((col+1)*3, 8) - 1)/2 AS px, ("row"*3 + least(("row"+1)*3, 8) - 1)/2 AS py, sqrt(ma*ma + mb*mb) AS chroma FROM ce),
    nd AS (SELECT a.image, a."row", a.col, avg(sqrt(pow(0.35e0*(a.ml-b.ml), 2) + pow(a.ma-b.ma, 2) + pow(a.mb-b.mb, 2))) AS nd FROM cd a JOIN cd b ON a.image=b.image AND abs(a."row"-b."row") <= 1 AND abs(a.col-b.col) <= 1 AND (a."row" <> b."row" OR a.col <> b.col) GROUP BY ALL)"""


@query("R17_cell_features", with_views("fx_pixels", f""", {CELLS_SQL} SELECT image, "row", col, round(ml, 6) AS "mean_L", round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(sl, 6) AS "std_L", round(sa, 6) AS std_a, round(sb, 6) AS std_b, round(texture, 6) AS texture, round(grad_mean, 6) AS grad_mean,
    round(edge_density, 6) AS edge_density, round(fill, 6) AS fill, round(px/7, 6) AS cx, round(py/7, 6) AS cy, round(chroma, 6) AS chroma, round(nd, 6) AS neighbor_dist FROM cd JOIN nd USING (image, "row", col)"""))
def _(spark, sf):
    out = CE.cell_features(cell_maps(Inputs(spark, sf)), CP).drop("w", "h", "x", "y")
    return rounded(out, *[c for c in out.columns if c not in ("image", "row", "col")])


@query("R18_neighbor_mean", with_views("fx_cells", """SELECT a.image, a.r, a.c, round(avg(abs(a.mean_v - b.mean_v)), 6) AS gap FROM fx_cells a JOIN fx_cells b ON a.image=b.image AND abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY ALL"""))
def _(spark, sf):
    cells = Inputs(spark, sf).cells
    return rounded(CE.neighbor_mean(cells, F.abs(F.col("mean_v") - F.col("o_mean_v")), "gap", ["mean_v"], "r", "c"), "gap")


SCORE_SQL = f"""{CELLS_SQL}, c1 AS (SELECT *, greatest(pow(py/7, 0.5e0)*(1 - 0.3e0*abs(2*px/7 - 1)), 1e-6) AS k1, greatest(exp(-pow(chroma/18, 2)), 1e-6) AS k2, greatest(exp(-edge_density/0.2e0), 1e-6) AS k3,
    greatest(CASE WHEN texture < 2 THEN pow(least(greatest(texture/2, 0), 1), 2) WHEN texture > 20 THEN least(20/texture, 1) ELSE 1 END, 1e-6) AS k4, greatest(least(greatest(1 - greatest(10-ml, 0)/15 - greatest(ml-45, 0)/15, 0), 1), 1e-6) AS k5 FROM cd),
    c2 AS (SELECT *, exp((ln(k1)+ln(k2)+ln(k3)+ln(k4)+ln(k5))/5) AS pre FROM c1),
    ns AS (SELECT a.image, a."row", a.col, avg(exp(-sqrt(pow(0.35e0*(a.ml-b.ml), 2) + pow(a.ma-b.ma, 2) + pow(a.mb-b.mb, 2))/6)*b.pre) AS k6 FROM c2 a JOIN c2 b ON a.image=b.image AND abs(a."row"-b."row") <= 1 AND abs(a.col-b.col) <= 1 AND (a."row" <> b."row" OR a.col <> b.col) GROUP BY ALL),
    sc AS (SELECT c2.*, exp((ln(k1)+ln(k2)+ln(k3)+ln(k4)+ln(k5)+1.5e0*ln(greatest(k6, 1e-6)))/6.5e0) AS score FROM c2 JOIN ns USING (image, "row", col))"""
SP = CE.SeedParams(texture_range=(2.0, 20.0), brightness_range=(10.0, 45.0), min_score=0.2, min_distance_cells=2, max_chroma_distance_to_best=8.0, max_texture_ratio_to_best=1.6)


@query("R19_score_cells", with_views("fx_pixels", f', {SCORE_SQL} SELECT image, "row", col, round(score, 6) AS score FROM sc'))
def _(spark, sf):
    s = CE.score_cells(CE.cell_features(cell_maps(Inputs(spark, sf)), CP), SP)
    return rounded(s.select("image", "row", "col", "score"), "score")


@query("R20_select_seeds", with_views("fx_pixels", f""", {SCORE_SQL}, el AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, "row", col) AS rn FROM sc WHERE fill >= 0.5 AND score >= 0.2),
    one AS (SELECT image, "row" AS r1, col AS c1, ma AS a1, mb AS b1, ml AS l1, texture AS t1 FROM el WHERE rn = 1),
    okc AS (SELECT e.* FROM el e JOIN one o USING (image) WHERE rn = 1 OR (sqrt(pow(ma-a1, 2)+pow(mb-b1, 2)) <= 8 AND ml-l1 <= 25 AND l1-ml <= 50 AND greatest(greatest(texture,1e-6)/greatest(t1,1e-6), greatest(t1,1e-6)/greatest(texture,1e-6)) <= 1.6)),
    q AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY rn) AS k FROM okc),
    walk AS (SELECT image, k, [{{'r': "row", 'c': col}}] AS s FROM q WHERE k = 1 UNION ALL SELECT q.image, q.k, CASE WHEN len(w.s) >= 5 OR len(list_filter(w.s, lambda z: greatest(abs(z.r - q."row"), abs(z.c - q.col)) < 2)) > 0 THEN w.s ELSE list_append(w.s, {{'r': q."row", 'c': q.col}}) END
        FROM walk w JOIN q ON q.image=w.image AND q.k=w.k+1), fin AS (SELECT image, s FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY k DESC) AS z FROM walk) WHERE z = 1)
    SELECT image, CAST(i-1 AS INTEGER) AS "rank", s[i].r AS "row", s[i].c AS col FROM fin, LATERAL (SELECT unnest(range(1, len(s)+1)) AS i)""", recursive=True))
def _(spark, sf):
    s = CE.score_cells(CE.cell_features(cell_maps(Inputs(spark, sf)), CP), SP)
    return CE.select_seeds(s, SP).select("image", "rank", "row", "col")


@query("R21_grow_regions")
def _(spark, sf):
    maps = cell_maps(Inputs(spark, sf))
    seeds = CE.select_seeds(CE.score_cells(CE.cell_features(maps, CP), SP), SP)
    return CE.grow_regions(maps, seeds, CE.GrowParams(color_threshold=14.0, max_color_threshold=20.0, max_gradient=None), CP)


@query("R22_road_top")
def _(spark, sf):
    return CE.road_top(px_of(Inputs(spark, sf)), texture_sigma=0.5)


LS = {s: G.gaussian_kernel(s, 2) for s in (0.8, 1.2)}
LINE_SQL = ", ".join([PX] + [
    f"{conv_sql(f'xx{n}', 'v', G.convolved(k, G.SECOND), G.convolved(k, G.SMOOTH))}, {conv_sql(f'yy{n}', 'v', G.convolved(k, G.SMOOTH), G.convolved(k, G.SECOND))}, {conv_sql(f'xy{n}', 'v', G.convolved(k, G.DIFF), G.convolved(k, G.DIFF))}"
    for n, k in enumerate(LS.values())
] + [
    f"sc{n} AS (SELECT a.image, a.y, a.x, greatest((a.s+b.s+sqrt(pow(a.s-b.s,2)+4*c.s*c.s))/2 - abs((a.s+b.s-sqrt(pow(a.s-b.s,2)+4*c.s*c.s))/2), 0)*{s}e0*{s}e0 AS s, atan2(2*c.s, a.s-b.s)/2 AS a FROM xx{n} a JOIN yy{n} b USING (image, y, x) JOIN xy{n} c USING (image, y, x))"
    for n, s in enumerate(LS)
] + ["line AS (SELECT p.image, p.y, p.x, greatest(p.s, q.s) AS score, CASE WHEN p.s >= q.s THEN p.a ELSE q.a END AS angle, (p.s+q.s)/2 AS mean FROM sc0 p JOIN sc1 q USING (image, y, x))"])


def line_of(i: Inputs, combine="max"):
    return LI.line_score(px_of(i), "v", tuple(LS), combine, 2)


@query("R23_line_score", with_views("fx_pixels", f", {LINE_SQL} SELECT image, y, x, round(score, 4) AS score, round(mean, 4) AS mean FROM line"))
def _(spark, sf):
    i = Inputs(spark, sf)
    mean = line_of(i, "mean").select("image", "y", "x", F.round("score", 4).alias("mean"))
    return line_of(i).select("image", "y", "x", F.round("score", 4).alias("score")).join(mean, G.KEY)


CENTER_SQL = """qd AS (SELECT *, CAST(((round_even(angle/(pi()/4), 0) % 4) + 4) % 4 AS INTEGER) AS q FROM line),
    ctr AS (SELECT c.image, c.y, c.x, c.score, CASE WHEN c.score > 0 AND c.score >= coalesce(max(n.score), 0) THEN c.score ELSE 0 END AS center FROM qd c LEFT JOIN qd n ON n.image=c.image AND
    ((c.q=0 AND n.y=c.y AND abs(n.x-c.x)=1) OR (c.q=1 AND abs(n.x-c.x)=1 AND n.x-c.x=n.y-c.y) OR (c.q=2 AND n.x=c.x AND abs(n.y-c.y)=1) OR (c.q=3 AND abs(n.x-c.x)=1 AND n.x-c.x=c.y-n.y)) GROUP BY c.image, c.y, c.x, c.score)"""


@query("R24_centerline", with_views("fx_pixels", """, sq AS (SELECT image, y, x, v AS score, (x*3 + y*5 + image) % 4 * pi() / 4 AS angle FROM fx_pixels), line AS (SELECT * FROM sq), """ + CENTER_SQL + " SELECT image, y, x, center FROM ctr"))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).selectExpr("*", "v AS score", "(x*3 + y*5 + image) % 4 * pi() / 4 AS angle")
    return LI.centerline(p).select("image", "y", "x", "center")


@query("R25_hysteresis", with_views("fx_pixels", f""", hl AS (SELECT image, greatest(quantile_cont(v, 0.9), 20) AS hi FROM fx_pixels GROUP BY image),
    {COMP.format(cond='v >= (SELECT hi FROM hl WHERE hl.image=fx_pixels.image)*0.92e0', near=NEAR8)}, k AS (SELECT l.image, l.label FROM lab l JOIN fx_pixels p USING (image, y, x) JOIN hl USING (image) GROUP BY l.image, l.label HAVING bool_or(p.v >= hi)) SELECT lab.* FROM lab JOIN k USING (image, label)""", recursive=True))
def _(spark, sf):
    return CC.hysteresis_at_percentile(px_of(Inputs(spark, sf)), "v", 90.0, 0.92).select("image", "y", "x", "label")


LEVELED = COMP.format(cond="v >= lv*0.9e0", near=NEAR8).replace("image, y, x, y*", "image, lv AS level, y, x, y*").replace("FROM fx_pixels WHERE", "FROM fx_pixels CROSS JOIN (SELECT unnest([140.0e0, 155.0e0]) AS lv) WHERE")
LEVELED = (LEVELED.replace("SELECT a.image, a.id", "SELECT a.image, a.level, a.id").replace("a.image=b.image AND", "a.image=b.image AND a.level=b.level AND").replace("SELECT image, id AS node", "SELECT image, level, id AS node")
           .replace("SELECT r.image, nb.v", "SELECT r.image, r.level, nb.v").replace("nb.image=r.image AND", "nb.image=r.image AND nb.level=r.level AND").replace("SELECT image, node, min", "SELECT image, level, node, min")
           .replace("SELECT o.image, o.y", "SELECT o.image, o.level, o.y").replace("low.image=o.image AND", "low.image=o.image AND low.level=o.level AND"))


@query("R25_hysteresis_levels", with_views("fx_pixels", f""", {LEVELED}, k AS (SELECT l.image, l.level, l.label FROM lab l JOIN fx_pixels p USING (image, y, x) GROUP BY l.image, l.level, l.label HAVING bool_or(p.v >= l.level))
    SELECT lab.image, lab.level, lab.y, lab.x, lab.label FROM lab JOIN k USING (image, level, label)""", recursive=True))
def _(spark, sf):
    return CC.hysteresis_levels(px_of(Inputs(spark, sf)), "v", [140.0, 155.0], 0.9).select("image", "level", "y", "x", "label")


@query("R26_edge_count")
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("mask", F.col("x") < 6)
    return LI.edge_count(p, "v", mask="mask")


@query("R27_adaptive_threshold", with_views("fx_pixels", """, m AS (SELECT a.image, a.y, a.x, a.v, sum(p.v)/9 AS m FROM fx_pixels a CROSS JOIN range(-1, 2) dy(i) CROSS JOIN range(-1, 2) dx(i) JOIN fx_pixels p ON p.image=a.image
    AND p.x=least(greatest(a.x+dx.i, 0), 7) AND p.y=least(greatest(a.y+dy.i, 0), 7) GROUP BY ALL) SELECT image, y, x, v <= round_even(round(m, 9), 0) - 5 AS "on" FROM m"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf))
    return LI.adaptive_threshold(p, "v", 3, 5.0, inverse=True).select("image", "y", "x", "on")


T3 = [1 / 3] * 3


@query("R28_guided_filter", with_views("fx_pixels", f""", {PX}, sq AS (SELECT image, y, x, v, v*v AS vv FROM px), ep AS (SELECT image, stddev_pop(v) AS e FROM px GROUP BY image), {conv_sql('m1', 'v', T3, T3)}, {conv_sql('m2', 'vv', T3, T3, 'sq')},
    ab AS (SELECT image, y, x, (m2.s-m1.s*m1.s)/(m2.s-m1.s*m1.s+e) AS a, m1.s*(1-(m2.s-m1.s*m1.s)/(m2.s-m1.s*m1.s+e)) AS b FROM m1 JOIN m2 USING (image, y, x) JOIN ep USING (image)), {conv_sql('ma', 'a', T3, T3, 'ab')}, {conv_sql('mb', 'b', T3, T3, 'ab')}
    SELECT image, y, x, round(ma.s*px.v + mb.s, 5) AS guided FROM px JOIN ma USING (image, y, x) JOIN mb USING (image, y, x)"""))
def _(spark, sf):
    return rounded(LI.guided_filter(px_of(Inputs(spark, sf)), "v", 1).select("image", "y", "x", "guided"), "guided", digits=5)


def labelled_of(i: Inputs):
    return CC.components(px_of(i).filter(F.col("v") > LIMIT))


@query("R29_shape_features", with_views("fx_pixels", f""", {COMP.format(cond='v > 130', near=NEAR8)}, ax AS (SELECT image, label, atan2(2*covar_pop(x, y), var_pop(x)-var_pop(y))/2 AS t FROM lab GROUP BY ALL),
    e AS (SELECT image, label, min(x) AS x, min(y) AS y, max(x)-min(x)+1 AS w, max(y)-min(y)+1 AS h, count(*)*1.0e0 AS area, max(x*cos(t)+y*sin(t))-min(x*cos(t)+y*sin(t))+1 AS p, max(y*cos(t)-x*sin(t))-min(y*cos(t)-x*sin(t))+1 AS q FROM lab JOIN ax USING (image, label) GROUP BY ALL)
    SELECT image, label, x, y, w, h, area FROM e""", recursive=True))
def _(spark, sf):
    return CC.shape_features(labelled_of(Inputs(spark, sf))).select("image", "label", "x", "y", "w", "h", "area")


@query("R30_line_residual", with_views("fx_pixels", f""", {COMP.format(cond='v > 130', near=NEAR8)}, c AS (SELECT image, label, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM lab GROUP BY ALL)
    SELECT image, label, round(sqrt(greatest((a+b-sqrt((a-b)*(a-b)+4*c*c))/2, 0)), 5) AS resid FROM c""", recursive=True))
def _(spark, sf):
    return rounded(CC.line_residual(labelled_of(Inputs(spark, sf))), "resid", digits=5)


@query("R31_valley_score")
def _(spark, sf):
    i = Inputs(spark, sf)
    dark = CC.components(px_of(i).filter("v < 115"))
    widths = CC.shape_features(dark).select("image", "label", "width")
    return LI.valley_score(px_of(i), dark, widths, "v", gap=1.0, radius=3)


def raster_boxes(i: Inputs):
    """Two boxes per raster."""
    return framed(i.pixels.select("image").distinct().selectExpr(
        "image", "inline(array(struct(1L AS did, 1.0D AS x1, 1.0D AS y1, 5.0D AS x2, 6.0D AS y2), struct(2L AS did, 3.0D AS x1, 2.0D AS y1, 8.0D AS x2, 7.0D AS y2)))",
    ))


BOXES_SQL = "bx AS (SELECT image, did, x1, y1, x2, y2 FROM (SELECT DISTINCT image FROM fx_pixels) CROSS JOIN (VALUES (1, 1.0e0, 1.0e0, 5.0e0, 6.0e0), (2, 3.0e0, 2.0e0, 8.0e0, 7.0e0)) t(did, x1, y1, x2, y2))"


def coloured(i: Inputs):
    return px_of(i).withColumn("gray", F.col("v"))


@query("R32_ring_cues")
def _(spark, sf):
    i = Inputs(spark, sf)
    maps = CU.cue_maps(coloured(i), sigma=1.0, radius=3)
    return CU.ring_cues(maps, raster_boxes(i), CU.reference_stats(maps), min_ring=5)


@query("R33_onroad_cues")
def _(spark, sf):
    i = Inputs(spark, sf)
    maps = LI.line_score(CU.structure_tensor(coloured(i).withColumn("smooth", F.col("v")), sigma=1.0, radius=3), "v", (0.8,), radius=2)
    points = CU.box_pixels(maps, raster_boxes(i), []).filter("x = y OR x = y + 1")
    return CU.onroad_cues(maps, points, raster_boxes(i))


@query("R34_structure_tensor", with_views("fx_pixels", f""", {PX}, {conv_sql('gx', 'v', G.DIFF, G.SMOOTH)}, {conv_sql('gy', 'v', G.SMOOTH, G.DIFF)}, pr AS (SELECT image, y, x, gx.s*gx.s AS a, gx.s*gy.s AS b, gy.s*gy.s AS c FROM gx JOIN gy USING (image, y, x)),
    {conv_sql('ta', 'a', GK, GK, 'pr')}, {conv_sql('tb', 'b', GK, GK, 'pr')}, {conv_sql('tc', 'c', GK, GK, 'pr')}, st AS (SELECT image, y, x, ta.s AS a, tb.s AS b, tc.s AS c, sqrt((ta.s-tc.s)*(ta.s-tc.s) + 4*tb.s*tb.s) AS root FROM ta JOIN tb USING (image, y, x) JOIN tc USING (image, y, x)),
    ev AS (SELECT *, (a+c+root)/2 AS l1, greatest((a+c-root)/2, 0) AS l2 FROM st)
    SELECT image, y, x, round(a, 3) AS ta, round(b, 3) AS tb, round(c, 3) AS tc, round(l1 + l2, 3) AS energy, round(l2, 3) AS l2,
        round(CASE WHEN l1 + l2 > 1e-6 THEN ((l1-l2)/(l1+l2)) * ((l1-l2)/(l1+l2)) ELSE 0 END, 5) AS coherence FROM ev"""))
def _(spark, sf):
    t = CU.structure_tensor(coloured(Inputs(spark, sf)), sigma=1.0, radius=3)
    t = rounded(t.select("image", "y", "x", "ta", "tb", "tc", "energy", "coherence", "l2"), "ta", "tb", "tc", "energy", "l2", digits=3)
    return rounded(t, "coherence", digits=5)


@query("R35_row_robust_z", with_views("fx_pixels", f""", md AS (SELECT image, y, median(v) AS m FROM fx_pixels GROUP BY ALL), ma AS (SELECT image, y, any_value(m) AS m, median(abs(v-m))*1.4826e0+1e-3 AS s FROM fx_pixels JOIN md USING (image, y) GROUP BY ALL),
    sm AS (SELECT a.image, a.y, avg(p.m) AS m, avg(p.s) AS s FROM ma a CROSS JOIN range(-1, 2) t(k) JOIN ma p ON p.image=a.image AND p.y={refl('k', 'a.y')} GROUP BY ALL) SELECT image, y, x, round((v-sm.m)/sm.s, 5) AS z FROM fx_pixels JOIN sm USING (image, y)"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("rough", F.col("v"))
    return rounded(CU.row_robust_z(p, band=3).select("image", "y", "x", "z"), "z", digits=5)


@query("R36_ring_ratio", with_views("fx_pixels", """, m AS (SELECT image, y, x, v, (v > 110)::INT AS m FROM fx_pixels), s AS (SELECT a.image, a.y, a.x, a.v, a.m, sum(p.v*p.m) FILTER (abs(p.x-a.x) > 1 OR abs(p.y-a.y) > 1) AS e, sum(p.m) FILTER (abs(p.x-a.x) > 1 OR abs(p.y-a.y) > 1) AS n
    FROM m a JOIN m p ON p.image=a.image AND abs(p.x-a.x) <= 2 AND abs(p.y-a.y) <= 2 GROUP BY ALL) SELECT image, y, x, round(CASE WHEN n >= 0.3*16 THEN v/(e/greatest(n, 1)+1e-3) ELSE 0 END * m, 6) AS ratio FROM s"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumns({"rough": F.col("v"), "mask": F.col("v") > 110})
    return rounded(CU.ring_ratio(p, mask="mask", rings=((3, 5),)).select("image", "y", "x", "ratio"), "ratio")


@query("R37_rough_candidates")
def _(spark, sf):
    p = coloured(Inputs(spark, sf))
    cands = CU.rough_candidates(p, F.col("v") > 105, 0.05, 0.9, 3)
    return CU.box_cues(G.gradient_magnitude(p, "gray"), cands)


@query("R38_percolate")
def _(spark, sf):
    i = Inputs(spark, sf)
    points = CU.box_pixels(px_of(i), raster_boxes(i), []).filter("x = y")
    return CU.percolate(coloured(i), points, raster_boxes(i))


@query("R39_box_contrast", with_views("fx_pixels", f""", {BOXES_SQL}, i AS (SELECT b.image, did, quantile_cont(v, 0.05) AS p5, median(v) AS m FROM bx b JOIN fx_pixels p ON p.image=b.image AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY ALL),
    o AS (SELECT b.image, did, median(v) AS r FROM bx b JOIN fx_pixels p ON p.image=b.image AND NOT (x >= x1 AND x < x2 AND y >= y1 AND y < y2) GROUP BY ALL HAVING count(*) >= 20) SELECT image, CAST(did AS BIGINT) AS did, round(p5-r, 6) AS dark, m-r AS median, r AS ref FROM i JOIN o USING (image, did)"""))
def _(spark, sf):
    i = Inputs(spark, sf)
    return rounded(CU.box_contrast(coloured(i), raster_boxes(i).drop("w", "h")), "dark")


@query("R41_candidate_context")
def _(spark, sf):
    i = Inputs(spark, sf)
    p = px_of(i).withColumns(CO.hsv()).withColumn("paint", CO.paint()).withColumns({"road": F.col("v") > 110, "trace": F.col("v") > 140})
    points = CU.box_pixels(p, raster_boxes(i), []).filter("x = y OR x = y + 1")
    return CU.candidate_context(p, points, raster_boxes(i))


@query("R42_masked_write_check", with_views("fx_pixels", "SELECT image, count(*) FILTER (v <= 100 AND x = 7) AS violations FROM fx_pixels GROUP BY image"))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("mask", F.col("v") > 100)
    after = p.withColumn("v", F.when(F.col("mask") | (F.col("x") == 7), F.col("v") + 1).otherwise(F.col("v")))
    return G.masked_write_check(p, after, "mask", ["v"])


@query("R43_final_mask", with_views("fx_pixels", """, hand AS (SELECT image, y, x FROM fx_pixels WHERE image % 5 = 0 AND x < 3), vd AS (SELECT DISTINCT image, CASE WHEN image % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM fx_pixels),
    pl AS (SELECT p.image, CASE WHEN p.image % 5 = 0 THEN 'manual' WHEN p.image % 3 = 0 THEN 'auto' WHEN bool_or(v > 150) THEN 'auto_candidate_unverified' ELSE 'skipped_manual_required' END AS source FROM fx_pixels p GROUP BY p.image)
    SELECT p.image, p.y, p.x, source, CASE source WHEN 'manual' THEN p.x < 3 WHEN 'skipped_manual_required' THEN false ELSE v > 150 END AS mask FROM fx_pixels p JOIN pl USING (image)"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("mask", F.col("v") > 150)
    verdicts = p.select("image").distinct().selectExpr("image", "CASE WHEN image % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS status")
    return CC.final_mask(p, p.filter("image % 5 = 0 AND x < 3").select("image", "y", "x"), verdicts).select("image", "y", "x", "source", "mask")


@query("R44_polygon_mask", with_views("fx_pixels", "SELECT image, y, x, x >= 1 AND x <= 5 AND y >= 2 AND y <= 6 AND x - 1 <= (y - 2) AS drawn, v > 130 OR (x >= 1 AND x <= 5 AND y >= 2 AND y <= 6 AND x - 1 <= (y - 2)) AS added FROM fx_pixels"))
def _(spark, sf):
    p = px_of(Inputs(spark, sf)).withColumn("mask", F.col("v") > LIMIT)
    corners = F.inline(F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for n, (x, y) in enumerate([(1, 2), (5, 6), (1, 6)])]))
    poly = CC.polygon_mask(p.select("image", "w", "h").distinct(), p.select("image").distinct().select("image", corners))
    drawn = CC.combine_masks(p.select("image", "y", "x", "mask"), poly, "replace").withColumnRenamed("mask", "drawn")
    return drawn.join(CC.combine_masks(p.select("image", "y", "x", "mask"), poly, "add").withColumnRenamed("mask", "added"), G.KEY)


@query("R45_piece_endpoints")
def _(spark, sf):
    i = Inputs(spark, sf)
    center = LI.centerline(line_of(i)).filter("center > 0")
    trace = CC.components(center)
    return CC.piece_endpoints(trace, min_pixels=3)


@query("B6_mask_bbox", with_views("fx_pixels", """, b AS (SELECT image, greatest(0, min(x)-1) AS x, greatest(0, min(y)-1) AS y, least(8, max(x)+2) AS x9, least(8, max(y)+2) AS y9 FROM fx_pixels WHERE v > 150 GROUP BY image) SELECT image, x, y, x9-x AS w, y9-y AS h FROM b"""))
def _(spark, sf):
    p = px_of(Inputs(spark, sf))
    frame = p.select("image", F.col("w").alias("width"), F.col("h").alias("height")).distinct()
    return GE.mask_bbox(p.filter("v > 150"), frame, 1)


def overlap_of(i: Inputs):
    p = px_of(i)
    frame = p.select("image", F.col("w").alias("width"), F.col("h").alias("height")).distinct()
    det = raster_boxes(i).selectExpr("image", "did", "CASE WHEN did = 1 THEN 'crack' ELSE 'pothole' END AS kind", "x1 + image % 7 AS x", "y1 AS y", "x2-x1 AS w", "y2-y1 AS h")
    return GE.road_overlap(det, p.filter("v > 125"), frame)


OVER_SQL = f"""{BOXES_SQL}, dt AS (SELECT image, did, x1 + image % 7 AS x1, y1, least(8, x1 + image % 7 + x2 - x1) AS x2, least(8, y2) AS y2 FROM bx), ov AS (SELECT d.image, d.did, CASE WHEN any_value(d.x2) <= any_value(d.x1) THEN 0 ELSE
    round(count(p.x) / ((any_value(d.x2)-any_value(d.x1))*(any_value(d.y2)-any_value(d.y1))), 4) END AS road_overlap FROM dt d LEFT JOIN fx_pixels p ON p.image=d.image AND p.v > 125 AND p.x >= d.x1 AND p.x < d.x2 AND p.y >= d.y1 AND p.y < d.y2 GROUP BY d.image, d.did)"""


@query("B7_road_overlap", with_views("fx_pixels", f", {OVER_SQL} SELECT image, CAST(did AS BIGINT) AS did, road_overlap FROM ov"))
def _(spark, sf):
    return overlap_of(Inputs(spark, sf)).select("image", "did", "road_overlap")


@query("B8_on_road", with_views("fx_pixels", f", {OVER_SQL} SELECT CASE WHEN did = 1 THEN 'crack' ELSE 'pothole' END AS kind, count(*) AS n, count(*) FILTER (road_overlap >= 0.5) AS n_on_road, count(*) FILTER (road_overlap < 0.5) AS n_off_road FROM ov GROUP BY 1"))
def _(spark, sf):
    return GE.on_road_counts(GE.on_road(overlap_of(Inputs(spark, sf))), ["kind"])


BOXCOMP = (COMP.format(cond="p.v > 125", near=NEAR8).replace("image, y, x, y*", "b.image, b.did, p.y, p.x, p.y*").replace("+x AS id FROM fx_pixels WHERE", "+p.x AS id FROM bx b JOIN fx_pixels p ON p.image=b.image AND p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2 WHERE")
           .replace("SELECT a.image, a.id", "SELECT a.image, a.did, a.id").replace("a.image=b.image AND", "a.image=b.image AND a.did=b.did AND").replace("SELECT image, id AS node", "SELECT image, did, id AS node")
           .replace("SELECT r.image, nb.v", "SELECT r.image, r.did, nb.v").replace("nb.image=r.image AND", "nb.image=r.image AND nb.did=r.did AND").replace("SELECT image, node, min", "SELECT image, did, node, min")
           .replace("SELECT o.image, o.y", "SELECT o.image, o.did, o.y").replace("low.image=o.image AND", "low.image=o.image AND low.did=o.did AND"))


@query("C20_spans_in_boxes", with_views("fx_pixels", f""", {BOXES_SQL}, {BOXCOMP}, c AS (SELECT image, did, label, count(*) AS n, greatest(max(x)-min(x)+1, max(y)-min(y)+1) AS s FROM lab GROUP BY ALL), m AS (SELECT image, did, max(n) AS n, max(s) AS s FROM c GROUP BY ALL)
    SELECT b.image, CAST(b.did AS BIGINT) AS did, round(coalesce(n, 0)/5, 6) AS longest, round(coalesce(s, 0)/5, 6) AS span, n IS NULL AS empty FROM bx b LEFT JOIN m USING (image, did)""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    return rounded(CC.spans_in_boxes(px_of(i).filter("v > 125"), raster_boxes(i)), "longest", "span")


@query("C19_box_state", with_views("fx_pixels", f""", {BOXES_SQL}, {COMP.format(cond='v > 130', near=NEAR8)}, w AS (SELECT image, label, min(x) AS a1, min(y) AS b1, max(x)+1 AS a2, max(y)+1 AS b2 FROM lab GROUP BY ALL),
    s AS (SELECT b.image, b.did, l.label FROM bx b JOIN lab l ON l.image=b.image AND l.x >= x1 AND l.x < x2 AND l.y >= y1 AND l.y < y2 GROUP BY b.image, b.did, l.label HAVING greatest(max(l.x)-min(l.x)+1, max(l.y)-min(l.y)+1)/5 >= 0.5),
    r AS (SELECT s.image, s.did, max(CASE WHEN greatest(least(a2,x2)-greatest(a1,x1),0)*greatest(least(b2,y2)-greatest(b1,y1),0) >= 0.5*(a2-a1)*(b2-b1) THEN 2 ELSE 1 END) AS r FROM s JOIN w USING (image, label) JOIN bx b ON b.image=s.image AND b.did=s.did GROUP BY ALL)
    SELECT b.image, CAST(b.did AS BIGINT) AS did, CASE r WHEN 2 THEN 'M' WHEN 1 THEN 'overflow' ELSE 'short' END AS state FROM bx b LEFT JOIN r USING (image, did)""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    return CC.box_state(labelled_of(i), raster_boxes(i))


@query("D21_largest_share", with_views("fx_pixels", f", {COMP.format(cond='v > 130', near=NEAR8)}, s AS (SELECT image, label, count(*) AS n FROM lab GROUP BY ALL) SELECT image, round(max(n)/sum(n), 6) AS share FROM s GROUP BY image", recursive=True))
def _(spark, sf):
    return rounded(D.largest_share(CC.component_sizes(labelled_of(Inputs(spark, sf)))), "share")


@query("D21_median_share", with_views("fx_pixels", f""", {COMP.format(cond='v > 130', near=NEAR8)}, s AS (SELECT image, label, count(*) AS n FROM lab GROUP BY ALL),
    p AS (SELECT image, max(n)/sum(n) AS share FROM s GROUP BY image) SELECT image % 5 AS part, round(median(share), 6) AS share, count(*) AS n FROM p GROUP BY 1""", recursive=True))
def _(spark, sf):
    shares = D.largest_share(CC.component_sizes(labelled_of(Inputs(spark, sf)))).selectExpr("image % 5 AS part", "share")
    return rounded(D.median_share(shares, ["part"]), "share")
