"""Queries over traces of stitched rasters: groups at every find level and link distance, and what they do to boxes."""

from __future__ import annotations

from ..operators import reports as D
from ..operators.raster import cues as CU
from ..operators.raster import forest as FO
from ..session import stored
from .registry import query
from .stand_ins import Inputs, with_views
from .stats_queries import rounded

LEVELS, RATIO = [145.0, 150.0, 155.0, 160.0], 0.94
DISTANCES, ANGLE, RADIUS, LONG = [0.0, 3.0, 6.0, 9.0], 50.0, 3, 12


def mosaic(i: Inputs):
    """Sixteen 8 x 8 rasters at a time, stitched to 32 x 32."""
    return i.pixels.selectExpr("image DIV 16 AS image", "image % 16 DIV 4 * 8 + y AS y", "image % 4 * 8 + x AS x", "v")


def mosaic_boxes(i: Inputs):
    """Four truth boxes and two controls per mosaic."""
    return mosaic(i).select("image").distinct().selectExpr("image", "explode(sequence(1L, 6L)) AS did").selectExpr(
        "image", "did", "did <= 4 AS is_truth", "double((did*7 + image*3) % 20) AS x1", "double((did*11 + image*5) % 20) AS y1",
        "double((did*7 + image*3) % 20 + 6 + did % 3 * 2) AS x2", "double((did*11 + image*5) % 20 + 5 + did % 2 * 4) AS y2",
    )


#: traces at all levels, whole components each time
TRACE_SQL = f""", ms AS MATERIALIZED (SELECT image // 16 AS image, image % 16 // 4 * 8 + y AS y, image % 4 * 8 + x AS x, v FROM fx_pixels),
    lv AS (SELECT unnest({LEVELS}::DOUBLE[]) AS level),
    on_ AS MATERIALIZED (SELECT image, level, y, x, v, y*4294967296+x AS id FROM ms, lv WHERE v >= level*{RATIO}e0),
    nb AS MATERIALIZED (SELECT a.image, a.level, a.id AS u, b.id AS v FROM on_ a JOIN on_ b ON a.image=b.image AND a.level=b.level AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1),
    reach AS (SELECT image, level, id AS node, id AS src FROM on_ UNION SELECT r.image, r.level, nb.v, r.src FROM reach r JOIN nb ON nb.image=r.image AND nb.level=r.level AND nb.u=r.node WHERE nb.v > r.src),
    low AS (SELECT image, level, node, min(src) AS label FROM reach GROUP BY ALL),
    tr AS MATERIALIZED (SELECT image, level, label, y, x, count(*) OVER c AS n FROM (SELECT o.*, low.label FROM on_ o JOIN low ON low.image=o.image AND low.level=o.level AND low.node=o.id)
        WINDOW c AS (PARTITION BY image, level, label) QUALIFY max(v) OVER c >= level)"""

#: ends of pieces, facing pairs nearest first, groups by distance and the drawn lines
GROUP_SQL = f""", en AS (SELECT a.image, a.level, a.label, a.y, a.x FROM tr a JOIN tr b ON a.image=b.image AND a.level=b.level AND a.label=b.label AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 WHERE a.n >= 3 GROUP BY ALL HAVING count(*) = 2),
    pt AS MATERIALIZED (SELECT image, level, label, y*1000000+x AS pid, x, y, (x-mx)/sqrt((x-mx)*(x-mx)+(y-my)*(y-my)) AS ux, (y-my)/sqrt((x-mx)*(x-mx)+(y-my)*(y-my)) AS uy FROM (
        SELECT a.*, avg(b.x) AS mx, avg(b.y) AS my, count(*) AS k FROM en a JOIN tr b ON a.image=b.image AND a.level=b.level AND a.label=b.label AND abs(a.y-b.y) <= {RADIUS} AND abs(a.x-b.x) <= {RADIUS} GROUP BY ALL)
        WHERE k >= 3 AND (x-mx)*(x-mx)+(y-my)*(y-my) >= 1e-6),
    cd AS (SELECT a.image, a.level, a.pid AS i, b.pid AS j, sqrt(CAST((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS DOUBLE)) AS dist, a.ux*(b.x-a.x)+a.uy*(b.y-a.y) AS fa, b.ux*(a.x-b.x)+b.uy*(a.y-b.y) AS fb
        FROM pt a JOIN pt b ON a.image=b.image AND a.level=b.level AND a.pid < b.pid AND a.label <> b.label),
    rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image, level ORDER BY dist, i, j) AS rn FROM cd WHERE dist > 0 AND dist <= {DISTANCES[-1]} AND fa/dist >= cos(radians({ANGLE})) AND fb/dist >= cos(radians({ANGLE}))),
    wk AS (SELECT image, level, rn, [i, j] AS used FROM rk WHERE rn = 1 UNION ALL
        SELECT r.image, r.level, r.rn, CASE WHEN list_contains(w.used, r.i) OR list_contains(w.used, r.j) THEN w.used ELSE list_append(list_append(w.used, r.i), r.j) END FROM wk w JOIN rk r ON r.image=w.image AND r.level=w.level AND r.rn=w.rn+1),
    fi AS (SELECT image, level, arg_max(used, rn) AS used FROM wk GROUP BY ALL),
    lk AS MATERIALIZED (SELECT p.image, p.level, p.label AS l1, q.label AS l2, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, sqrt(CAST((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y) AS DOUBLE)) AS dist, greatest(abs(p.x-q.x), abs(p.y-q.y)) AS n
        FROM (SELECT image, level, used[k*2+1] AS i, used[k*2+2] AS j FROM fi, LATERAL (SELECT unnest(range(len(used)//2)) AS k)) JOIN pt p ON p.image=fi.image AND p.level=fi.level AND p.pid=i JOIN pt q ON q.image=fi.image AND q.level=fi.level AND q.pid=j),
    ds AS (SELECT unnest({DISTANCES}::DOUBLE[]) AS distance),
    lb AS (SELECT image, level, distance, l1 AS u, l2 AS v FROM lk, ds WHERE dist <= distance UNION SELECT image, level, distance, l2, l1 FROM lk, ds WHERE dist <= distance),
    gr AS (SELECT DISTINCT image, level, distance, label AS node, label AS src FROM tr, ds UNION SELECT g.image, g.level, g.distance, lb.v, g.src FROM gr g JOIN lb ON lb.image=g.image AND lb.level=g.level AND lb.distance=g.distance AND lb.u=g.node),
    gl AS MATERIALIZED (SELECT image, level, distance, node, min(src) AS label FROM gr GROUP BY ALL),
    dr AS (SELECT DISTINCT image, level, dist, l1, y1 + CAST(floor((2*(y2-y1)*i + n) / (2.0*n)) AS BIGINT) AS y, x1 + CAST(floor((2*(x2-x1)*i + n) / (2.0*n)) AS BIGINT) AS x FROM lk, LATERAL (SELECT unnest(range(n + 1)) AS i)),
    gp AS MATERIALIZED (SELECT t.image, t.level, distance, t.y, t.x, gl.label FROM tr t JOIN gl ON gl.image=t.image AND gl.level=t.level AND gl.node=t.label
        UNION SELECT d.image, d.level, distance, d.y, d.x, gl.label FROM dr d JOIN gl ON gl.image=d.image AND gl.level=d.level AND gl.node=d.l1 AND d.dist <= distance WHERE NOT EXISTS (SELECT 1 FROM tr t WHERE t.image=d.image AND t.level=d.level AND t.y=d.y AND t.x=d.x))"""
GROUP_SQL = GROUP_SQL.replace("AS i, used[k*2+2] AS j FROM fi, LATERAL", "AS i, used[k*2+2] AS j FROM fi, LATERAL").replace("AS k)) JOIN pt p", "AS k)) AS fi JOIN pt p")

STATE_SQL = """, bx AS (SELECT image, did, did <= 4 AS is_truth, (did*7 + image*3) % 20 AS x1, (did*11 + image*5) % 20 AS y1, (did*7 + image*3) % 20 + 6 + did % 3 * 2 AS x2, (did*11 + image*5) % 20 + 5 + did % 2 * 4 AS y2
        FROM (SELECT DISTINCT image FROM ms), LATERAL (SELECT unnest(range(1, 7)) AS did)),
    wh AS (SELECT image, level, distance, label, count(*) AS n, min(x) AS a1, min(y) AS b1, max(x)+1 AS a2, max(y)+1 AS b2 FROM gp GROUP BY ALL),
    sp AS (SELECT b.image, level, distance, b.did, g.label FROM bx b JOIN gp g ON g.image=b.image AND g.x >= x1 AND g.x < x2 AND g.y >= y1 AND g.y < y2 GROUP BY ALL, x1, x2, y1, y2 HAVING greatest(max(g.x)-min(g.x)+1, max(g.y)-min(g.y)+1) / greatest(x2-x1, y2-y1) >= 0.5),
    fit AS (SELECT s.image, s.level, s.distance, s.did, max(CASE WHEN greatest(least(a2,x2)-greatest(a1,x1),0)*greatest(least(b2,y2)-greatest(b1,y1),0) >= 0.5*(a2-a1)*(b2-b1) THEN 2 ELSE 1 END) AS r FROM sp s JOIN wh USING (image, level, distance, label) JOIN bx b ON b.image=s.image AND b.did=s.did GROUP BY ALL),
    st AS MATERIALIZED (SELECT b.image, level, distance, b.did, is_truth, CASE r WHEN 2 THEN 'M' WHEN 1 THEN 'overflow' ELSE 'short' END AS state FROM bx b CROSS JOIN lv CROSS JOIN ds LEFT JOIN fit USING (image, level, distance, did))""".replace("GROUP BY ALL, x1, x2, y1, y2 HAVING", "GROUP BY b.image, level, distance, b.did, g.label, x1, x2, y1, y2 HAVING")


def groups_of(i: Inputs):
    trace = stored(FO.traces(mosaic(i), "v", LEVELS, RATIO))
    return trace, stored(FO.linked_traces(trace, DISTANCES, ANGLE, RADIUS))


@query("R25_forest_levels", with_views("fx_pixels", TRACE_SQL + " SELECT image, level, y, x, label FROM tr", recursive=True))
def _(spark, sf):
    return FO.traces(mosaic(Inputs(spark, sf)), "v", LEVELS, RATIO)


@query("D25_state_shares", with_views("fx_pixels", TRACE_SQL + GROUP_SQL + STATE_SQL + f""",
    em AS (SELECT level, avg((NOT EXISTS (SELECT 1 FROM tr t WHERE t.image=b.image AND t.level=lv.level AND t.x >= x1 AND t.x < x2 AND t.y >= y1 AND t.y < y2))::INT) AS empty FROM bx b CROSS JOIN lv WHERE is_truth GROUP BY level),
    lo AS (SELECT level, distance, count(*) AS n FROM wh w WHERE n >= {LONG} AND NOT EXISTS (SELECT 1 FROM bx b WHERE b.image=w.image AND is_truth AND greatest(least(a2,x2)-greatest(a1,x1),0)*greatest(least(b2,y2)-greatest(b1,y1),0) >= 0.5*greatest((a2-a1)*(b2-b1), 1)) GROUP BY ALL),
    sh AS (SELECT level, distance, count(*) FILTER (is_truth) AS n_truth, count(*) FILTER (NOT is_truth) AS n_control, avg((state='M')::INT) FILTER (is_truth) AS m, avg((state='M')::INT) FILTER (NOT is_truth) AS m_control,
        avg((state='overflow')::INT) FILTER (is_truth) AS overflow, avg((state='short')::INT) FILTER (is_truth) AS short FROM st GROUP BY ALL)
    SELECT level, distance, n_truth, n_control, round(m, 6) AS m, round(m_control, 6) AS m_control, round(overflow, 6) AS overflow, round(short, 6) AS short, round(m - m_control, 6) AS m_prime, round(empty, 6) AS empty,
        round(coalesce(n, 0) / (SELECT count(DISTINCT image) FROM ms), 6) AS n_long FROM sh JOIN em USING (level) LEFT JOIN lo USING (level, distance)""", recursive=True))
def _(spark, sf):
    i = Inputs(spark, sf)
    trace, groups = groups_of(i)
    boxes = stored(mosaic_boxes(i))
    shares = D.state_shares(FO.box_states(groups, boxes, LEVELS, DISTANCES), ["level", "distance"])
    long = FO.long_groups(groups, boxes, mosaic(i), LEVELS, DISTANCES, LONG)
    out = shares.join(FO.empty_boxes(trace, boxes, LEVELS), "level").join(long, ["level", "distance"])
    return rounded(out, "m", "m_control", "overflow", "short", "m_prime", "empty", "n_long")


WIDE_SQL = """wm AS MATERIALIZED (SELECT image, y, x, coalesce(v, 0) AS v FROM (SELECT image, y, x FROM (SELECT DISTINCT image // 64 AS image FROM fx_pixels), LATERAL (SELECT unnest(range(64)) AS y), LATERAL (SELECT unnest(range(64)) AS x)) AS f
        LEFT JOIN (SELECT image // 64 AS image, image % 64 // 8 * 8 + y AS y, image % 8 * 8 + x AS x, v FROM fx_pixels) USING (image, y, x))"""


def wide_mosaic(i: Inputs):
    """Sixty-four rasters at a time, stitched to 64 x 64; places without a raster are 0."""
    have = i.pixels.selectExpr("image DIV 64 AS image", "image % 64 DIV 8 * 8 + y AS y", "image % 8 * 8 + x AS x", "v")
    frame = have.select("image").distinct().selectExpr("image", "explode(sequence(0L, 63L)) AS y").selectExpr("*", "explode(sequence(0L, 63L)) AS x")
    return frame.join(have, ["image", "y", "x"], "left").selectExpr("image", "y", "x", "coalesce(v, 0D) AS v", "64L AS w", "64L AS h")


@query("R40_channel_outliers", with_views("fx_pixels", f""", {WIDE_SQL},
    rw AS (SELECT image, y, list(v ORDER BY x) AS r FROM wm GROUP BY image, y),
    pd AS MATERIALIZED (SELECT image, y, list_concat(list_concat([r[1] FOR i IN range(15)], r), [r[64] FOR i IN range(15)]) AS r FROM rw),
    bk AS MATERIALIZED (SELECT a.image, a.y, list(p.r) AS near FROM (SELECT image, y, greatest(0, least(63, y + unnest(range(-15, 16)))) AS py FROM rw) AS a JOIN pd AS p ON p.image=a.image AND p.y=a.py GROUP BY a.image, a.y),
    bg AS MATERIALIZED (SELECT image, y, x, v - list_aggregate(flatten([l[x+1:x+31] FOR l IN near]), 'median') AS d FROM wm JOIN bk USING (image, y)),
    md AS (SELECT image, median(d) AS m FROM bg WHERE y >= 32 GROUP BY image), sd AS (SELECT image, greatest(median(abs(d-m))*1.4826e0, 0.5) AS s FROM bg JOIN md USING (image) WHERE y >= 32 GROUP BY image),
    bx AS (SELECT DISTINCT image, did, (did*13 + image*3) % 40 AS x1, (did*17 + image*5) % 40 AS y1 FROM wm, LATERAL (SELECT unnest(range(1, 9)) AS did))
    SELECT b.image, did, round(avg((d/s < -3)::INT), 6) AS v_dark, round(avg((abs(d/s) > 3)::INT), 6) AS v_abs FROM bx b JOIN bg p ON p.image=b.image AND x >= x1 AND x < x1 + 20 AND y >= y1 AND y < y1 + 16 JOIN sd ON sd.image=b.image GROUP BY ALL"""))
def _(spark, sf):
    p = wide_mosaic(Inputs(spark, sf))
    boxes = p.select("image").distinct().selectExpr("image", "explode(sequence(1L, 8L)) AS did").selectExpr(
        "image", "did", "double((did*13 + image*3) % 40) AS x1", "double((did*17 + image*5) % 40) AS y1", "double((did*13 + image*3) % 40 + 20) AS x2", "double((did*17 + image*5) % 40 + 16) AS y2"
    )
    return rounded(CU.channel_outliers(p, boxes, ["v"]), "v_dark", "v_abs")
