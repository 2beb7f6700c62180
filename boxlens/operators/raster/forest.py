"""A maximum spanning forest of a raster: cut at any level it gives the components at that level, each edge used once.

Levels are gone through from strict to lax.  Each adds only its own edges to the parts so far, by rounds of Borůvka's algorithm: every part
takes the best edge that leaves it, so a round at least halves the parts that still have one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import large, stored
from ..geometry import pixels_in_boxes
from ..points import link_endpoints
from .components import box_state, piece_endpoints

#: the neighbours of a pixel that come after it in row-major order
AHEAD = [(0, 1), (1, -1), (1, 0), (1, 1)]


def node_of(y: Column, x: Column) -> Column:
    return F.shiftleft(y.cast("bigint"), 32) + x


def _roots(best: DataFrame, by: list[str]) -> DataFrame:
    """``v, root``: the smallest part among those that become one with part ``v``, when each part a took an edge (u, v) to part b.

    Two parts that took the same edge end a chain; its smaller part stands for it.  Following three steps at a time, the rounds
    grow with the logarithm of the longest chain.
    """
    back = best.select(*by, F.col("a").alias("b"), F.col("u").alias("bu"), F.col("v").alias("bv"))
    same = (F.col("bu") == F.col("u")) & (F.col("bv") == F.col("v")) & (F.col("a") < F.col("b"))
    to = best.join(large(back), [*by, "b"]).select(*by, "a", F.when(same, F.col("a")).otherwise(F.col("b")).alias("to"))
    follow = lambda p: p.join(large(p.select(*by, F.col("a").alias("to"), F.col("to").alias("far"))), [*by, "to"]).select(*by, "a", "to", "far")
    while True:
        for _ in range(2):
            to = follow(to).select(*by, "a", F.col("far").alias("to"))
        step = stored(follow(to))
        if step.filter("to <> far").isEmpty():
            break
        to = step.select(*by, "a", F.col("far").alias("to"))
    least = step.groupBy(*by, "far").agg(F.min("a").alias("root"))
    return step.join(large(least), [*by, "far"]).select(*by, F.col("a").alias("v"), "root")


def neighbour_edges(pixels: DataFrame, score: str, by: list[str]) -> DataFrame:
    """``u, v, weight`` of all pairs of 8-neighbours among ``pixels``; the weight is the lower score of the two."""
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in AHEAD]))
    here = pixels.select(*by, node_of(F.col("y"), F.col("x")).alias("u"), F.col(score).alias("su"), "y", "x", moves.alias("m"))
    here = here.select(*by, "u", "su", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"))
    there = pixels.select(*by, "y", "x", F.col(score).alias("sv"))
    return here.join(large(there), [*by, "y", "x"]).select(*by, "u", node_of(F.col("y"), F.col("x")).alias("v"), F.least("su", "sv").cast("double").alias("weight"))


def _lifted(edges: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """``edges`` (u, v, weight) with the labels of their ends in a < b, the best of each pair of labels only."""
    at = lambda c, to: labels.select(*by, F.col("node").alias(c), F.col("label").alias(to))
    met = edges.join(large(at("u", "p")), [*by, "u"]).join(large(at("v", "q")), [*by, "v"]).filter("p <> q")
    return _best(met.select(*by, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "u", "v", "weight"), by)


def _best(edges: DataFrame, by: list[str]) -> DataFrame:
    order = F.struct("weight", -F.col("u"), -F.col("v"))
    return edges.groupBy(*by, "a", "b").agg(F.max_by(F.struct("u", "v", "weight"), order).alias("e")).select(*by, "a", "b", "e.*")


def spanning_forest(nodes: DataFrame, edges: DataFrame, cuts: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The labels of all cuts (cut, node, label) and the forest's edges (u, v, weight, cut) they come from.

    ``nodes`` (node, first) and ``edges`` (u, v, weight, first) hold from their first cut on; weights must fall as cuts go on.  A cut starts from the parts of
    the one before.  In every round each part takes its best edge that leaves it (equal weights by u, then v), and parts
    that took an edge become one; when no edge is left the parts are the components of this cut.  The label is the smallest node.
    """
    order = F.struct("weight", -F.col("u"), -F.col("v"))
    labels, found, forest = None, [], []
    for k in range(cuts):
        fresh = nodes.filter(F.col("first") == k).select(*by, "node", F.col("node").alias("label"))
        labels = stored(fresh if labels is None else labels.unionByName(fresh))
        left = stored(_lifted(edges.filter(F.col("first") == k), labels, by))
        while not left.isEmpty():
            both = left.unionByName(left.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "u", "v", "weight"))
            best = both.groupBy(*by, "a").agg(F.max_by(F.struct("b", "u", "v", "weight"), order).alias("e"))
            chosen = stored(best.select(*by, "a", "e.*"))
            forest.append(chosen.select(*by, "u", "v", "weight", F.lit(k).alias("cut")).distinct())
            roots = _roots(chosen, by)
            labels = stored(labels.join(large(roots.select(*by, F.col("v").alias("label"), "root")), [*by, "label"], "left").select(*by, "node", F.coalesce("root", "label").alias("label")))
            left = stored(_lifted(left, labels, by))
        found.append(labels.withColumn("cut", F.lit(k)))
    none = edges.select(*by, "u", "v", "weight", F.lit(0).alias("cut")).limit(0)
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, forest, none)


def first_cut(value: Column, cuts: list[float], falling: bool) -> Column:
    """Index of the first of ``cuts``, falling or rising, that ``value`` reaches; null beyond the last."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(cuts))):
        out = F.when(value >= F.lit(float(cuts[k])) if falling else value <= F.lit(float(cuts[k])), k).otherwise(out)
    return out


def traces(pixels: DataFrame, score: str, levels: list[float], lo_ratio: float) -> DataFrame:
    """``image, level, y, x, label``: hysteresis traces at every level, from one forest.

    A level keeps the components of pixels at or above level * lo_ratio that hold one at or above the level.
    """
    levels = sorted((float(v) for v in levels), reverse=True)
    lows = [v * lo_ratio for v in levels]
    weak = stored(pixels.filter(F.col(score) >= lows[-1]).select("image", "y", "x", F.col(score).cast("double").alias("score")))
    nodes = weak.select("image", node_of(F.col("y"), F.col("x")).alias("node"), first_cut(F.col("score"), lows, True).alias("first"))
    edges = stored(neighbour_edges(weak, "score", ["image"]).withColumn("first", first_cut(F.col("weight"), lows, True)))
    labels, _ = spanning_forest(nodes, edges, len(levels), ["image"])
    scored = weak.select("image", "y", "x", "score", node_of(F.col("y"), F.col("x")).alias("node"))
    named = labels.join(large(scored), ["image", "node"]).withColumn("level", F.element_at(F.array(*[F.lit(v) for v in levels]), F.col("cut") + 1))
    strong = named.groupBy("image", "level", "label").agg(F.max("score").alias("top")).filter("top >= level").drop("top")
    return named.join(large(strong), ["image", "level", "label"]).select("image", "level", "y", "x", "label")


def linked_traces(trace: DataFrame, distances: list[float], angle: float = 30.0, radius: int = 6, min_pixels: int = 3) -> DataFrame:
    """``image, level, distance, y, x, label``: traces with facing ends joined up to each distance, and the lines that join them.

    Ends are paired once, nearest first, at the greatest distance: a shorter one has the pairs within it, since no later pair can undo them.
    Distance 0 joins nothing.  A line covers one pixel per step along its longer axis; where it meets a trace, the trace stays.
    """
    distances = sorted(float(d) for d in distances)
    keys = trace.select("image", "level").distinct()
    key = F.concat_ws("|", F.col("image").cast("string"), F.col("level").cast("string"))
    keyed = stored(trace.withColumn("image", key))
    ends = stored(piece_endpoints(keyed.drop("level"), radius, min_pixels))
    links = link_endpoints(ends.select("image", "pid", "x", "y", "label", "ux", "uy"), distances[-1], angle)
    end = lambda pid, s: ends.select("image", F.col("pid").alias(pid), F.col("label").alias(f"l{s}"), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    links = stored(links.join(large(end("pid", 1)), ["image", "pid"]).join(large(end("other", 2)), ["image", "other"]).withColumn("first", first_cut(F.col("dist"), distances, False)))
    pieces = keyed.select("image", F.col("label").alias("node")).distinct().withColumn("first", F.lit(0))
    groups, _ = spanning_forest(pieces, links.select("image", F.col("l1").alias("u"), F.col("l2").alias("v"), (-F.col("dist")).alias("weight"), "first"), len(distances), ["image"])
    groups = stored(groups)
    of_trace = keyed.select("image", "y", "x", F.col("label").alias("node")).join(large(groups), ["image", "node"]).select("image", "cut", "y", "x", "label")
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    step = lambda a, b: F.col(a) + F.floor((2 * (F.col(b) - F.col(a)) * F.col("i") + F.col("n")) / (2 * F.col("n"))).cast("bigint")
    line = links.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint"))))
    drawn = line.select("image", F.col("l1").alias("node"), "first", step("y1", "y2").alias("y"), step("x1", "x2").alias("x")).join(large(keyed.select("image", "y", "x")), ["image", "y", "x"], "left_anti")
    of_lines = drawn.join(large(groups), ["image", "node"]).filter(F.col("cut") >= F.col("first")).select("image", "cut", "y", "x", "label").distinct()
    named = keys.select(key.alias("key"), "image", "level")
    out = of_trace.unionByName(of_lines).withColumnRenamed("image", "key").join(large(named), "key")
    return out.select("image", "level", F.element_at(F.array(*[F.lit(d) for d in distances]), F.col("cut") + 1).alias("distance"), "y", "x", "label")


def box_states(groups: DataFrame, boxes: DataFrame, levels: list[float], distances: list[float]) -> DataFrame:
    """The state of every box (image, did, is_truth, x1..y2) at every level and distance; null for boxes under two pixels."""
    all_cuts = F.inline(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(float(d)).alias("distance")) for v in levels for d in distances]))
    by = ["image", "level", "distance"]
    wide = F.least(F.ceil("x2") - F.greatest(F.floor("x1"), F.lit(0)), F.ceil("y2") - F.greatest(F.floor("y1"), F.lit(0))) >= 2
    asked = boxes.select("image", "did", "is_truth", wide.alias("wide"), all_cuts)
    found = box_state(groups, boxes.select("image", "did", "x1", "y1", "x2", "y2"), by)
    return asked.join(large(found), [*by, "did"], "left").select(*by, "did", "is_truth", F.when(F.col("wide"), F.coalesce("state", F.lit("short"))).alias("state"))


def empty_boxes(trace: DataFrame, boxes: DataFrame, levels: list[float], tile: float = 64.0) -> DataFrame:
    """``level, empty``: the share of truth boxes without a trace pixel."""
    whole = boxes.filter("is_truth").select("image", "did", *[F.greatest(F.floor(c), F.lit(0)).cast("double").alias(c) for c in ("x1", "y1")], *[F.ceil(c).cast("double").alias(c) for c in ("x2", "y2")])
    met = pixels_in_boxes(trace.select("image", "level", "y", "x"), whole, tile=tile).select("image", "level", "did").distinct().withColumn("met", F.lit(True))
    asked = whole.select("image", "did", F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level"))
    return asked.join(large(met), ["image", "level", "did"], "left").groupBy("level").agg(F.avg(F.col("met").isNull().cast("int")).alias("empty"))


def long_groups(groups: DataFrame, boxes: DataFrame, images: DataFrame, levels: list[float], distances: list[float], pixels: int = 60) -> DataFrame:
    """``level, distance, n_long``: groups of at least ``pixels`` pixels per image with less than half of their box inside any truth box.

    A group meets the boxes of its own tiles only; the tile of the common corner counts a pair once.
    """
    by = ["image", "level", "distance"]
    g = groups.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).cast("double").alias(f"{c}1") for c in "xy"], *[(F.max(c) + 1).cast("double").alias(f"{c}2") for c in "xy"]).filter(F.col("n") >= pixels)
    tile = 512

    def tiles(df):
        for c in "xy":
            df = df.withColumn(f"t{c}", F.explode(F.sequence(F.floor(F.col(f"{c}1") / tile), F.floor(F.col(f"{c}2") / tile))))
        return df

    truth = tiles(boxes.filter("is_truth").select("image", "x1", "y1", "x2", "y2")).select("image", "tx", "ty", *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    w, h = (F.greatest(F.least(f"{c}2", f"b{c}2") - F.greatest(f"{c}1", f"b{c}1"), F.lit(0.0)) for c in "xy")
    inside = w * h >= 0.5 * F.greatest((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(1.0))
    own = tiles(g).join(large(truth), ["image", "tx", "ty"]).filter(inside).select(*by, "label").distinct()
    counted = g.join(large(own), [*by, "label"], "left_anti").groupBy("level", "distance").agg(F.count(F.lit(1)).alias("n"))
    cuts = F.inline(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(float(d)).alias("distance")) for v in levels for d in distances]))
    of_all = images.select("image").distinct().agg(F.count(F.lit(1)).alias("images")).select("images", cuts)
    return of_all.join(counted, ["level", "distance"], "left").select("level", "distance", (F.coalesce("n", F.lit(0)) / F.col("images")).alias("n_long"))
