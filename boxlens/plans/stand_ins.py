"""Detection-shaped views over the given tables.

Every view is a deterministic function of whole tables. ``Inputs`` builds them as DataFrames, ``with_views`` prepends
the same definitions, as CTE text, to an oracle query. Rows of ``fx_lines`` with (pk + sk) % 3 = 0 stand for detections without a
truth box, so ``fx_truth`` has none for them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTORS = ["D1", "D2"]

SQL = {
    "fx_lines": """SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) AS ln, l_partkey AS pk, l_suppkey AS sk,
        CAST(floor(l_quantity) AS BIGINT) AS q, CASE WHEN l_returnflag = 'A' THEN 'pothole' ELSE 'crack' END AS kind,
        ((l_linenumber*CAST(1000000 AS BIGINT) + l_partkey)*10000 + l_suppkey)*100 + CAST(floor(l_quantity) AS BIGINT) AS uid FROM lineitem""",
    "fx_truth": """SELECT image, kind, uid AS gid, (pk*37)%400 + 0.0e0 AS x1, (sk*53)%300 + 0.0e0 AS y1,
        (pk*37)%400 + 40 + q*4 + 0.0e0 AS x2, (sk*53)%300 + 40 + (pk%60) + 0.0e0 AS y2
        FROM fx_lines WHERE (pk + sk) % 3 <> 0""",
    "fx_det": """SELECT image, d.detector, kind, uid*10 + k AS did,
        (pk*37)%400 + (pk%d.j) - 15 + k*20 + 0.0e0 AS x1, (sk*53)%300 + (sk%21) - 10 + 0.0e0 AS y1,
        (pk*37)%400 + (pk%d.j) - 15 + k*20 + (40 + q*4) / (1 + k) AS x2, (sk*53)%300 + (sk%21) + 30 + (pk%60) + 0.0e0 AS y2
        FROM fx_lines CROSS JOIN (VALUES (0), (1)) AS t(k) CROSS JOIN (VALUES ('D1', 31), ('D2', 61)) AS d(detector, j)
        WHERE (k = 0 OR pk % 4 = 0) AND NOT (d.detector = 'D2' AND pk % 7 = 0)""",
    "fx_images": """SELECT o_orderkey AS image, (o_custkey % 10 <> 0) AS has_gt,
        CASE o_custkey % 4 WHEN 0 THEN 'blur' WHEN 1 THEN 'local_illumination'
            WHEN 2 THEN 'blur;local_illumination' ELSE 'normal' END AS tags,
        CASE o_orderstatus WHEN 'F' THEN 'far' WHEN 'O' THEN 'road_full' ELSE 'ambiguous' END AS viewpoint FROM orders""",
    "fx_geometry": """SELECT o_orderkey AS image, 640.0e0 AS original_width, 440.0e0 AS original_height,
        (o_custkey % 7) * 20 + 0.0e0 AS crop_x, (o_custkey % 5) * 60 + 0.0e0 AS crop_y,
        1.0e0 + (o_custkey % 3) * 0.5e0 AS scale_x, 1.0e0 + (o_custkey % 3) * 0.5e0 AS scale_y,
        (640.0e0 - (o_custkey % 7) * 20) * (1.0e0 + (o_custkey % 3) * 0.5e0) AS output_width,
        (440.0e0 - (o_custkey % 5) * 60) * (1.0e0 + (o_custkey % 3) * 0.5e0) AS output_height FROM orders""",
    "fx_strata": """SELECT d.doc_id AS image, d.lang AS source, d.source AS grp, l.quality AS has_damage
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_features": """SELECT d.doc_id, l.quality AS real, CAST(d.n_chars AS DOUBLE) AS f_len, CAST(d.n_chars % 97 AS DOUBLE) AS f_tie,
        CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS DOUBLE) AS f_words
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_long": """SELECT doc_id, real, 'f_len' AS feature, f_len AS value FROM fx_features
        UNION ALL SELECT doc_id, real, 'f_tie', f_tie FROM fx_features
        UNION ALL SELECT doc_id, real, 'f_words', f_words FROM fx_features""",
    "fx_cells": """SELECT CAST(floor(event_id / 500) AS BIGINT) AS image, CAST(floor(user_id / 15) AS BIGINT) AS r, user_id % 15 AS c,
        avg(value) AS mean_v, stddev_pop(value) AS std_v, count(*) AS n FROM events GROUP BY 1, 2, 3""",
    "fx_points": """SELECT l_orderkey % 400 AS image, (l_orderkey*1000000 + l_partkey)*1000 + l_linenumber*100 + CAST(floor(l_quantity) AS BIGINT) AS pid, (l_partkey*37) % 2000 AS x,
        (l_suppkey*53 + l_linenumber*211) % 2000 AS y, l_partkey % 50 AS label FROM lineitem""",
    "fx_pixels": """SELECT vec_id AS image, CAST(floor((i-1)/8) AS BIGINT) AS y, (i-1)%8 AS x, floor((CAST(e AS DOUBLE)+1)*127.5) AS v
        FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1,65)) AS i FROM embeddings)""",
}

NEEDS = {
    "fx_truth": ["fx_lines"], "fx_det": ["fx_lines"], "fx_long": ["fx_features"],
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` is either a SELECT or further ``name AS (...)`` CTEs followed by one, introduced by a leading comma."""
    order: list[str] = []

    def add(n):
        for dep in NEEDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    lead = "WITH RECURSIVE " if recursive else "WITH "
    if body.startswith(","):
        return f"{lead}{ctes}{body}"
    return f"{lead}{ctes}\n{body}"


class Inputs:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _spread(self, df: DataFrame) -> DataFrame:
        """Deal a table that arrives in fewer splits than there are cores to all of them. Larger inputs pass unchanged."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, "image") if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def lines(self) -> DataFrame:
        return self._spread(self.table("lineitem").select(
            F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("bigint").alias("ln"),
            F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.floor("l_quantity").cast("bigint").alias("q"),
            F.when(F.col("l_returnflag") == "A", "pothole").otherwise("crack").alias("kind"),
            F.expr("((l_linenumber*1000000L + l_partkey)*10000 + l_suppkey)*100 + bigint(floor(l_quantity))").alias("uid"),
        ))

    @cached_property
    def truth(self) -> DataFrame:
        return self.lines.filter("(pk + sk) % 3 <> 0").selectExpr(
            "image", "kind", "uid AS gid", "double((pk*37)%400) AS x1", "double((sk*53)%300) AS y1",
            "double((pk*37)%400 + 40 + q*4) AS x2", "double((sk*53)%300 + 40 + pk%60) AS y2",
        )

    @cached_property
    def det(self) -> DataFrame:
        spread = self.lines.selectExpr("*", "explode(array(0, 1)) AS k").selectExpr(
            "*", "inline(array(struct('D1' AS detector, 31 AS j), struct('D2' AS detector, 61 AS j)))"
        )
        return spread.filter("(k = 0 OR pk % 4 = 0) AND NOT (detector = 'D2' AND pk % 7 = 0)").selectExpr(
            "image", "detector", "kind", "uid*10 + k AS did",
            "double((pk*37)%400 + (pk%j) - 15 + k*20) AS x1", "double((sk*53)%300 + (sk%21) - 10) AS y1",
            "(pk*37)%400 + (pk%j) - 15 + k*20 + (40 + q*4) / (1 + k) AS x2", "double((sk*53)%300 + (sk%21) + 30 + pk%60) AS y2",
        )

    @cached_property
    def images(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS image", "o_custkey % 10 <> 0 AS has_gt",
            "CASE o_custkey % 4 WHEN 0 THEN 'blur' WHEN 1 THEN 'local_illumination' "
            "WHEN 2 THEN 'blur;local_illumination' ELSE 'normal' END AS tags",
            "CASE o_orderstatus WHEN 'F' THEN 'far' WHEN 'O' THEN 'road_full' ELSE 'ambiguous' END AS viewpoint",
        )

    @cached_property
    def geometry(self) -> DataFrame:
        s = "(1.0D + (o_custkey % 3) * 0.5D)"
        return self.table("orders").selectExpr(
            "o_orderkey AS image", "640.0D AS original_width", "440.0D AS original_height",
            "double((o_custkey % 7) * 20) AS crop_x", "double((o_custkey % 5) * 60) AS crop_y",
            f"{s} AS scale_x", f"{s} AS scale_y",
            f"(640.0D - (o_custkey % 7) * 20) * {s} AS output_width", f"(440.0D - (o_custkey % 5) * 60) * {s} AS output_height",
        )

    @cached_property
    def _labelled(self) -> DataFrame:
        return self.table("documents").join(self.table("labels"), "doc_id")

    @cached_property
    def strata(self) -> DataFrame:
        return self._labelled.selectExpr("doc_id AS image", "lang AS source", "source AS grp", "quality AS has_damage")

    @cached_property
    def features(self) -> DataFrame:
        return self._labelled.selectExpr(
            "doc_id", "quality AS real", "double(n_chars) AS f_len", "double(n_chars % 97) AS f_tie",
            "double(length(text) - length(replace(text, ' ', '')) + 1) AS f_words",
        )

    @cached_property
    def long_features(self) -> DataFrame:
        return self.features.unpivot(["doc_id", "real"], ["f_len", "f_tie", "f_words"], "feature", "value")

    @cached_property
    def cells(self) -> DataFrame:
        """Mean and deviation are folded over a cell's events in ascending event_id (at most 500 of them): sums merged in the order
        in which tasks finish would move a value that lies on a limit to either side of it."""
        event = F.struct("event_id", F.col("value").cast("double").alias("v"))
        cells = self.table("events").groupBy(
            F.floor(F.col("event_id") / 500).alias("image"), F.floor(F.col("user_id") / 15).alias("r"), (F.col("user_id") % 15).alias("c"),
        ).agg(F.array_sort(F.collect_list(event)).alias("_e"), F.count("*").alias("n"))
        fold = """aggregate(filter(_e, e -> e.v IS NOT NULL), named_struct('k', 0L, 's', 0D, 'm', 0D, 'q', 0D), (a, e) -> named_struct(
            'k', a.k + 1, 's', a.s + e.v, 'm', a.m + (e.v - a.m) / (a.k + 1), 'q', a.q + (e.v - (a.m + (e.v - a.m) / (a.k + 1))) * (e.v - a.m)))"""
        return cells.select("image", "r", "c", F.expr(fold).alias("_f"), "n").selectExpr(
            "image", "r", "c", "try_divide(_f.s, _f.k) AS mean_v", "CASE WHEN _f.k > 0 THEN sqrt(_f.q / _f.k) END AS std_v", "n",
        )

    @cached_property
    def points(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey % 400 AS image", "(l_orderkey*1000000 + l_partkey)*1000 + l_linenumber*100 + bigint(floor(l_quantity)) AS pid", "(l_partkey*37) % 2000 AS x",
            "(l_suppkey*53 + l_linenumber*211) % 2000 AS y", "l_partkey % 50 AS label",
        )

    @cached_property
    def pixels(self) -> DataFrame:
        vectors = self._spread(self.table("embeddings").selectExpr("vec_id AS image", "embedding"))
        return vectors.selectExpr("image", "posexplode(embedding) AS (i, e)").selectExpr(
            "image", "bigint(floor(i/8)) AS y", "bigint(i%8) AS x", "double(floor((double(e)+1)*127.5)) AS v",
        )
