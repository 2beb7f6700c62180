"""The registered query of vector codes, with its DuckDB equivalent."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector_codes import vector_codes, written_books

_FLOOR = "(({s} - ((({s} % {n}) + {n}) % {n})) // {n})::BIGINT".format(s="sum(v)::HUGEINT", n="count(*)::HUGEINT")


def _assigned(t: int) -> str:
    """Each part of each row with its nearest entry of codebook ``t`` and the squared distance."""
    return f"""
         a{t} AS MATERIALIZED (SELECT row_no, p, min(e) AS e, d FROM (
             SELECT row_no, p, e, d, min(d) OVER (PARTITION BY row_no, p) AS least FROM (
                 SELECT c.row_no, c.p, b.e, sum((c.v - b.v) * (c.v - b.v))::BIGINT AS d FROM c JOIN b{t} AS b USING (p, j) GROUP BY ALL)) WHERE d = least GROUP BY row_no, p, d)"""


def _moved(t: int) -> str:
    """Codebook ``t`` from the parts assigned to the one before."""
    return f"""
         b{t} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.v, b.v) AS v FROM b{t - 1} AS b LEFT JOIN (
             SELECT p, e, j, {_FLOOR} AS v FROM c JOIN a{t - 1} USING (row_no, p) GROUP BY p, e, j) AS m USING (p, e, j))"""


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = ",".join(f"{_assigned(t)},{_moved(t + 1)}" for t in range(rounds))
    return f"""
    WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS row_no, vec_id, label, embedding FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         u AS (SELECT row_no, len(embedding) // {parts} AS w, unnest(range(len(embedding)))::BIGINT AS i, unnest(embedding)::DOUBLE AS x FROM v),
         c AS MATERIALIZED (SELECT row_no, i // w AS p, i % w AS j, floor(4096 * x)::BIGINT AS v FROM u),
         b0 AS MATERIALIZED (SELECT p, row_no - 1 AS e, j, v FROM c WHERE row_no <= {entries}),{steps},{_assigned(rounds)},
         r AS (SELECT row_no, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row_no),
         s AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds})
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (row_no), s
"""


def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every sound vector as a code of eight entries, with its error and that of its label."""
    coded, books = vector_codes(spark.read.parquet(f"{folder}/embeddings.parquet"))
    digest = hashlib.sha256(written_books(books).encode()).hexdigest()
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
