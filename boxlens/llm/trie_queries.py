"""The registered query of the conversation trie, with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .conversation_trie import conversation_trie


#: CRC-32 of the decimal id, which DuckDB lacks: list_reduce carries the checksum through the bytes of the id; each byte takes eight steps of a nested reduce
CRC = (
    "xor(list_reduce([4294967295::BIGINT] || [ascii(ch)::BIGINT FOR ch IN string_split_regex(c::VARCHAR, '')], "
    "lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT FOR k IN range(8)], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
)

ORACLE = f"""
    WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
              FROM conversations WHERE conv_id IS NOT NULL),
         c AS (SELECT c, ({CRC}) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
         r AS (SELECT c.c, 0 AS own, pos, role, text FROM c JOIN t ON t.c = c.c - c.c % 5 AND pos <= h
               UNION ALL SELECT c.c, 1, pos, role, text FROM c JOIN t ON t.c = c.c AND pos > h),
         d AS MATERIALIZED (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth FROM r),
         p AS (SELECT c, 0::BIGINT AS depth, '' AS name, '' AS text FROM c
               UNION ALL SELECT d.c, d.depth, sha256(p.name || '|' || length(d.role) || ':' || d.role || d.text), d.text FROM p JOIN d ON d.c = p.c AND d.depth = p.depth + 1),
         m AS MATERIALIZED (SELECT *, lag(name) OVER (PARTITION BY c ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY c) AS ends FROM p),
         n AS MATERIALIZED (SELECT depth, name, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, (count(*) - 1) * octet_length(encode(any_value(text))) AS saved,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY depth, name),
         k AS (SELECT n.*, q.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.up = n.name) AS n_children
               FROM n LEFT JOIN n AS q ON q.depth = n.depth - 1 AND q.name = n.up),
         s AS (SELECT depth, name, up, n_children, saved, depth AS top_depth, name AS top_name FROM k
               UNION ALL SELECT s.depth, s.name, k.up, s.n_children, s.saved, k.depth, k.name FROM s JOIN k ON k.depth = s.top_depth - 1 AND k.name = s.up),
         g AS (SELECT top_depth AS depth, top_name AS name, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM s GROUP BY top_depth, top_name)
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM k JOIN g USING (depth, name)
"""


def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every shared prefix of the rebuilt conversations with its members, children and subtree sums."""
    return conversation_trie(spark.read.parquet(f"{folder}/conversations.parquet")).drop("k1", "k2")
