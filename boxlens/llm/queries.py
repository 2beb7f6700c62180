"""The registered queries of this subpackage, with DuckDB equivalents where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .exact_dedup import exact_dedup
from . import fingerprints, trie_queries, vector_queries
from .language_model import score_texts
from .mixing import mix
from .near_dedup import near_dedup
from .pieces import encode_pieces
from .pii import KINDS, count_of, scan, written
from .quality import resample
from .suffix_dedup import suffix_dedup
from .token_files import token_index, write_token_files
from .warc import BASE32, read_archive, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_exact_dedup", f"""
    WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents),
         g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one of its group that stays: equal after lower-casing A-Z, largest id wins."""
    found = exact_dedup(documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


_LETTER = f"substr('{BASE32}', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31), 1)"


@query("op6_warc", f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
         f AS (SELECT page_id, t, min(page_id) OVER (PARTITION BY t) AS first_id, sha1(t) AS h FROM p)
    SELECT page_id, octet_length(encode(t)) AS payload_bytes, array_to_string([{_LETTER} FOR i IN range(32)], '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM f
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every page through the archive and back: its record's type, digest, size and what it refers to."""
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{folder}/pages.parquet"), path)
    return read_archive(spark, path).select(
        F.col("id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )


@query("op10_token_files")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as token ids in ordered files, and what the files say of it."""
    path = new_path(spark, "tokens")
    write_token_files(documents(spark, folder), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, path).withColumnRenamed("id", "doc_id")


@query("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as pieces and back: its ids, and whether decoding gives the text again."""
    encoded = encode_pieces(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"), check=True)
    return encoded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), "decoded_sha256", "round_trip")


_HEX52 = "('0x' || substr(k, 1, 13))::BIGINT"
_WORDS = "length(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> ''))"


@query("op7_mixing", f"""
    WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
         r AS (SELECT doc_id, source, size, ({_HEX52} + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d),
         s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
         w AS (SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
         l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
               FROM w WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST)),
         v AS (SELECT *, (SELECT level FROM l WHERE level * weight <= 3 * source_size ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST LIMIT 1) AS lam FROM l),
         t AS (SELECT source, source_size, coalesce(least(lam * weight, (3 * source_size)::DOUBLE), (3 * source_size)::DOUBLE) AS target FROM v),
         p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies, CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS p FROM t),
         a AS (SELECT r.*, source_size, target, copies, p, (u / (1 - u)) / (p / (1 - p)) AS pareto, target - copies * source_size AS rest
               FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source),
         b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY pareto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM a WHERE p > 0 AND size > 0),
         c AS (SELECT source, max(u) AS cut FROM b WHERE ahead + size::DOUBLE / 2 < rest GROUP BY source)
    SELECT doc_id, size, a.source_size, target, ((copies::BIGINT + CASE WHEN u <= coalesce(cut, -1) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
    FROM a LEFT JOIN c ON a.source IS NOT DISTINCT FROM c.source
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    return mix(documents(spark, folder)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op8_pii")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: base matches and those learned from their surroundings."""
    found = scan(documents(spark, folder))
    counts = [count_of(k, F.col("base")).alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query("op9_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The importance weight of every document and whether the resampling keeps it."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return resample(documents(spark, folder), labels).select(F.col("id").alias("doc_id"), "log_weight", "n_features", "gumbel", "kept")


@query("op1_fingerprints")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its text with the second half replaced, and how alike they are."""
    found = fingerprints.compared(documents(spark, folder))
    hexed = [fingerprints.written(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", *hexed, "near_edited", "near_next")


@query("op5_minhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its component of near duplicates: three-word shingles, similarity 0.85."""
    return near_dedup(documents(spark, folder), width=3, share=(85, 100)).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op3_suffix_array")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that also start anywhere else."""
    found = suffix_dedup(documents(spark, folder), length=200, first_stays=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


query("op11_vector_codes", vector_queries.oracle())(vector_queries.op11)
query("op12_conversation_trie", trie_queries.ORACLE)(trie_queries.op12)


@query("op13_language_model")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The log probability of every document under a word model of the training documents, and under its base."""
    scored, model = score_texts(documents(spark, folder))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score")
