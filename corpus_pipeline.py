"""A corpus pipeline of five stages, each a whole job on what the one before it kept.

Every stage reads the columns of ``documents`` (doc_id, text, lang, source, n_chars) and passes them on; the last gives piece ids.
Each function takes (spark, docs, sf_dir).  Nulls, empty texts, ties and repeated rows follow the operators' docstrings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.llm.common import staged
from boxlens.llm.exact_dedup import keep_exact
from boxlens.llm.mixing import mixed_rows
from boxlens.llm.near_dedup import keep_near
from boxlens.llm.pieces import encode_pieces
from boxlens.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps; the rejected go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id."""
    return keep_near(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; one taken twice comes twice."""
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as piece ids, with a digest of the decoded text and whether decoding gives the text back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(docs, path, keep=("doc_id", "lang", "source"), check=True)
    return encoded.withColumn("n_ids", F.size("ids").cast("bigint"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("pieces", pieces)]

#: the model of the first stage and the sketches of the third are beyond SQL: the pipeline is tested against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
