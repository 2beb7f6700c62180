"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, row_hash, rows_kept, staged, whole_text, with_amount_before
from .mixing import uniform
from .token_files import slices

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 16_384
#: labelled rows that train the target model and the cut, at most: those of least hash
LABELLED = 50_000
CACHE_LIMIT = 200_000


class _Hashes(dict):
    """Token to 32-bit hash, remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE_LIMIT:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def features(text: str, buckets: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text; a run of punctuation is a word."""
    tokens = TOKEN.findall(text.lower())
    single = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = single[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (single[1:] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(29)
    return np.concatenate((single, pairs)) % np.uint64(buckets)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen = np.bincount(features(text, buckets).astype(np.int64), minlength=buckets)
                    raw += seen
                    if good:
                        target += seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    return run


def ngram_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each bucket from ``text, good``: over the good rows (target), and over all rows (raw).

    Each task gives one count for each bucket; their sums, ``buckets`` rows whatever the input, come to the driver.
    """
    summed = rows.mapInArrow(_counts(buckets), "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = np.zeros((2, buckets))
    for r in summed.collect():
        table[:, r.bucket] = r.target, r.raw
    return table


def log_ratios(table: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw)."""
    p = (table + smoothing) / (table + smoothing).sum(axis=1, keepdims=True)
    return np.log(p[0]) - np.log(p[1])


def unseen_sum(found: np.ndarray, copies: int, table: np.ndarray, weights: np.ndarray, smoothing: float = 1.0) -> float:
    """Sum of the log ratios of a good row as if its label were not known: without its ``copies`` in the target counts.

    Raw counts stay, as they hold every unlabelled row too.
    """
    at, own = np.unique(found, return_counts=True)
    target, total = table[0], table[0].sum() + smoothing * table.shape[1]
    less = np.log(target[at] - copies * own + smoothing) - np.log(target[at] + smoothing)
    return float(weights[found].sum() + (less * own).sum() + len(found) * (np.log(total) - np.log(total - copies * len(found))))


def _score(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = log_ratios(table)
        for batch in batches:
            for part in slices(batch, 0):
                found = [features(t, len(weights)).astype(np.int64) for t in part.column(0).to_pylist()]
                sums = [float(weights[f].sum()) for f in found]
                labels = zip(part.column(1).to_pylist(), part.column(2).to_pylist())
                unseen = [None if good is None else unseen_sum(f, n, table, weights) if good else s for f, s, (good, n) in zip(found, sums, labels)]
                sizes = pa.array([len(f) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(1), *part.columns[3:], pa.array(sums, pa.float64()), sizes, pa.array(unseen, pa.float64())], ["good", *part.schema.names[3:], "log_weight", "n_features", "unseen"])

    return run


def labelled_rows(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``id, good`` of up to ``limit`` labelled rows, those of least hash; repeated ids with different labels are left out."""
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    return one.filter("low = high").select("id", (F.col("high") == 1).alias("good")).orderBy(F.xxhash64("id"), "id").limit(limit)


def best_cut(scores: np.ndarray, good: np.ndarray, miss_cost: float = 20.0) -> float:
    """The score between two labelled ones that costs least, a good row below it costing ``miss_cost`` bad ones above.

    Nothing is cut without rows of both kinds, and never every good row.
    """
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.concatenate(([0], np.cumsum(g))) * miss_cost
    passed = (~g).sum() - np.concatenate(([0], np.cumsum(~g)))
    cost = lost + passed
    # only between different scores, with a good row above
    free = np.concatenate(([True], s[1:] > s[:-1], [True])) & (lost < lost[-1])
    at = int(np.flatnonzero(free & (cost == cost[free].min()))[0])
    return -np.inf if at == 0 else float((s[at - 1] + s[at]) / 2)


def best_line(scores: np.ndarray, sizes: np.ndarray, good: np.ndarray, miss_cost: float = 20.0) -> tuple[float, float]:
    """(rate, cut) by which ``scores - rate * sizes >= cut`` separates labelled rows at the least cost (see ``best_cut``).

    The rate is the share of a score that each n-gram gives by itself: sums of long texts lie further from zero, so one
    cut for all sums would take texts by their length.  The cut is zero at most: no text goes for being short.  Rates
    are tried between those of the labelled rows; of equally good ones the middle one is taken.
    """
    full = sizes > 0
    if good.all() or not good.any() or not full.any():
        return 0.0, -np.inf
    seen = np.unique(np.quantile(scores[full] / sizes[full], np.linspace(0, 1, 257)))
    rates = np.sort(np.concatenate((seen, (seen[1:] + seen[:-1]) / 2)))
    tried = []
    for rate in rates:
        rest = np.minimum(scores - rate * sizes, 0.0)
        cut = best_cut(rest, good, miss_cost)
        tried.append((miss_cost * (good & (rest < cut)).sum() + (~good & (rest >= cut)).sum(), float(rate), cut))
    least = min(t[0] for t in tried)
    best = [t[1:] for t in tried if t[0] == least]
    return best[len(best) // 2]


def resample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, labelled: int = LABELLED, temperature: float = 0.1, keep: int | None = None, seed: str = "quality") -> DataFrame:
    """One row per input row: ``id, row_key, log_weight, n_features, gumbel, place, kept``.

    ``log_weight`` is the log of the importance weight, summed over all n-grams of the whole text.  With ``keep``, the
    key of the sample is that log plus ``temperature`` times Gumbel noise from a hash of id and text, and the ``keep``
    largest keys are kept: a draw without replacement in proportion to the weights (sharpened below a temperature of one).
    Without it, the log weight is first made even over lengths by a rate for each n-gram, and as many rows are kept as
    then lie above the cut; rate and cut separate the labelled rows best, a good row lost counting for twenty bad ones
    kept.  For this, good rows are scored without their own n-grams in the target model, as unlabelled rows are.

    The target model and the cut come from at most ``labelled`` labelled rows, the raw model from every row.  A text
    without words has log weight zero.  Null text counts as empty and null ids have no label; rows that repeat id and
    text get one key and lie next to each other in the order; without labels of both kinds all rows are kept; an empty
    table gives an empty result.  Columns other than id and text are not read.
    """
    spark = df.sparkSession
    picked = staged(labelled_rows(labels, labelled), "quality-labels")
    docs = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    marked = docs.join(F.broadcast(picked.filter("good")), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    table = ngram_counts(marked, buckets)
    rows = docs.withColumn("row_key", row_hash(F.col("id"), F.col("text")))
    # a repeated row is in the target model as often as it comes
    again = rows.join(F.broadcast(picked.filter("good")), "id", "left_semi").groupBy("row_key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = rows.join(F.broadcast(picked), "id", "left").join(F.broadcast(again), "row_key", "left")
    rows = rows.select("text", "good", F.coalesce("copies", F.lit(1)).alias("copies"), "id", "row_key", uniform(seed, F.col("id"), F.col("text")).alias("u"))
    scored = rows.mapInArrow(_score(table), "good boolean, id bigint, row_key binary, u double, log_weight double, n_features bigint, unseen double")
    scored = staged(scored.withColumn("gumbel", -F.log(-F.log("u"))).drop("u"), "quality-scores")
    rate = 0.0
    if keep is None:
        known = scored.filter("good IS NOT NULL").select("unseen", "n_features", "good").limit(2 * labelled).collect()
        columns = (np.array([r[i] for r in known]) for i in range(2))
        rate, cut = best_line(*columns, np.array([r.good for r in known], bool)) if known else (0.0, -np.inf)
        keep = scored.filter(F.col("log_weight") - rate * F.col("n_features") >= float(cut)).count()
    scored = scored.drop("good", "unseen").withColumn("less", -(F.col("log_weight") - rate * F.col("n_features") + temperature * F.col("gumbel")))
    ranked = in_order(scored, ["less", "row_key"], "quality-order")
    placed = with_amount_before(ranked, F.lit(1), "place")
    return placed.select("id", "row_key", "log_weight", "n_features", "gumbel", "place", (F.col("place") < keep).alias("kept"))


def keep_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the resampling keeps, whole and with all their columns."""
    return rows_kept(df, row_hash(F.col(id_col), whole_text(text_col)), resample(df, labels, id_col, text_col), one_each=False)
