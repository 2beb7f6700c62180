"""Vectors as short codes: product codebooks fitted in rounds, with nearest entries found by slice-and-intersect bitmasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, staged

SCALE = 4096
#: entries of a codebook are the bits of one mask
MOST_ENTRIES = 64


class Slices:
    """One codebook, ready for search: along each coordinate its entries in order, with the mask of the first i of them for every i."""

    def __init__(self, book: np.ndarray):
        self.book = book
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.take_along_axis(book, order, axis=0)
        bits = np.uint64(1) << order.astype(np.uint64)
        self.first = np.zeros((len(book) + 1, book.shape[1]), np.uint64)
        np.bitwise_or.accumulate(bits, axis=0, out=self.first[1:])
        self.all = self.first[-1, 0] if book.shape[1] else np.uint64((1 << len(book)) - 1)

    def within(self, x: np.ndarray, radius: int) -> np.ndarray:
        """For each row of ``x`` the mask of all entries that differ from it by at most ``radius`` in every coordinate."""
        mask = np.full(len(x), self.all, np.uint64)
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            mask &= self.first[high, j] ^ self.first[low, j]
        return mask

    def nearest(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each row, the lower index in a tie.

        Whatever lies within the radius is among the candidates, so a candidate no farther than that is the nearest of all.
        Rows without one go on with twice the radius; the first radius decides on the work, never on the result.
        """
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        todo, radius = np.arange(len(x)), max(1, int(radius))
        while len(todo):
            xs = x[todo]
            mask = self.within(xs, radius)
            best, entry = np.full(len(xs), np.iinfo(np.int64).max), np.zeros(len(xs), np.int64)
            for k in range(len(self.book)):
                rows = np.flatnonzero(mask >> np.uint64(k) & np.uint64(1))
                off = xs[rows] - self.book[k]
                d = np.einsum("ij,ij->i", off, off)
                closer = d < best[rows]
                best[rows[closer]], entry[rows[closer]] = d[closer], k
            done = (best <= radius * radius) | (mask == self.all)
            code[todo[done]], error[todo[done]] = entry[done], best[done]
            todo, radius = todo[~done], 2 * radius
        return code, error


def limit_of(width: int) -> int:
    """Integers are held to this size, so that squared distances over ``width`` of them stay within 63 bits."""
    return 1 << (60 - max(1, width).bit_length()) // 2


def integers(vectors: pa.Array, length: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and floor(SCALE * x) of their components, shorter ones followed by zeros up to ``length``."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    bad = ~np.isfinite(values)  # nulls come as NaN
    sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    spoilt = np.concatenate(([0], np.cumsum(bad)))
    kept = np.flatnonzero((spoilt[ends] == spoilt[ends - sizes]) & np.asarray(vectors.is_valid()))
    top = limit_of(length // parts)
    whole = np.floor(np.clip(np.where(bad, 0.0, values) * SCALE, -top, top)).astype(np.int64)
    out = np.zeros((len(kept), length), np.int64)
    row = np.repeat(np.arange(len(kept)), sizes[kept])
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes[kept]) - sizes[kept], sizes[kept])
    out[row, column] = whole[np.repeat((ends - sizes)[kept], sizes[kept]) + column]
    return kept, out


def _sums(books: list[np.ndarray], radii: list[int]):
    """Of all vectors of a task: rows, error and component sums by part and entry."""
    parts, length = len(books), sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        totals = [np.zeros((len(b), b.shape[1] + 2), object) for b in books]
        for batch in batches:
            kept, x = integers(batch.column(0), length, parts)
            for p, part in enumerate(np.split(x, parts, axis=1)):
                code, error = slices[p].nearest(part, radii[p])
                order = np.argsort(code, kind="stable")
                found, starts = np.unique(code[order], return_index=True)
                if len(found):
                    wide = np.column_stack([np.ones(len(kept), np.int64), error, part])[order]
                    totals[p][found] += np.add.reduceat(wide, starts, axis=0).astype(object)
        rows = [(p, k, d, int(v)) for p, t in enumerate(totals) for k, line in enumerate(t) if line[0] for d, v in enumerate(line)]
        names = ["part", "entry", "place", "amount"]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return run


def _encoded(books: list[np.ndarray], radii: list[int]):
    parts, length = len(books), sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            kept, x = integers(batch.column(0), length, parts)
            codes, errors = np.zeros((len(kept), parts), np.uint8), np.zeros(len(kept), np.int64)
            for p, part in enumerate(np.split(x, parts, axis=1)):
                code, error = slices[p].nearest(part, radii[p])
                codes[:, p] = code
                errors += error
            digits, rows = codes.tobytes().hex(), pa.array(kept)
            texts = [digits[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), pa.array(texts, pa.string()), pa.array(errors)], [*batch.schema.names[1:], "code", "error"])

    return run


def fit_codebooks(df: DataFrame, id_col: str, vector_col: str, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[list[np.ndarray], list[int]]:
    """One codebook for each part, and a search radius for each.  Empty without kept rows.

    A codebook starts as the vectors of least id (nulls last, ties by components) and moves to the floored means of what is
    nearest to its entries, ``rounds`` times.  Only sums come back to the driver: entries x components numbers a round.
    """
    if not 0 < entries <= MOST_ENTRIES:
        raise ValueError(f"a codebook holds 1 to {MOST_ENTRIES} entries")
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = vectors.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))))
    first = sound.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return [], []
    longest = sound.agg(F.max(F.size("vector"))).first()[0]
    length = -(-longest // parts) * parts
    _, start = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), length, parts)
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    radii = [int(np.ptp(b, axis=0).max(initial=0)) // 2 + 1 for b in books]
    for _ in range(rounds):
        rows = df.select(vector_col).mapInArrow(_sums(books, radii), "part bigint, entry bigint, place bigint, amount bigint")
        totals: dict[tuple[int, int], dict[int, int]] = {}
        for r in rows.groupBy("part", "entry", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect():
            totals.setdefault((r.part, r.entry), {})[r.place] = int(r.amount)
        for p, book in enumerate(books):
            mine = [t for (q, _), t in totals.items() if q == p]
            mean = sum(t[1] for t in mine) // max(1, sum(t[0] for t in mine))
            radii[p] = int(1.25 * mean**0.5) + 1
            for k in range(len(book)):
                t = totals.get((p, k))
                if t:
                    book[k] = [t[2 + d] // t[0] for d in range(book.shape[1])]
    return books, radii


def written_books(books: list[np.ndarray]) -> str:
    return ",".join(str(v) for book in books for v in book.ravel().tolist())


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, list[np.ndarray]]:
    """``id, code, error, label_error`` for each kept row, and the codebooks.

    A row is kept if its vector is not null and holds neither nulls nor non-finite numbers; all its repetitions are.  Component x counts as
    floor(4096 * x), held to ``limit_of`` (2^28 for up to eight components a part).  Vectors shorter than the longest kept one count as
    followed by zeros, as do all up to a multiple of ``parts``; empty ones are all zeros.  ``code`` has two hex digits for each
    part, ``error`` is the squared distance to the coded vector, ``label_error`` its sum over rows of an equal label (nulls together).
    Null ids are kept and come last in the choice of the first entries.  An empty table gives an empty result and no codebooks.
    Columns other than these three are not read.
    """
    books, radii = fit_codebooks(df, id_col, vector_col, parts, entries, rounds)
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))
    rows = df.select(F.col(vector_col).alias("vector"), F.col(id_col).cast("bigint").alias("id"), label.alias("label"))
    schema = "id bigint, label string, code string, error bigint"
    if not books:
        return df.sparkSession.createDataFrame([], "id bigint, code string, error bigint, label_error bigint"), books
    coded = staged(rows.mapInArrow(_encoded(books, radii), schema), "vector-codes")
    groups = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("size"))
    return join_groups(coded, groups, "label", "size").select("id", "code", "error", "label_error"), books
