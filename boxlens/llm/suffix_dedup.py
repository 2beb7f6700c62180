"""Repeated byte strings by suffix order and longest previous factors.

A string that occurs twice has the same least hashed gram in both places.  So windows of ``length`` bytes are dealt out by
that gram: consecutive windows with the same one travel as one string, equal strings (by a 16-byte digest) are collapsed, and only where
different strings share a gram are their bytes brought together.  There the windows are put into suffix order, and for each
the previous and the next entry with a smaller text position tell whether it has an earlier match of full length, those with a
greater one whether it has a later match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, maybe_in, row_hash, staged, whole_text, width
from .shingles import INVERSE, ROOT, mix, powers, utf8
from .token_files import slices

GRAM = 24
#: windows in one string at most
RUN = 512
#: windows under one gram, all their different strings together, up to which they are put into suffix order in one task (each takes its
#: length in memory, several times over); beyond, they are compared window by window over the cluster
HOT = 300_000
BATCH_BYTES = 1_000_000
#: bytes of strings put into suffix order at once; each of their windows takes its length in memory, several times over
MATCH_BYTES = 150_000


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers(ROOT, len(data)), out=sums[1:])
    return sums


def hash_at(sums: np.ndarray, starts: np.ndarray, sizes) -> np.ndarray:
    """Hashes of the byte strings of given starts and sizes."""
    return mix((sums[starts + sizes] - sums[starts]) * powers(INVERSE, len(sums))[starts] + np.asarray(sizes).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding(values: np.ndarray, span: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``span`` consecutive values: running values from both ends of blocks."""
    n = len(values) - span + 1
    blocks = -(-len(values) // span)
    padded = np.full(blocks * span, fill, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(blocks, span)
    forward = pick.accumulate(table, axis=1).reshape(-1)
    backward = pick.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(backward[:n], forward[span - 1 : span - 1 + n])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def runs_of(data: np.ndarray, cuts: np.ndarray, length: int) -> dict:
    """Runs of windows that share their least gram: text number, start in the text, windows, gram, digest of the string, and whether the
    gram comes twice in its text (then windows of one run may repeat each other)."""
    gram, span = min(GRAM, length), length - min(GRAM, length) + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return {"text": none, "start": none, "windows": none, "gram": none, "string": [], "again": np.zeros(0, bool)}
    sums = prefix_sums(data)
    hashes = hash_at(sums, np.arange(len(data) - gram + 1), gram)
    least = sliding(hashes, span, np.minimum, (1 << 64) - 1)
    text_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    inside = text_of[: len(least)] == text_of[length - 1 :]
    least[~inside] = 0
    # a gram is some window's least one if it equals the greatest among the minima of the windows around it
    around = np.zeros(len(hashes) + span - 1, np.uint64)
    around[span - 1 : span - 1 + len(least)] = least
    chosen = np.flatnonzero(sliding(around, span, np.maximum, 0) == hashes)
    own = mix(hashes[chosen] + text_of[chosen].astype(np.uint64) * np.uint64(ROOT))
    own.sort()
    twice = own[1:][own[1:] == own[:-1]]
    at = np.flatnonzero(inside)
    value = least[at]
    first = np.ones(len(at), bool)
    first[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, len(at)))
    parts = -(-sizes // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    windows = np.minimum(np.repeat(sizes, parts) - nth * RUN, RUN)
    start = np.repeat(at[heads], parts) + nth * RUN
    text = text_of[start]
    gram_value = least[start]
    again = np.isin(mix(gram_value + text.astype(np.uint64) * np.uint64(ROOT)), twice)
    raw = data.tobytes()
    string = [digest(raw[s:e]) for s, e in zip(start.tolist(), (start + windows + (length - 1)).tolist())]
    return {"text": text, "start": start - cuts[text], "windows": windows, "gram": gram_value.astype(np.int64), "string": string, "again": again}


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, BATCH_BYTES):
                r = runs_of(*utf8(part.column(0)), length)
                of = pa.array(r["text"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(of), part.column(2).take(of), pa.array(r["start"]), pa.array(r["windows"].astype(np.int32)), pa.array(r["gram"]), pa.array(r["string"], pa.binary()), pa.array(r["again"])],
                    ["id", "row_key", "start", "windows", "gram", "string", "again"],
                )

    return run


RUN_SCHEMA = "id bigint, row_key binary, start bigint, windows int, gram bigint, string binary, again boolean"


def previous_matches(rows: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows as rows of bytes at text positions: has it a match of full length earlier, and one anywhere else?

    Windows are put into suffix order (their bytes are all of the suffix that a match of full length depends on), and
    neighbours with a common prefix of full length form blocks.  In its block a window's previous smaller position is the running
    minimum before it and its next smaller one the running minimum behind it; if either lies below its own position, its
    longest previous factor is at least the window.  Its longest next factor goes by the greater positions in the same way, and a
    window occurs elsewhere if either factor is.
    """
    n = len(rows)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    ordered = rows[order]
    block = np.concatenate(([0], np.cumsum((ordered[1:] != ordered[:-1]).any(axis=1))))
    rank = np.empty(n, np.int64)
    rank[np.argsort(position, kind="stable")] = np.arange(n)
    rank = rank[order]
    # one pass for all blocks: an offset per block makes each start afresh
    before = np.minimum.accumulate(rank - block * n) + block * n
    behind = np.minimum.accumulate((rank + block * n)[::-1])[::-1] - block * n
    over = np.maximum.accumulate(rank + block * n) - block * n
    under = np.maximum.accumulate((rank - block * n)[::-1])[::-1] + block * n
    earlier, later = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order] = (before < rank) | (behind < rank)
    later[order] = (over > rank) | (under > rank)
    return earlier, earlier | later


def _matched(length: int, first_stays: bool):
    def judged(group: list[dict]) -> list[tuple[int, int, list[int], list[int]]]:
        data = np.frombuffer(b"".join(g["bytes"] for g in group), np.uint8)
        sizes = np.array([g["windows"] for g in group])
        bases = np.concatenate(([0], np.cumsum([len(g["bytes"]) for g in group])))[:-1]
        nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = np.lib.stride_tricks.sliding_window_view(data, length)[np.repeat(bases, sizes) + nth]
        ranked = sorted(range(len(group)), key=lambda i: (group[i]["id"] is None, group[i]["id"] or 0, group[i]["row_key"]))
        text, last = np.zeros(len(group), np.int64), -1
        for n, i in enumerate(ranked):
            same = n and group[ranked[n - 1]]["row_key"] == group[i]["row_key"]
            last += not same
            text[i] = last
        position = (np.repeat(text, sizes) << 40) + np.repeat(np.array([g["start"] for g in group]), sizes) + nth
        flags = previous_matches(rows, position)[0 if first_stays else 1]
        out = []
        ends = np.cumsum(sizes)
        for g, s, e in zip(group, (ends - sizes).tolist(), ends.tolist()):
            own = flags[s:e]
            if own.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                out.append((g["gram"], g["string"], edges[::2].tolist(), edges[1::2].tolist()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        held = 0

        def flush(part: list[dict]) -> pa.RecordBatch:
            found = judged(part)
            cols = list(zip(*found)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["gram", "string", "froms", "tos"])

        for batch in batches:
            for row in batch.to_pylist():
                if held > MATCH_BYTES and row["gram"] != group[-1]["gram"]:
                    yield flush(group)
                    group, held = [], 0
                group.append(row)
                held += len(row["bytes"])
        if group:
            yield flush(group)

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, data, at = row["windows"], row["bytes"], np.arange(row["windows"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(data[i : i + length]) for i in range(n)], pa.binary()), *[pa.array([row[c]] * n, t) for c, t in (("gram", pa.int64()), ("string", pa.binary()), ("id", pa.int64()), ("row_key", pa.binary()))], pa.array(at + row["start"]), pa.array(at.astype(np.int32))],
                    ["window", "gram", "string", "id", "row_key", "position", "nth"],
                )

    return run


def repeated_runs(strings: DataFrame, texts: DataFrame, length: int, first_stays: bool) -> DataFrame:
    """``gram, string, froms, tos``: window ranges of each distinct string that match another window."""
    n = width(strings.sparkSession)
    nulls_last = [F.col("id").isNull(), "id", "row_key", "start"]
    with_bytes = maybe_in(texts, "row_key", strings).join(strings, "row_key").select(
        "gram", "string", "windows", "id", "row_key", "start", "crowd", F.substring(F.col("text").cast("binary"), F.col("start").cast("int") + 1, F.col("windows") + (length - 1)).alias("bytes")
    )
    # identical rows of a table share a key; their string comes once
    with_bytes = staged(with_bytes.dropDuplicates(["gram", "string"]), "suffix-strings")
    schema = "gram bigint, string binary, froms array<int>, tos array<int>"
    few = with_bytes.filter(F.col("crowd") <= HOT).drop("crowd").repartition(n, "gram").sortWithinPartitions("gram", *nulls_last)
    calm = few.mapInArrow(_matched(length, first_stays), schema)
    each = with_bytes.filter(F.col("crowd") > HOT).drop("crowd").mapInArrow(_windows(length), "window binary, gram bigint, string binary, id bigint, row_key binary, position bigint, nth int")
    each = staged(each, "suffix-windows")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key", "position")
    met = each.groupBy("window").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).filter("times > 1")
    matched = join_groups(each, staged(met, "suffix-met"), ["window"], "times")
    if first_stays:
        matched = matched.filter((F.col("row_key") != F.col("first.row_key")) | (F.col("position") != F.col("first.position")))
    crowded = matched.groupBy("gram", "string").agg(F.array_sort(F.collect_list("nth")).alias("froms")).select("gram", "string", "froms", F.transform("froms", lambda i: i + 1).alias("tos"))
    return calm.unionByName(crowded)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            at, kept = 0, hashlib.sha256()
            for s, e in merged:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            rows.append((len(data), sum(e - s for s, e in merged), [{"s": s, "e": e} for s, e in merged], kept.hexdigest()))
        cols = list(zip(*rows)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(2), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, first_stays: bool = True) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_removed, spans, kept_sha256``.

    Texts are UTF-8 bytes, null counting as empty, and matches never cross texts.  Each byte goes that is covered by a string of ``length``
    bytes that also starts at an earlier position (by id, null last, then row key, then place); the first copy stays.
    With ``first_stays=False`` a match anywhere else suffices, so all copies go.  Overlapping matches count, and strings are judged
    on the input.  ``spans`` are the maximal removed runs, from and to (exclusive).

    Rows that repeat id and text count as copies of each other where all copies go; where the first stays they are one
    text and share one result.  Texts shorter than ``length`` lose nothing.  An empty table gives an empty result, and
    columns other than id and text are not read.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), whole_text(text_col).alias("text")).withColumn("row_key", row_hash(F.col("id"), F.col("text")))
    runs = staged(docs.select("text", "id", "row_key").mapInArrow(_runs(length), RUN_SCHEMA), "suffix-runs")
    common = runs.groupBy("gram").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("seen")).filter("seen > 1").select("gram")
    met = staged(runs.join(common, "gram", "left_semi"), "suffix-met-runs")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key", "start")
    strings = staged(
        met.groupBy("gram", "string", "windows").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"), F.max("again").alias("again")), "suffix-distinct"
    )
    crowds = strings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum("windows").alias("crowd"), F.max("again").alias("any_again")).filter("n > 1 OR any_again")
    # a string met once, or one whose first copy may stay, has to be looked into; the rest of its gram is what it is held against
    open_strings = strings.join(crowds.select("gram", "crowd"), "gram").select("gram", "string", "windows", F.col("first.id").alias("id"), F.col("first.row_key").alias("row_key"), F.col("first.start").alias("start"), "crowd")
    ranges = staged(repeated_runs(open_strings, docs.select("row_key", "text"), length, first_stays), "suffix-ranges")
    judged = staged(strings.join(ranges, ["gram", "string"], "left"), "suffix-judged")
    each = join_groups(met.drop("again"), judged.drop("again"), ["gram", "string", "windows"], "times")
    is_first = (F.col("row_key") == F.col("first.row_key")) & (F.col("start") == F.col("first.start"))
    wholly = F.array(F.struct(F.lit(0).alias("f"), F.col("windows").alias("t")))
    parts = F.arrays_zip(F.col("froms").alias("f"), F.col("tos").alias("t"))
    gone = F.when((F.col("times") > 1) & (~is_first if first_stays else F.lit(True)), wholly).otherwise(parts)
    spans = (
        each.filter((F.col("times") > 1) | F.col("froms").isNotNull()).select("row_key", "start", F.explode(gone).alias("r"))
        .select("row_key", F.struct((F.col("start") + F.col("r.f")).alias("s"), (F.col("start") + F.col("r.t") + (length - 1)).alias("e")).alias("span"))
        .groupBy("row_key").agg(F.collect_set("span").alias("spans"))
    )
    spans = staged(spans, "suffix-spans")
    touched = maybe_in(docs, "row_key", spans).join(spans, "row_key").select(F.col("text").cast("binary").alias("text"), "spans", "id").mapInArrow(
        _cut, "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<s: bigint, e: bigint>>, kept_sha256 string"
    )
    keys = docs.select("id", "row_key", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
    none = F.array().cast("array<struct<s: bigint, e: bigint>>")
    whole = keys.join(spans.select("row_key"), "row_key", "left_anti").select("id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), none.alias("spans"), "kept_sha256")
    return touched.unionByName(whole)
