"""Token ids in Parquet list columns, in document order, with metadata that can be read without the ids."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_in_order, whole_text, with_amount_before

SCHEMA = "id bigint, n_tokens bigint, ids array<int>"
#: texts with other or adjacent white space, or white space at an end, are cut more carefully
ODD = "[\\t\\v\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$"
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
CACHE_LIMIT, CACHE_BYTES = 500_000, 64 << 20
MARKS = ".,;:!?"
#: a blank or none and letters (of blocks that Unicode has filled for long): one token of the pre-tokenizer, whatever its tables
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
WORD, MARKED = f"^ ?[{_LETTER}]+$", f"[0-9{_LETTER}][{MARKS}]$"
#: the letters in which a byte-level BPE writes the 256 bytes: printable ones stand for themselves
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}
#: One encoder for each Python worker and vocabulary file
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts.  The pre-tokenizer of a byte-level BPE never joins characters across a single blank or line feed
    that stands between two others, so a text may be cut before each of those; equal pieces are encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.line = self.ids_of("\n")
        self.marks = np.array([self.ids_of(m)[0] for m in MARKS], np.int32)
        self.forget()

    def forget(self) -> None:
        """Remembered pieces as one Arrow array; the ids of piece i are ``sizes[i]`` of ``flat`` from ``starts[i]`` on."""
        self.names = pa.array([], pa.string())
        self.flat, self.sizes, self.starts, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.turn = 0

    def remember(self, names: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.flat, self.sizes = np.concatenate((self.flat, flat)), np.concatenate((self.sizes, sizes))
        self.used = np.concatenate((self.used, np.full(len(sizes), self.turn)))

    def thin(self) -> None:
        """Too many pieces: the half that was asked for last stays."""
        if self.names.nbytes > CACHE_BYTES:
            self.forget()
        elif len(self.names) > CACHE_LIMIT:
            stay = np.sort(np.argsort(self.used, kind="stable")[-CACHE_LIMIT // 2 :])
            names, used, sizes, flat = self.names.take(pa.array(stay)), self.used[stay], self.sizes[stay], self.ids_at(stay)
            turn = self.turn
            self.forget()
            self.remember(names, flat, sizes)
            self.used, self.turn = used, turn

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        """The ids of the pieces at these places, one after the other."""
        each = self.sizes[places]
        before = np.cumsum(each) - each
        # a slice has far fewer than 2^31 ids, so positions fit 32 bits
        at = np.repeat((self.starts[places] - before).astype(np.int32), each)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at]

    def pieces(self, text: str) -> list[str]:
        """The text cut into pieces; a line feed between two words is a piece of its own, written as the empty string."""
        out = []
        for piece in CUT.split(text):
            out += ["", piece[1:]] if piece[:1] == "\n" and len(piece) > 1 and not piece[1:2].isspace() else [piece]
        return out

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where the distinct ``pieces`` are remembered; those never met are encoded first.

        A mark after a letter or digit is a token of its own, so it is split off before.
        """
        self.turn += 1
        self.thin()
        found = pc.index_in(pieces, value_set=self.names)
        out = found.fill_null(-1).to_numpy().astype(np.int64)
        new = out < 0
        if new.any():
            names = pieces.filter(pa.array(new))
            marked = pc.match_substring_regex(names, MARKED)
            stems = pc.if_else(marked, pc.utf8_slice_codeunits(names, 0, -1), names).dictionary_encode()
            of_stem = pc.index_in(stems.dictionary, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)
            strange = of_stem < 0
            order, *learnt = self.fresh(stems.dictionary.filter(pa.array(strange)))
            of_stem[np.flatnonzero(strange)[order]] = len(self.names) + np.arange(len(order))
            self.remember(*learnt)
            place, marked = of_stem[stems.indices.to_numpy()], marked.to_numpy(zero_copy_only=False)
            ends = names.filter(pa.array(marked))
            sizes = self.sizes[place[marked]] + 1
            flat, last = np.empty(sizes.sum(), np.int32), np.cumsum(sizes) - 1
            own = np.ones(len(flat), bool)
            own[last] = False
            flat[own] = self.ids_at(place[marked])
            flat[last] = self.marks[pc.index_in(pc.utf8_slice_codeunits(ends, -1), value_set=pa.array(list(MARKS))).to_numpy()]
            place[marked] = len(self.names) + np.arange(len(ends))
            self.remember(ends, flat, sizes)
            out[new] = place
        self.used[out] = self.turn
        return out

    def fresh(self, stems: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """The stems' order in which the rest is given, names, ids one after the other and how many each has.

        Plain words go to the model of the vocabulary at once, all others through the whole tokenizer.
        """
        plain = pc.match_substring_regex(stems, WORD).to_numpy(zero_copy_only=False)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        names = stems.take(pa.array(order))
        listed, n = names.to_numpy(zero_copy_only=False).tolist(), int(plain.sum())
        flat, sizes = self.words(listed[:n])
        others = self.others(listed[n:])
        more = np.fromiter(map(len, others), np.int64, len(others)) // 4
        return order, names, np.concatenate((flat, np.frombuffer(b"".join(others), "<i4"))), np.concatenate((sizes, more))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are one token of the pre-tokenizer each, one after the other, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        merge = self.model.tokenize
        found = [[t.id for t in merge(w)] for w in "\n".join(words).encode().decode("latin-1").translate(LETTERS).split(LETTERS[10])]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, sizes.sum()), sizes

    def others(self, pieces: list[str]) -> list[bytes]:
        # many pieces in one call: a line feed before each new one is an id of its own
        joined = [len(self.line) == 1 and bool(p) and "\n" not in p and not p[-1].isspace() and not p[:2].isspace() for p in pieces]
        lines = [p for p, j in zip(pieces, joined) if j]
        found: list[bytes] = []
        for at in range(0, len(lines), 5_000):
            ids = np.array(self.ids_of("\n".join(lines[at : at + 5_000]) + "\n"), "<u4")
            ends = np.flatnonzero(ids == self.line[0])
            raw, starts = ids.tobytes(), np.concatenate(([0], ends[:-1] + 1))
            found += [raw[s:e] for s, e in zip((starts * 4).tolist(), (ends * 4).tolist())]
        rest = iter(found)
        return [next(rest) if j else self.bytes_of(p) if p else self.bytes_of("\n") for p, j in zip(pieces, joined)]

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def bytes_of(self, text: str) -> bytes:
        return np.array(self.ids_of(text), "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has.

        Cutting and finding the distinct pieces run over the whole array at once; Python sees each distinct piece once.
        """
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if odd.any():
            return self.encode_odd(texts, odd)
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\n\n"), " ", "\n "), "\n")
        words = cut.values.dictionary_encode()
        place = self.places(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum(self.sizes[place])
        flat = self.ids_at(place)
        offsets = cut.offsets.to_numpy()
        run = np.concatenate(([0], ends))
        counts = run[offsets[1:]] - run[offsets[:-1]]
        # an empty text is cut into one empty piece, which stands for a line feed elsewhere
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        return (flat, counts) if not empty.any() else (flat[~np.repeat(empty, counts)], np.where(empty, 0, counts))

    def encode_odd(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As above where some texts hold other or adjacent white space: those are cut one by one."""
        plain = self.encode(texts.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        cut = [[""] if t == "\n" else self.pieces(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        words = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
        place = self.places(words.dictionary)[words.indices.to_numpy()]
        ends = np.concatenate(([0], np.cumsum(self.sizes[place])))[np.cumsum([len(c) for c in cut])]
        found = iter(np.split(self.ids_at(place), ends[:-1]))
        rest = iter(np.split(plain[0], np.cumsum(plain[1])[:-1]) if len(plain[1]) else [])
        parts = [next(found) if o else next(rest) for o in odd]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


def slices(batch: pa.RecordBatch, column: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text, whatever the length of its rows."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    at = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches:
            for part in slices(batch, 1, 12_000_000):
                flat, counts = encoder.encode(part.column(1))
                sizes = counts + 1
                values = np.empty(len(flat) + len(sizes), np.int32)
                last = np.cumsum(sizes) - 1
                own = np.ones(len(values), bool)
                own[last] = False
                values[own], values[last] = flat, end_id
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids], ["id", "n_tokens", "ids"])

    return run


def write_token_files(df: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000) -> None:
    """Encodes every text and writes ``id, n_tokens, ids`` in ascending id order as Parquet files under ``path``.

    Each document ends with ``end_id``.  Ids are dictionary encoded (delta or plain pages where a dictionary would not
    pay); row groups, pages and rows per page are bounded so that page indexes skip what a read of some ids does not need.
    Null text counts as empty and gives the end id alone; null ids come first; rows that repeat an id are ordered by
    text; repeated rows are all written.  An empty table writes files without rows.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), whole_text(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows),
    }
    ordered.mapInArrow(_encode(vocabulary, end_id), SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``id, n_tokens, ids`` of the documents from ``first`` to ``last``; pages outside are skipped by their index."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    rows = rows if first is None else rows.filter(F.col("id") >= first)
    return rows if last is None else rows.filter(F.col("id") <= last)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        cuts = (lists.offsets.to_numpy() * 4).tolist()
        crc = [zlib.crc32(raw[s:e]) for s, e in zip(cuts, cuts[1:])]
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes), pa.array(crc, pa.int64())], ["id", "file_no", "row_index", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, from the files alone; ``start`` counts the ids before it."""
    rows = read_in_order(spark, path, SCHEMA)
    read = rows.select("ids", "id", "file_no", "row_index").mapInArrow(_crc, "id bigint, file_no bigint, row_index bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("file_tokens"))
    return with_amount_before(read, F.col("n_tokens"), "start", totals=sizes.select("file_no", F.col("file_tokens").alias("_t"))).select("id", "start", "n_tokens", "ids_crc32")
