"""Piece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass over each text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, whole_text
from .token_files import slices

BLANK = "▁"
#: A text falls apart before every run of blanks and around every line feed: no piece spans such a place
CHUNK = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")
CACHE_LIMIT = 150_000
#: A piece model, of one for each Python worker and file
_models: dict[str, PieceModel] = {}


class PieceModel:
    """Pieces, scores and the automaton of a SentencePiece model file.

    The best segmentation is the one with the greatest sum of piece scores; of equal sums, at each position, the longer
    last piece.  A character that no piece covers scores ten below the worst piece and becomes its UTF-8 bytes (or the
    unknown id, in a model without byte pieces).
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.unknown = sp.unk_id()
        self.bytes: dict[int, int] = {}
        worst = 0.0
        longest_join = 0
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                score = sp.get_score(i)
                self.automaton.add_word(piece, (len(piece), score, i))
                worst = min(worst, score) if score > -1e8 else worst
                longest_join = max(longest_join, piece.lstrip(BLANK).count(BLANK) + ("\n" in piece))
        if longest_join:
            raise ValueError("a piece spans a blank or a line feed: such models need another cut")
        self.automaton.make_automaton()
        self.penalty = worst - 10.0
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.cache = Memo(CACHE_LIMIT)

    def segment(self, chunk: str) -> list[int]:
        """Ids of the best segmentation, in a single pass: at each end position the automaton's output links give every piece
        that ends there, and each relaxes the best score of that position."""
        n = len(chunk)
        best = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 0
        for end, (length, score, piece) in self.automaton.iter(chunk):
            while at <= end:  # characters up to here may stand for themselves
                best[at + 1], back[at + 1] = best[at] + self.penalty, (at, -1)
                at += 1
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1] or (total == best[end + 1] and back[end + 1][1] < 0):
                best[end + 1], back[end + 1] = total, (start, piece)
        while at < n:
            best[at + 1], back[at + 1] = best[at] + self.penalty, (at, -1)
            at += 1
        out: list[int] = []
        while n:
            start, piece = back[n]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(chunk[start:n].encode())]
            else:
                out.append(self.unknown)
            n = start
        return out[::-1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text.  Blanks become the blank mark, with one before the text unless it is empty."""
        cut = [CHUNK.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        look = self.cache.filled(set(chain.from_iterable(cut)), lambda new: [np.array(self.segment(c), "<i4").tobytes() for c in new]).__getitem__
        return [b"".join(map(look, c)) for c in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: pieces joined, byte pieces as UTF-8, blank marks as blanks, the first one dropped."""
        pieces, byte_of = self.pieces, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join(map(pieces.__getitem__, ids))
        else:
            text = b"".join(bytes((byte_of[i],)) if i in byte_of else pieces[i].encode() for i in ids).decode("utf-8", "replace")
        return text.replace(BLANK, " ").removeprefix(" ")


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _encode(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                texts = part.column(part.num_columns - 1).to_pylist()
                found = m.encode(texts)
                sizes = np.array([len(b) // 4 for b in found], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                extra = []
                if check:
                    decoded = [m.decode(np.frombuffer(b, "<i4").tolist()) for b in found]
                    extra = [pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()), pa.array([d == t.replace(BLANK, " ") for d, t in zip(decoded, texts)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, *extra], [*part.schema.names[:-1], "ids", *["decoded_sha256", "round_trip"][: len(extra)]])

    return run


def encode_pieces(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """``keep`` columns and the piece ``ids`` of each whole text under the model file at ``path``; row by row, without a shuffle.

    ``check`` decodes the ids again and adds ``decoded_sha256`` and ``round_trip``, whether the text came back.  Null and
    empty text give no ids.  Long texts are encoded whole; repeated rows give repeated results; an empty table gives an
    empty one.  Only the named columns are read.  The ids do not depend on the batch or task a row falls into.
    """
    rows = df.select(*[F.col(c) for c in keep], whole_text(text_col).alias("piece_text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(_encode(path, check), f"{kinds}, ids array<int>" + ", decoded_sha256 string, round_trip boolean" * check)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            flat, cuts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().tolist()
            texts = [m.decode(flat[s:e].tolist()) for s, e in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "decoded"])

    return run


def decode_pieces(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """``keep`` columns and the ``decoded`` text of ``ids``; null ids give an empty text.

    Decoding gives back every text but for U+2581, the model's blank mark, which comes back as a blank.
    """
    rows = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("piece_ids"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(_decode(path), f"{kinds}, decoded string")
