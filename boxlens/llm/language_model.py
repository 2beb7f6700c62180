"""A word model by deleted interpolation: maximum-likelihood estimates mixed by context frequency, weights learned on documents set aside.

Counts cover all training documents and are never held in one place.  Texts are coded in blocks of bounded size; a block asks for the corpus-wide counts of
its distinct words and word pairs, and then scores its texts on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text
from .shingles import mix

#: characters of text in one block, but for a longer single text
BLOCK = 10_000_000
HELD, FIT, TUNE = 0, 1, 2
ROUNDS = 12
BUCKETS = 65
_HASH_PAIR = np.uint64(0x9FB21C651E98DF25)
BLOCK_SCHEMA = "block bigint, ids array<bigint>, parts array<int>, sizes array<int>, codes binary, words binary"
ASK_SCHEMA = "bucket bigint, block bigint, words binary, word_counts binary, keys binary, pair_counts binary"
TOLD_SCHEMA = "block bigint, bucket bigint, words binary, pairs binary"
TRIED = "both bigint, context bigint, word bigint, n bigint"
FACT_SCHEMA = f"block bigint, ids array<bigint>, parts array<int>, sizes array<int>, codes binary, words binary, word_counts binary, pair_counts binary, fit bigint, tokens bigint, types bigint, tried array<struct<{TRIED.replace(' bigint', ':bigint')}>>"


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: small numbers cost little."""
    wide = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, 8).T
    return len(wide.T).to_bytes(8, "little") + pa.compress(wide.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_words(words: list[str]) -> bytes:
    """Words, which hold no line feeds, one to a line."""
    raw = "\n".join(words).encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked_words(data: bytes) -> list[str]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return raw.decode("utf-8", "surrogatepass").split("\n")


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all texts with an end after each, how many tokens each has, and the words; the end has the last number."""
    plain = pc.replace_substring_regex(pc.ascii_lower(texts), "[\\t\\n\\v\\f\\r]", " ")
    split = pc.split_pattern(plain, " ")
    flat = split.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
    before = np.concatenate(([0], np.cumsum(filled)))[offsets]
    words = flat.filter(pa.array(filled)).dictionary_encode()
    numbers, n = np.asarray(words.indices), len(texts)
    sizes = np.diff(before)
    codes = np.full(len(numbers) + n, len(words.dictionary), np.int32)
    order = np.argsort(-np.bincount(numbers, minlength=len(words.dictionary)), kind="stable")  # frequent words have small numbers
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    codes[np.arange(len(numbers)) + np.repeat(np.arange(n), sizes)] = rank[numbers]
    return codes, (sizes + 1).astype(np.int32), words.dictionary.take(pa.array(order))


def _blocks(limit: int):
    """Rows of ids, parts and texts as one coded row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names = ["block", "ids", "parts", "sizes", "codes", "words"]

        def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            codes, sizes, words = _coded(table.column(2).combine_chunks())
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            ids, parts = (table.column(i).combine_chunks() for i in range(2))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(ids), one(parts), one(pa.array(sizes)), pa.array([packed(codes.astype(np.int64))], pa.binary()), pa.array([packed_words([*words.to_pylist(), ""])], pa.binary())], names)

        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column(2)), np.int64))
            start = 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit - size, "left")) + 1
                stop = max(start + 1, min(stop, batch.num_rows))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - (ends[start - 1] if start else 0))
                start = stop
                if size >= limit:
                    yield row(held)
                    number, held, size = number + 1, [], 0
        if held:
            yield row(held)

    return run


class Block:
    """The tokens of one block: numbers of words and of the words before them, and the distinct pairs in ascending order of their keys.

    The last word is the empty one, the end.
    """

    def __init__(self, row: dict):
        self.row, self.parts, self.sizes = row, np.array(row["parts"], np.int64), np.array(row["sizes"], np.int64)
        self.codes, self.words = unpacked(row["codes"]).astype(np.int32), unpacked_words(row["words"])
        self.part = np.repeat(self.parts.astype(np.int8), self.sizes)
        self.before = before_each(self.codes, self.sizes, len(self.words))
        self.digest = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in [*self.words, "\n"]), "<u8")
        self.keys, pairs = np.unique(mix(self.digest[self.before] * _HASH_PAIR + mix(self.digest, 7)[self.codes], 8), return_inverse=True)
        self.pairs = pairs.astype(np.int32)

    def counts(self, of: np.ndarray, size: int) -> np.ndarray:
        """How often each number comes in documents to fit on and in documents set aside."""
        return np.stack([np.bincount(of[self.part == p], minlength=size) for p in (FIT, TUNE)])

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words and pairs in the order of their buckets, and the buckets."""
        of_words, of_pairs = (x % np.uint64(buckets) for x in (self.digest[:-1], self.keys))
        spelt = np.argsort(np.array(self.words, object), kind="stable")
        words, pairs = spelt[np.argsort(of_words[spelt], kind="stable")], np.argsort(of_pairs, kind="stable")
        return words, of_words[words], pairs, of_pairs[pairs]


def before_each(codes: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The token before each one; the first of a text has the number ``start`` before it."""
    before = np.concatenate((np.full(1, start, codes.dtype), codes[:-1]))
    before[np.cumsum(sizes) - sizes] = start
    return before


def _asks(buckets: int):
    """What each block counts itself, a row for each bucket that one of its words or pairs falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                words, of_words, pairs, of_pairs = b.dealt(buckets)
                word_counts, pair_counts = b.counts(b.codes, len(b.words))[:, words], b.counts(b.pairs, len(b.keys))[:, pairs]
                used = np.union1d(of_words, of_pairs)
                bounds = [np.append(np.searchsorted(x, used), len(x)) for x in (of_words, of_pairs)]
                rows = []
                for i, bucket in enumerate(used.tolist()):
                    (s, e), (t, f) = ((x[i], x[i + 1]) for x in bounds)
                    keys = b.keys[pairs[t:f]] // np.uint64(buckets)  # the rest is the bucket
                    rows.append((bucket, row["block"], packed_words([b.words[k] for k in words[s:e]]) if e > s else None, packed(word_counts[:, s:e]), packed(np.diff(keys, prepend=np.uint64(0))), packed(pair_counts[:, t:f])))
                    if len(rows) == 256 or i + 1 == len(used):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.binary()] * 4)], ["bucket", "block", "words", "word_counts", "keys", "pair_counts"])
                        rows = []

    return run


def _told(asked: pa.Table) -> pa.Table:
    """Of one bucket: the counts of its words and pairs over all blocks, back to each block in the order it asked.

    Words also say whether this block is the one that counts them as a type.
    """
    rows = asked.to_pylist()

    def totals(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(numbers, weights=c).astype(np.int64)[numbers] if len(numbers) else c for c in counts])

    words = [unpacked_words(r["words"]) if r["words"] is not None else [] for r in rows]
    keys = [np.cumsum(unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    named = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
    numbers = np.asarray(named.indices)
    own = lambda c, sizes: np.concatenate([unpacked(r[c]).reshape(2, n) for r, n in zip(rows, sizes)], axis=1)
    word_totals = totals(numbers, own("word_counts", [len(w) for w in words]))
    first = np.zeros((1, len(numbers)), np.int64)
    first[0, np.unique(numbers, return_index=True)[1]] = 1
    _, pair_numbers = np.unique(np.concatenate(keys), return_inverse=True)
    pair_totals = totals(pair_numbers, own("pair_counts", [len(k) for k in keys]))
    word_cuts, pair_cuts = (np.cumsum([len(x) for x in xs])[:-1] for xs in (words, keys))
    return pa.table({
        "block": asked.column("block"), "bucket": asked.column("bucket"),
        "words": pa.array([packed(x) for x in np.split(np.concatenate((word_totals, first)), word_cuts, axis=1)], pa.binary()), "pairs": pa.array([packed(x) for x in np.split(pair_totals, pair_cuts, axis=1)], pa.binary()),
    })


def _facts(buckets: int):
    """A block with the counts of its words and pairs over all blocks, and what its documents set aside try on the others' estimates."""

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        b, told = Block(blocks.to_pylist()[0]), told.sort_by("bucket")
        word_order, _, pair_order, _ = b.dealt(buckets)
        words, pairs = np.zeros((3, len(b.words)), np.int64), np.zeros((2, len(b.keys)), np.int64)
        back = lambda c, n: np.concatenate([unpacked(x).reshape(n, -1) for x in told.column(c).to_pylist()], axis=1)
        words[:, word_order], pairs[:, pair_order] = back("words", 3), back("pairs", 2)
        # as many texts begin as end
        context = np.append(words[0], words[0, -1])
        mine = b.part == TUNE
        tried, n = np.unique(np.stack([pairs[0][b.pairs[mine]], context[b.before[mine]], words[0][b.codes[mine]]], axis=1), axis=0, return_counts=True)
        count = pa.int64()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        of = lambda *x: pa.array(x, pa.binary())
        seen = words[0] + words[1]
        return pa.table({
            **{c: blocks.column(c) for c in ("block", "ids", "parts", "sizes", "codes", "words")}, "word_counts": of(packed(seen)), "pair_counts": of(packed(pairs.sum(axis=0))),
            "fit": pa.array([int((b.part == FIT).sum())], count), "tokens": pa.array([int((b.part != HELD).sum())], count), "types": pa.array([int(((seen > 0) & (words[2] > 0)).sum())], count),
            "tried": one(pa.StructArray.from_arrays([*(pa.array(c) for c in tried.T), pa.array(n)], ["both", "context", "word", "n"])),
        })

    return run


def mixed(both: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: int, types: int, weights: np.ndarray) -> np.ndarray:
    """Probabilities by the three estimates (pair, word, uniform) under the weights of the context's bucket."""
    bucket = np.searchsorted(1 << np.arange(63, dtype=np.int64), context, "right")
    w = weights[bucket]
    return w[:, 0] * (both / np.maximum(context, 1)) + w[:, 1] * (word / max(tokens, 1)) + w[:, 2] / (types + 1)


def _scores(tokens: int, types: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                words, both = unpacked(row["word_counts"]), unpacked(row["pair_counts"])
                sizes, codes, pairs, context = b.sizes, b.codes, b.pairs, np.append(words, words[-1])
                score = np.empty(len(codes))
                for s in range(0, len(codes), 100_000):
                    part = slice(s, s + 100_000)
                    score[part] = np.log10(mixed(both[pairs[part]], context[b.before[part]], words[codes[part]], tokens, types, weights))
                base = np.log10((words + 0.1) / (tokens + 0.1 * (types + 1)))
                starts = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(x, starts) for x in ((words > 0).astype(np.int64)[codes], base[codes], score)]
                columns = [pa.array(row["ids"], pa.int64()), pa.array(np.array(row["parts"]) == HELD), pa.array(sizes), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def part_of(id_col: Column) -> Column:
    """0: scored only; 1: counted; 2: set aside for the weights, then counted too.  By the crc32 of the id as text; null is empty."""
    crc = F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    return F.when(crc % 10 == 0, HELD).when(F.floor(crc / 10) % 10 == 0, TUNE).otherwise(FIT).cast("int")


def learned_weights(tried: DataFrame, tokens: int, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the three estimates for each bucket of context counts (0, 1, 2-3, 4-7, ...) by expectation-maximisation.

    ``tried`` (both, context, word, n) says how often tokens set aside met which counts of the other documents.  A round gives each
    estimate its share of every token's probability; one token more for each keeps all weights above 0.  An unseen context has no pair estimate.
    Only sums by bucket come to the driver.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    estimates = [F.col("both") / F.greatest("context", F.lit(1)), F.col("word") / F.lit(float(max(tokens, 1))), F.lit(1 / (types + 1))]
    for _ in range(rounds):
        table = F.split(F.lit(",".join(repr(float(w)) for w in weights.ravel())), ",").cast("array<double>")
        shares = [F.get(table, F.col("bucket") * 3 + j) * e for j, e in enumerate(estimates)]
        each = tried.withColumn("bucket", F.when(F.col("context") > 0, F.length(F.bin("context"))).otherwise(0)).select("bucket", "n", *[s.alias(f"s{j}") for j, s in enumerate(shares)])
        whole = F.col("s0") + F.col("s1") + F.col("s2")
        for r in each.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(f"s{j}") / whole).alias(f"s{j}") for j in range(3)]).collect():
            gained = np.array([r.s0 + (r.bucket > 0), r.s1 + 1, r.s2 + 1])
            weights[r.bucket] = gained / gained.sum()
    return weights


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """``id, held_out, n_tokens, n_known, base_score, score`` for each row, and the model: ``tokens``, ``types``, ``weights``.

    Tokens are the words of the whole text, A-Z lower-cased, and one end.  A token's probability mixes c(before, token) / c(before), c(token) / N and 1 / (V + 1);
    the weights depend on c(before) by powers of two.  They are learned on a tenth of the training documents with counts of the others;
    the counts that score are those of all training documents.  The first token of a text follows a start, which counts as often as the end.

    Null texts are empty: an end alone.  Null ids count as the empty text in the choice of training documents.  Repeated rows are documents of
    their own.  An empty table gives an empty result.  A very long text is a block of its own.  Other columns are not read.

    Words are compared as strings.  Pairs are named by 64 bits of BLAKE2b digests: of n distinct pairs, each shares its count with a
    strange one with a probability of n / 2^64, below one in a million up to 10^13 pairs.  A word or pair comes once from each block, so none is hot:
    blocks send theirs to buckets in compressed rows, and get sums back in the order they asked.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), part_of(F.col(id_col).cast("bigint")).alias("part"), whole_text(text_col).alias("text"))
    blocks = staged(rows.mapInArrow(_blocks(block), BLOCK_SCHEMA), "model-blocks")
    # as many buckets as blocks: a bucket holds about as many words and pairs as a block
    buckets = max(1, blocks.select("block").count())
    told = blocks.mapInArrow(_asks(buckets), ASK_SCHEMA).groupBy("bucket").applyInArrow(_told, TOLD_SCHEMA)
    facts = staged(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_facts(buckets), FACT_SCHEMA), "model-facts", compression="zstd")
    sizes = facts.agg(F.sum("fit").alias("fit"), F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = sizes.tokens or 0, sizes.types or 0
    tried = staged(facts.select(F.explode("tried").alias("t")).groupBy("t.both", "t.context", "t.word").agg(F.sum("t.n").alias("n")), "model-tried")
    weights = learned_weights(tried, sizes.fit or 0, types, rounds)
    coded = facts.select("ids", "parts", "sizes", "codes", "words", "word_counts", "pair_counts")
    scored = coded.mapInArrow(_scores(tokens, types, weights), "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored, {"tokens": tokens, "types": types, "weights": weights}
