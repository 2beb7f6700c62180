"""Homomorphic multiset fingerprints of documents.  DataFrame functions only.

A paragraph (a line) hashes to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, each lane
modulo a power of two.  So the order of paragraphs does not matter, paragraphs can be put in and taken out by adding and
subtracting vectors, and equal multisets of paragraphs have equal fingerprints.

Lanes, held in an array of bigints:

* 0: number of sentences, modulo 2^20,
* 1 to 8: eight lanes modulo 2^32, the eight words of the paragraph's SHA-256: they tell multisets apart.  Texts that nobody chose to
  collide do so with the odds of 256 random bits.  Sums are weaker than the hash against somebody who may choose thousands of
  paragraphs (generalised birthday search, lattice reduction), so equal fingerprints prove nothing against a forger,
* 9 to 50: 126 lanes modulo 2^20, three to a number.  A paragraph adds, for each of its sentences, one random bit to each of
  them.  Twice such a lane less the number of sentences is a sum of random signs, so the angle between two documents' lanes
  estimates the cosine between their multisets of sentences, within about 0.09.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import range_bounds, range_of, whole_text, width

FIELD = 20
SHIFTS = FIELD + 1
#: one bit at the foot of each of three fields of 21 bits, and the bit above each field's 20
FEET = 1 | 1 << SHIFTS | 1 << 2 * SHIFTS
CARRY = FEET << FIELD
KEEP = (1 << 3 * SHIFTS) - 1 & ~CARRY
LOW32 = (1 << 32) - 1
SENTENCE = r"\n|(?<=[.!?])\x20"


def _sum(items: Column, term, keep: int) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: (a + term(x)).bitwiseAND(F.lit(keep)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text, null counting as empty.  An empty text is one empty paragraph."""
    text = whole_text(text)

    def words(h: Column) -> Column:
        return F.array(*[_sum(h, lambda x, i=i: F.conv(F.substring(x, 8 * i + 1, 8), 16, 10).cast("bigint"), LOW32) for i in range(8)])

    def fields(h: Column) -> Column:
        return F.array(*[_sum(h, lambda x, i=i: F.shiftrightunsigned(x, i).bitwiseAND(F.lit(FEET)), KEEP) for i in range(SHIFTS)])

    def of_sentences(s: Column) -> Column:
        return F.concat(F.array(F.size(s).cast("bigint").bitwiseAND(F.lit((1 << FIELD) - 1))), *[_let(_hashes(s, seed), fields) for seed in (4, 5)])

    def of_paragraphs(p: Column) -> Column:
        return _let(F.transform(p, lambda x: F.sha2(x, 256)), words)

    def joined(parts: Column) -> Column:
        signs, sums = parts["signs"], parts["sums"]
        return F.concat(F.slice(signs, 1, 1), sums, F.slice(signs, 2, 2 * SHIFTS))

    signs, sums = _let(F.split(text, SENTENCE, -1), of_sentences), _let(F.split(text, "\n", -1), of_paragraphs)
    return _let(F.struct(signs.alias("signs"), sums.alias("sums")), joined)


def _hashes(items: Column, seed: int) -> Column:
    return F.transform(items, lambda x: F.xxhash64(F.lit(seed), x))


def _lane_modulus(i: Column) -> Column:
    return F.when(i == 0, F.lit((1 << FIELD) - 1)).when(i <= 8, F.lit(LOW32)).otherwise(F.lit(KEEP))


def added(a: Column, b: Column) -> Column:
    """The fingerprint of both documents' paragraphs together: insertion."""
    sums = F.zip_with(a, b, lambda x, y: x + y)
    return F.transform(sums, lambda x, i: x.bitwiseAND(_lane_modulus(i)))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of ``a`` without those of ``b``: deletion."""
    spare = lambda i: F.when(i == 0, F.lit(1 << FIELD)).when(i <= 8, F.lit(1 << 32)).otherwise(F.lit(CARRY))
    lifted = F.transform(a, lambda x, i: x.bitwiseOR(spare(i)))
    return F.transform(F.zip_with(lifted, b, lambda x, y: x - y), lambda x, i: x.bitwiseAND(_lane_modulus(i)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one for equal fingerprints only, else the estimated cosine between the multisets of sentences, below one."""
    span = 1 << FIELD

    def signs(lanes: Column) -> Column:
        field = lambda x, k: F.shiftrightunsigned(x, k * SHIFTS).bitwiseAND(F.lit(span - 1))
        centred = lambda v: F.pmod(v + F.lit(span // 2), F.lit(span)) - F.lit(span // 2)
        each = F.flatten(F.transform(F.slice(lanes, 10, 2 * SHIFTS), lambda x: F.array(*[field(x, k) for k in range(3)])))
        n = F.get(lanes, F.lit(0))
        return F.transform(each, lambda v: centred(2 * v - n).cast("double"))

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    def cosine(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        norm = F.sqrt(dot(x, x) * dot(y, y))
        return F.when(norm > 0, F.least(F.greatest(dot(x, y) / norm, F.lit(0.0)), F.lit(0.999999))).otherwise(F.lit(0.0))

    return F.when(a == b, F.lit(1.0)).otherwise(_let(F.struct(signs(a).alias("x"), signs(b).alias("y")), cosine))


def written(lanes: Column) -> Column:
    """Hex digits of all lanes."""
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def edited_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """``part, copy, key, id, text, edited``: each text, and with its second half replaced by the start of the next document.

    Rows are taken in ascending id, null first, and text among equal ids; after the last comes the first.  The last
    floor(n/2) of n characters give way to as many, or all, of the next text.  Null text counts as empty; the next document of a
    single row is itself; an empty table gives an empty result.

    Ids are cut into ``parts`` ranges.  The first row of each range also goes to the range before, so every row finds its
    neighbour in its own range: one shuffle of the texts, and no task sees more than the ranges dealt to it.
    Rows with ``copy`` are those visitors; whoever reads on drops them.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), whole_text(text_col).alias("text")).withColumn("key", F.coalesce("id", F.lit(-(1 << 63))))
    bounds = range_bounds(rows.select("key"), "key", parts or 4 * width(df.sparkSession))
    n = max(1, len(bounds))
    part = range_of(F.col("key"), bounds)
    least = F.split(F.lit(",".join(map(str, bounds or [0]))), ",").cast("array<bigint>")
    first = F.coalesce(F.get(least, part) == F.col("key"), F.lit(False))
    places = F.when(first, F.array(F.struct(part.alias("part"), F.lit(False).alias("copy")), F.struct(F.pmod(part - 1, F.lit(n)).alias("part"), F.lit(True).alias("copy")))).otherwise(
        F.array(F.struct(part.alias("part"), F.lit(False).alias("copy")))
    )
    dealt = rows.withColumn("place", F.explode(places)).select("id", "key", "text", "place.part", "place.copy")
    w = Window.partitionBy("part").orderBy("copy", "key", "text")
    paired = dealt.withColumn("following", F.lead("text").over(w))
    cut = F.floor(F.char_length("text") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - cut)
    return paired.withColumn("edited", F.concat(kept, F.substring(F.coalesce("following", F.lit("")), F.lit(1), cut))).select("part", "copy", "key", "id", "text", "edited")


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    Fingerprints are arrays of lanes.  See ``edited_with_next`` for the order of rows and for nulls, ties and empty tables.
    """
    rows = edited_with_next(df, id_col, text_col, parts).select(
        "part", "copy", "key", "id", "text", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
    )
    w = Window.partitionBy("part").orderBy("copy", "key", "text")
    following = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(w)).filter(~F.col("copy"))
    return following.select(
        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
