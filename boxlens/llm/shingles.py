"""Word shingles of whole texts as numbers, many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: words whose digests a worker remembers
KNOWN_WORDS = 200_000
_STEP = np.uint64(0xA24BAED4963EE407)
ROOT, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, another for each seed."""
    x = x + np.uint64((seed * ROOT + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64, remembered and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have if size <= 1 << 24 else _powers.get(base, have[: 1 << 20])
    return have[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an array without nulls, and where each starts (one more entry for the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class _Digests(dict):
    """16-byte digests of words; short ones are remembered."""

    def __missing__(self, word: bytes) -> bytes:
        digest = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= 64:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = digest
        return digest


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


_digests = _Digests()


def words_of(texts: pa.Array) -> list[list[bytes]]:
    """The words of each text, A-Z lower-cased, cut at blanks, tabs and line ends."""
    return [t.translate(_LOWER).split() for t in texts.cast(pa.binary()).to_pylist()]


def shingle_numbers(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as rows of two numbers, in the order of the first, and where each set starts (and the end).

    Both numbers are mixed from digests of the words.  A text of fewer words than ``width`` has its whole word sequence as its one
    shingle; a text without words has none.
    """
    lists = words_of(texts)
    words = np.frombuffer(b"".join(_digests[w] for ws in lists for w in ws), "<u8").reshape(-1, 2)
    cuts = np.concatenate(([0], np.cumsum([len(ws) for ws in lists], dtype=np.int64))).tolist()
    n = max(0, len(words) - width + 1)
    grams = np.full((n, 2), width, np.uint64)
    for i in range(width):
        grams = mix(grams * _STEP + words[i : i + n])
    sets = []
    for s, e in zip(cuts, cuts[1:]):
        if e - s >= width:
            own = grams[s : e - width + 1]
            sets.append(own[np.unique(own[:, 0], return_index=True)[1]])
        elif e > s:
            short = np.full((1, 2), e - s, np.uint64)
            for i in range(s, e):
                short = mix(short * _STEP + words[i])
            sets.append(short)
        else:
            sets.append(np.zeros((0, 2), np.uint64))
    starts = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64)))
    return (np.concatenate(sets) if sets else np.zeros((0, 2), np.uint64)), starts


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text as 64-bit numbers, one text after the other, and where each set starts (and the end)."""
    numbers, starts = shingle_numbers(texts, width)
    return np.ascontiguousarray(numbers[:, 0]), starts


def word_true_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The shingle set of each text, with equal numbers for equal word sequences and for no others among the given texts."""
    lists = words_of(texts)
    numbers, sequences = _Numbers(), _Numbers()
    cuts = np.concatenate(([0], np.cumsum([len(ws) for ws in lists], dtype=np.int64))).tolist()
    words = np.fromiter((numbers[w] for ws in lists for w in ws), np.int64, cuts[-1])
    n = max(0, len(words) - width + 1)
    grams = words[:n]
    for i in range(1, width):
        grams = np.unique(grams * len(numbers) + words[i : i + n], return_inverse=True)[1]
    sets = []
    for ws, s, e in zip(lists, cuts, cuts[1:]):
        if e - s >= width:
            sets.append(np.unique(grams[s : e - width + 1]))
        else:
            # negative: a short sequence is no shingle of a longer text
            sets.append(np.array([-1 - sequences[tuple(ws)]] if ws else [], np.int64))
    return sets


def similarity_sketch(elements: np.ndarray, starts: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches of ``t`` coordinates, a row for each set.

    In each of the first t rounds every element goes to a hashed bin with a hashed value; in t further rounds all elements go to
    bin 0, 1 and so on.  A bin keeps the least value of the first round that reaches it, and a set is done when its bins are
    full.  So each coordinate fills for certain, and two sets agree on a coordinate with the probability of their Jaccard similarity.
    """
    sets = len(starts) - 1
    sizes = np.diff(starts)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(sets * t, empty, np.uint64)
    owner = np.repeat(np.arange(sets), sizes)
    open_sets = sizes > 0
    for round_no in range(2 * t):
        if not open_sets.any():
            break
        if not open_sets.all():
            stay = open_sets[owner]
            elements, owner = elements[stay], owner[stay]
        value = mix(elements, 2 * round_no + 1)
        bins = (mix(elements, 2 * round_no + 2) >> np.uint64(32)) % np.uint64(t) if round_no < t else np.full(len(elements), round_no - t, np.uint64)
        place = owner * t + bins.astype(np.int64)
        free = sketch[place] == empty
        np.minimum.at(sketch, place[free], value[free])
        open_sets &= (sketch.reshape(sets, t) == empty).any(axis=1)
    return sketch.reshape(sets, t)
