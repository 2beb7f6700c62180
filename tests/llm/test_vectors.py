"""Vector codes against plain Python over awkward rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from boxlens.llm.vector_codes import Slices, vector_codes, written_books

from .cases import CLASH

INF, NAN = float("inf"), float("nan")


def plain(rows, parts=8, entries=16, rounds=6):
    """(id, code, error, label_error) of each kept row and the final entries, by plain Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [[math.floor(4096 * x) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, part: min((far(part, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(near(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(mine[k]) for x in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    out = [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label]) for (i, _, label), f, e in zip(kept, found, errors)]
    return out, ",".join(str(v) for b in books for e in b for v in e)


def made(spark, rows):
    df = spark.createDataFrame([(i, v, label) for i, v, label in rows], "vec_id bigint, embedding array<float>, label int").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH + ["id ", "code", "error", "vector"]])


def exact(rows):
    """Numbers as a float column holds them."""
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def sample(seed, n, width):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) for _ in range(width)], r.choice([1, 1, 1, 2, None])) for i in range(n)]


def test_codes_match_plain_python(spark):
    rows = sample(1, 120, 16)
    rows += [(7, rows[3][1], 2), (7, rows[3][1], 2), (None, rows[5][1], None), (200, None, 1), (201, [1.0, None], 1), (202, [NAN] * 16, 2), (203, [INF] + [0.0] * 15, 2), (204, [], 3), (205, [0.5], 3)]
    rows = exact(rows)
    found, books = vector_codes(made(spark, rows))
    want, entries = plain(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)
    assert written_books(books) == entries


def test_few_rows_lengths_that_do_not_divide_and_ties(spark):
    rows = exact([(3, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.5], None)])
    found, books = vector_codes(made(spark, rows), parts=2, entries=2, rounds=2)
    want, entries = plain(rows, 2, 2, 2)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and written_books(books) == entries


def test_empty_table_and_table_without_sound_rows(spark):
    for rows in ([], [(1, None, 1), (2, [NAN], 2)]):
        found, books = vector_codes(made(spark, rows))
        assert found.collect() == [] and books == []


def test_masks_hold_what_lies_in_the_box_and_the_first_radius_changes_nothing():
    r = np.random.default_rng(5)
    book, x = r.integers(-50, 50, (16, 3)), r.integers(-80, 80, (500, 3))
    s = Slices(book)
    for radius in (1, 7, 40):
        want = (np.abs(x[:, None] - book[None]).max(axis=2) <= radius) @ (1 << np.arange(16))
        assert (s.within(x, radius).astype(np.int64) == want).all()
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    for radius in (1, 5, 1000):
        code, error = s.nearest(x, radius)
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


def test_large_numbers_are_held(spark):
    found, _ = vector_codes(made(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 2)]), entries=1, rounds=1)
    assert found.count() == 3
