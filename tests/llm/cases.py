"""Awkward rows for every operator: nulls in any column, empty and very long texts, repeated rows, clashing column names."""

import random

from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n)).replace("\n ", "\n")


BASE, OTHER = prose(220, 1), prose(150, 2)
LONG = prose(30_000, 3)
TEXTS = [
    (1, BASE, "a"), (2, BASE.upper(), "a"), (3, BASE, None), (4, BASE + " tail", "b"), (5, "start " + BASE, "b"), (6, OTHER, "b"),
    (7, None, "a"), (8, "", "a"), (9, " \t\n", None), (10, "one", "c"), (11, "One", "c"), (12, "one two", "c"), (13, LONG, "a"), (14, LONG[:90_000] + "x" + LONG[90_000:], "c"),
    (15, "É ß 漢字 ▁   x y  two  blanks \n\n\tend\r\n", "d"), (16, "a\x00b\x00\x00c " * 60, "d"), (17, OTHER.replace(" ", "  "), "d"), (6, OTHER, "b"), (6, OTHER, "b"),
    (6, OTHER + " another", "b"), (None, OTHER, "a"), (None, None, None), (None, "", None), (None, "", None), (18, "x" * 5000, "a"), (19, "Und " * 900, "a"), (20, OTHER[:400] + BASE[:500], None),
]
CLASH = ["id", "row_key", "kept", "digest", "set_id", "part", "size", "u", "bands", "row_no", "_slot", "key", "bucket", "mix_n", "spans"]


def table(spark, rows=TEXTS):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], schema).repartition(3)
    return df.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASH])


def documents(spark, rows=TEXTS):
    return table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")


def low_words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
