"""The conversation trie against plain Python over awkward rows and over deep, wide and tiny trees."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlens.llm.conversation_trie import conversation_trie, rolled_up

from .cases import CLASH

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The nodes by plain Python over whole conversations."""
    given = {}
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            given.setdefault(conv, []).append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    turns = {c: [t for _, _, t in sorted(v)] for c, v in given.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c - np.fmod(c, 5))
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[b] for b in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(node)))
        up = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), up, len(convs), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows, small):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    df = df.select("*", *[F.lit("x").alias(c) for c in CLASH + ["conv", "pos", "depth", "pid", "len", "k1"]])
    return [tuple(r) for r in conversation_trie(df, small).select(*COLUMNS).collect()]


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def awkward():
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None, "é漢"])) for c in range(-7, 40) for t in range(r.randint(1, 7))]
    rows += [(40, None, "user", "null turn"), (40, 1, None, None), (40, 1, "user", "tie"), (40, 1, "user", "tie"), (40, 1, "x", "tie"), (41, 1, "user", "alone"), (None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(43, t, "user", "x" * 30_000 if t == 3 else "y") for t in range(12)]
    return rows


def deep():
    """One conversation with most turns, others that fork from it."""
    return [(0, t, "user", f"t{t % 3}") for t in range(150)] + [(c, t, "user", f"t{t % 3}" if t < 4 * c else f"own{c}") for c in (1, 2, 3, 4, 6) for t in range(20)]


@pytest.mark.parametrize("rows, small", [(awkward(), 1 << 16), (awkward(), 8), (deep(), 40), ([], 10), ([(3, 1, "user", "x")], 1)], ids=["awkward", "split", "deep", "empty", "one"])
def test_trie_matches_plain_python(spark, rows, small):
    same(found(spark, rows, small), plain(rows))


def test_conversations_without_turns_end_at_the_root(spark):
    rows = [(c, 1, "user", "only") for c in range(1, 60) if c % 5]
    got = found(spark, rows, 1 << 16)
    same(got, plain(rows))
    assert next(r for r in got if r[1] == 0)[3] == len(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_centroids_add_up_subtrees(shape):
    r, n = random.Random(shape), 700
    parent = np.array([-1] + [{"chain": i - 1, "star": 0, "random": r.randrange(i), "forest": r.randrange(max(0, i - 4), i) if i % 50 else -1}[shape] for i in range(1, n)])
    values = np.array([[r.randrange(10), r.randrange(1000)] for _ in range(n)])
    mass, want, top = np.array([r.randrange(1, 5) for _ in range(n)]), values.copy(), np.arange(n)
    for i in range(n - 1, 0, -1):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
            mass[parent[i]] += mass[i]
    for i in range(n):
        top[i] = i if parent[i] < 0 else top[parent[i]]
    assert (rolled_up(parent, top, mass, values) == want).all()
