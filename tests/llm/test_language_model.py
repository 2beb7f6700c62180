"""The word model against plain Python, and its worth on texts with an order of words."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from boxlens.llm.language_model import mixed, score_texts

from .cases import LOWER, TEXTS, table


def part(i):
    crc = zlib.crc32(("" if i is None else str(i)).encode())
    return 0 if crc % 10 == 0 else 2 if crc // 10 % 10 == 0 else 1


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [""]


def bucket(c):
    return c.bit_length()


class Plain:
    def __init__(self, rows, rounds=12):
        count = {1: ({}, {}), 2: ({}, {})}
        for i, text in rows:
            if part(i):
                words, pairs = count[part(i)]
                last = "<start>"
                for t in tokens(text):
                    words[t] = words.get(t, 0) + 1
                    pairs[last, t] = pairs.get((last, t), 0) + 1
                    last = t
        add = lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in a | b}
        self.words, self.pairs = add(count[1][0], count[2][0]), add(count[1][1], count[2][1])
        self.n, self.v = sum(self.words.values()), len(self.words)
        fit, fit_pairs = count[1]
        fit_n = max(1, sum(fit.values()))
        context = lambda c, x: c.get("" if x == "<start>" else x, 0)
        self.weights = {b: [0, 0.5, 0.5] if b == 0 else [1 / 3] * 3 for b in range(65)}
        for _ in range(rounds):
            gained = {}
            for (a, t), n in count[2][1].items():
                b = bucket(context(fit, a))
                p = [w * e for w, e in zip(self.weights[b], (fit_pairs.get((a, t), 0) / max(1, context(fit, a)), fit.get(t, 0) / fit_n, 1 / (self.v + 1)))]
                g = gained.setdefault(b, [float(b > 0), 1.0, 1.0])
                for j in range(3):
                    g[j] += n * p[j] / sum(p)
            for b, g in gained.items():
                self.weights[b] = [x / sum(g) for x in g]

    def p(self, before, t):
        c = self.words.get("" if before == "<start>" else before, 0)
        w = self.weights[bucket(c)]
        return w[0] * self.pairs.get((before, t), 0) / max(1, c) + w[1] * self.words.get(t, 0) / max(1, self.n) + w[2] / (self.v + 1)

    def row(self, i, text):
        ts = tokens(text)
        known = [self.words.get(t, 0) for t in ts]
        base = sum(math.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1))) for c in known)
        return i, part(i) == 0, len(ts), sum(c > 0 for c in known), base, sum(math.log10(self.p(a, t)) for a, t in zip(["<start>", *ts], ts))


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[4], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("block", [16_000_000, 1000])
def test_scores_match_plain_python(spark, block):
    extra = [(i, f"the Cat {'sat' if i % 3 else 'ran'} on mat{i % 7} and word{i}", "z") for i in range(100, 200)]
    rows = [(i, t) for i, t, _ in TEXTS + extra]
    scored, model = score_texts(table(spark, TEXTS + extra), block=block)
    plain = Plain(rows)
    assert (model["tokens"], model["types"]) == (plain.n, plain.v)
    same([tuple(r) for r in scored.collect()], [plain.row(*r) for r in rows])
    np.testing.assert_allclose(model["weights"], [plain.weights[b] for b in range(65)], atol=1e-9)


def test_empty_table_and_no_training_documents(spark):
    assert score_texts(table(spark, []))[0].collect() == []
    only = next(i for i in range(1000) if part(i) == 0)
    row = score_texts(table(spark, [(only, "a b", "x")]))[0].first()
    assert (row.held_out, row.n_tokens, row.n_known, row.base_score) == (True, 3, 0, 0.0) and row.score < 0.001


def test_probabilities_add_up_to_one():
    """Over all tokens and the unknown one, after a seen and after an unseen context."""
    weights = np.tile([0.6, 0.3, 0.1], (65, 1))
    weights[0] = 0, 0.7, 0.3
    words, after = np.array([3, 5, 2, 0]), np.array([2, 1, 0, 0])
    for pairs, c in ((after, 3), (after * 0, 0)):
        assert abs(mixed(pairs, np.full(4, c), words, 10, 3, weights).sum() - 1) < 1e-12


def test_pairs_help_on_held_out_texts(spark):
    r = random.Random(1)
    follow = {f"w{i}": [f"w{r.randrange(50)}" for _ in range(3)] for i in range(50)}

    def text():
        out = ["w0"]
        for _ in range(60):
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    scored, _ = score_texts(table(spark, [(i, text(), "x") for i in range(400)]))
    held = scored.filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    assert held.s / held.n > held.b / held.n + 0.7
