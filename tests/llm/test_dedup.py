import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxlens.llm import near_dedup as near
from boxlens.llm import suffix_dedup as suffix
from boxlens.llm.exact_dedup import exact_dedup, keep_exact
from boxlens.llm.shingles import shingle_numbers, shingle_sets, similarity_sketch, word_true_sets

from .cases import LOWER, TEXTS, documents, table


def low(t):
    return (t or "").translate(LOWER)


def test_exact_groups(spark):
    got = exact_dedup(table(spark)).collect()
    assert len(got) == len(TEXTS)
    groups = collections.defaultdict(list)
    for i, t, _ in TEXTS:
        groups[low(t)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, hashlib.sha256(t.encode()).hexdigest(), keep, len(ids)) for i in ids)
    assert collections.Counter((r.id, r.digest.hex(), r.keep_id, r.group_size) for r in got) == want
    kept = collections.Counter(r.digest for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_compares_content_where_digests_collide(spark):
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1).cast("binary")
    plain, weakly = (exact_dedup(table(spark), digest=d).select("id", "row_key", "keep_id", "group_size").collect() for d in (lambda t: F.unhex(F.sha2(t, 256)), weak))
    assert sorted(map(str, plain)) == sorted(map(str, weakly))


def test_exact_hot_group_and_rows(spark):
    rows = [(i, "Same" if i % 3 == 0 else f"text {i % 40}", "s") for i in range(600)]
    got = exact_dedup(documents(spark, rows), hot_groups=10, salts=4)
    assert got.filter("digest = unhex(sha2('same', 256))").select("keep_id", "group_size").distinct().collect() == [(597, 200)]
    stay = keep_exact(documents(spark, rows))
    assert stay.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    best = {}
    for i, t, _ in rows:
        best[low(t)] = max(i, best.get(low(t), -1))
    assert sorted(r.doc_id for r in stay.collect()) == sorted(best.values())


def test_keep_exact_keeps_whole_awkward_rows(spark):
    df = table(spark)
    got = keep_exact(df)
    assert got.columns == df.columns
    assert collections.Counter(low(r.text) for r in got.collect()) == collections.Counter({low(t) for _, t, _ in TEXTS})


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def near_by_force(rows, width, share):
    sets = [shingles(t, width) for _, t, _ in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and share[1] * both >= share[0] * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[root(i)] = min((d for d in (d, least.get(root(i))) if d is not None), default=None)
    return collections.Counter((rows[i][0], len(sets[i]), least[root(i)] if sets[i] else rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize("width,share", [(3, (85, 100)), (5, (80, 100))])
def test_near_components(spark, width, share):
    got = near.near_dedup(table(spark), width=width, share=share).collect()
    assert collections.Counter((r.id, r.n_shingles, r.component_id) for r in got) == near_by_force(TEXTS, width, share)
    assert all(r.kept for r in got if r.n_shingles == 0)
    assert all(r.id == r.component_id for r in got if r.kept)


def chain(n, step):
    """Texts that drift: neighbours are near, the ends are not; and a crowd around one of them that is near to nothing else."""
    words = [f"w{i}" for i in range(4000)]
    return [(i, " ".join(words[i * step : i * step + 300]), "s") for i in range(n)]


def test_near_chains_and_crowds_are_followed(spark, monkeypatch):
    monkeypatch.setattr(near, "LEADS", 1)
    rows = chain(20, 12) + [(100 + i, " ".join([f"t{k}" for k in range(200)] + [f"u{i}_{k}" for k in range(2 * i)]), "s") for i in range(30)]
    got = near.near_dedup(documents(spark, rows), width=3, share=(85, 100)).collect()
    assert collections.Counter((r.id, r.n_shingles, r.component_id) for r in got) == near_by_force(rows, 3, (85, 100))


def test_near_families_of_many_edits_lose_no_link(spark):
    """Members of a family differ from its middle by more and by fewer edits than the threshold allows; edits recur."""
    draw = random.Random(5)
    rows = []
    for family in range(2):
        base = [f"b{family}_{i}" for i in range(150)]
        for i in range(110):
            words = list(base)
            for _ in range(draw.randrange(3, 9)):
                words[draw.randrange(0, 150, 12)] = draw.choice(["x", "y", ""])
            rows.append((family * 1000 + i, " ".join(w for w in words if w), "s"))
    got = near.near_dedup(documents(spark, rows), width=3, share=(85, 100)).collect()
    assert collections.Counter((r.id, r.n_shingles, r.component_id) for r in got) == near_by_force(rows, 3, (85, 100))


def test_near_families_of_strangers_are_settled_by_their_deviations(spark, monkeypatch):
    """Members of a family around a text that is not there, most of them near to no other: few pairs are tried, and no link is lost."""
    draw, rows, tried = random.Random(7), [], []
    base = [f"b{i}" for i in range(150)]
    for i in range(260):
        words = list(base)
        for at in draw.sample(range(150), draw.choice([2, 3, 3, 4, 4, 5])):
            words[at] = draw.choice(["x", "y", "z"])
        rows.append((i, " ".join(words), "s"))
    verified = near.verified

    def counted(pairs, *more):
        tried.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(near, "verified", counted)
    want = near_by_force(rows, 5, (80, 100))
    got = near.near_dedup(documents(spark, rows), width=5, share=(80, 100)).collect()
    assert collections.Counter((r.id, r.n_shingles, r.component_id) for r in got) == want
    assert 50 < len({c for _, _, c in want}) < 250
    # the first are those with the leaders of buckets
    assert sum(tried[1:]) < 3 * len(rows)


def test_keep_near_and_empty_tables(spark):
    df = table(spark)
    stay = near.keep_near(df)
    assert stay.columns == df.columns
    ids = sorted((r.doc_id for r in stay.collect() if r.doc_id is not None))
    assert 1 in ids and 2 not in ids and 4 not in ids and 13 in ids and 14 not in ids and 7 in ids and 8 in ids
    empty = df.limit(0)
    for f in (exact_dedup, near.near_dedup, suffix.suffix_dedup, keep_exact, near.keep_near):
        assert f(empty).count() == 0


def test_sketch_estimates_similarity():
    texts = pa.array([" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 1000), (100, 1100), (0, 1000), (5000, 6000), (0, 1))])
    elements, starts = shingle_sets(texts, 1)
    assert starts.tolist() == [0, 1000, 2000, 3000, 4000, 4001]
    s = similarity_sketch(elements, starts, 400)
    assert (s[0] == s[2]).all()
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.08
    assert (s[0] == s[3]).mean() < 0.02


def removed_by_force(rows, length, first_stays):
    data = [(t or "").encode() for _, t, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5(b"").hexdigest()))
    count = collections.Counter(d[q : q + length] for d in data for q in range(len(d) - length + 1))
    seen, out = set(), {}
    for i in order:
        d, spans = data[i], []
        own = []
        for q in range(len(d) - length + 1):
            s = d[q : q + length]
            if (s in seen) if first_stays else count[s] > 1:
                if spans and q <= spans[-1][1]:
                    spans[-1][1] = q + length
                else:
                    spans.append([q, q + length])
            if first_stays:
                seen.add(s)
            own.append(s)
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + d[at:s], e
        kept += d[at:]
        out[i] = (rows[i][0], len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    return collections.Counter(out.values())


def _rows(found):
    return collections.Counter((r.id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found.collect())


@pytest.mark.parametrize("hot", [256, 0])
@pytest.mark.parametrize("length", [200, 50])
def test_suffix_all_copies_go(spark, monkeypatch, hot, length):
    monkeypatch.setattr(suffix, "HOT", hot)
    assert _rows(suffix.suffix_dedup(table(spark), length=length, first_stays=False)) == removed_by_force(TEXTS, length, False)


@pytest.mark.parametrize("hot", [256, 0])
def test_suffix_first_copy_stays(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    # one row for each id: which of two texts under one id comes first is up to the row key
    rows = list({i: (i, t, s) for i, t, s in TEXTS}.values())
    assert _rows(suffix.suffix_dedup(table(spark, rows), length=60)) == removed_by_force(rows, 60, True)


def test_words_that_cancel_in_powers_of_a_base_are_told_apart(spark):
    """The Thue-Morse word over a and b and its complement differ everywhere, yet polynomials modulo 2^64 take them for one."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, word, "s"), (2, word.translate(str.maketrans("ab", "ba")), "s"), (3, word, "s")]
    got = {r.id: r.component_id for r in near.near_dedup(table(spark, rows), width=3, share=(85, 100)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("width", [1, 3, 5])
def test_word_true_sets_by_force(width):
    r = random.Random(width)
    texts = ["", " \t", "a", "A b", "a b", "ab", "a b a b a b a b", "É a\x0bb\x00 c d e f"] + [" ".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(40)]
    sets, want = word_true_sets(pa.array(texts), width), [shingles(t, width) for t in texts]
    numbers, starts = shingle_numbers(pa.array(texts), width)
    assert [len(s) for s in sets] == [len(w) for w in want] == np.diff(starts).tolist()
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])
            same = numbers[starts[i] : starts[i + 1]].tobytes() == numbers[starts[j] : starts[j + 1]].tobytes()
            assert same == (want[i] == want[j])


def test_previous_and_next_factors_by_force():
    r = np.random.default_rng(5)
    rows, position = r.integers(97, 99, (300, 6)).astype(np.uint8), r.permutation(300) * 7
    earlier, elsewhere = suffix.previous_matches(rows, position)
    for i in range(300):
        same = [j for j in range(300) if j != i and (rows[j] == rows[i]).all()]
        assert elsewhere[i] == bool(same)
        assert earlier[i] == any(position[j] < position[i] for j in same)


@pytest.mark.parametrize("hot", [256, 0])
def test_strings_that_cancel_in_powers_of_a_base_are_told_apart(spark, monkeypatch, hot):
    """Two tails whose difference is a product of x^(2^i) - 1: a polynomial modulo 2^64 takes them for one."""
    monkeypatch.setattr(suffix, "HOT", hot)
    steps = [1]
    for top in (7, 5, 3):
        for i in range(top):
            steps = np.convolve(steps, [-1] + [0] * (2**i - 1) + [1])
    r = random.Random(9)
    steps = [int(d) for d in steps] + [0] * (176 - len(steps))
    head, tail = "".join(r.choice("abcdefgh") for _ in range(200)), [r.randint(max(1, 1 - d), min(127, 127 - d)) for d in steps]
    rows = [(1, head + bytes(tail).decode(), "s"), (2, head + bytes(c + d for c, d in zip(tail, steps)).decode(), "s")]
    got = _rows(suffix.suffix_dedup(documents(spark, rows), length=200, first_stays=False))
    assert got == removed_by_force(rows, 200, False) and {k[2] for k in got} == {200}
