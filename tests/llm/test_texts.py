import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxlens.llm import fingerprints as fp
from boxlens.llm import pii, quality, token_files
from boxlens.llm.pieces import PieceModel, decode_pieces, encode_pieces

from .cases import TEXTS, documents, prose, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


# --- pieces


def viterbi(model, scores, text):
    """Every split of the text, by dynamic programming over all pieces: the greatest sum and the longer last piece."""
    text = "▁" + text.replace(" ", "▁")
    longest = max(map(len, scores))
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - longest), e):
            piece = text[s:e]
            if piece in scores and best[s] + scores[piece] > best[e]:
                best[e], back[e] = best[s] + scores[piece], (s, piece)
        if best[e - 1] + model.penalty > best[e]:
            best[e], back[e] = best[e - 1] + model.penalty, (e - 1, None)
    return best[-1]


def test_pieces_best_and_back(spark):
    model = PieceModel(PIECES)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    r = random.Random(5)
    words = [sp.id_to_piece(r.randrange(300, 32000)).replace("▁", " ") for _ in range(400)]
    for n in range(60):
        text = "".join(r.choice(words) for _ in range(r.randint(1, 12))) + r.choice(["", "\n", "  ", "漢\x00", "é́"])
        ids = np.frombuffer(model.encode([text])[0], "<i4").tolist()
        assert model.decode(ids) == text.replace("▁", " ")
        total, byte_run = 0.0, b""
        for i in ids:
            if i in model.byte_of:
                byte_run += bytes([model.byte_of[i]])
            else:
                total += scores[model.pieces[i]]
        total += model.penalty * len(byte_run.decode())
        assert total == pytest.approx(viterbi(model, scores, text))


def test_pieces_tables(spark):
    df = table(spark)
    got = encode_pieces(df, PIECES, keep=("doc_id", "id"), check=True)
    rows = got.collect()
    assert len(rows) == len(TEXTS) and all(r.round_trip for r in rows)
    back = decode_pieces(got, PIECES).collect()
    assert collections.Counter(r.decoded for r in back) == collections.Counter((t or "").replace("▁", " ") for _, t, _ in TEXTS)
    assert encode_pieces(df.limit(0), PIECES).count() == 0
    assert encode_pieces(df.filter("text = ''"), PIECES).filter("size(ids) > 0").count() == 0


# --- token files


def test_token_files_hold_what_the_library_gives(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    more = [(200, "a<|endoftext|>b", "s"), (201, "it's we'll,no. 1234,5  x", "s"), (202, "\nlead \n trail\n", "s"), (203, "x　y\x85z   end", "s"), (204, "  ", "s"), (205, "a\n b", "s"), (206, "ab,cd. ef;gh", "s")]
    rows = TEXTS + more
    path = str(tmp_path / "t")
    token_files.write_token_files(table(spark, rows), path, BYTES)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at, want = 0, []
    for i, text, _ in ordered:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.token_index(spark, path).orderBy("start").collect()]
    assert got == want
    some = token_files.read_tokens(spark, path, 5, 6).collect()
    assert {r.id for r in some} == {5, 6} and len(some) == sum(i in (5, 6) for i, _, _ in rows)
    assert "PushedFilters: [IsNotNull(id)" in token_files.read_tokens(spark, path, 5, 6)._jdf.queryExecution().toString()
    empty = str(tmp_path / "e")
    token_files.write_token_files(table(spark).limit(0), empty, BYTES)
    assert token_files.token_index(spark, empty).count() == 0


# --- fingerprints


def test_fingerprint_is_a_multiset_hash(spark):
    rows = [(1, "a b. c\nd e\nf", "f\na b. c\nd e", "d e"), (2, "", "", ""), (3, "x\nx\ny", "y\nx\nx", "x")]
    df = spark.createDataFrame(rows, "i int, t string, mixed string, gone string")
    f = fp.fingerprint
    r = df.select("i", (f("t") == f("mixed")).alias("same"), fp.likeness(f("t"), f("mixed")).alias("like")).collect()
    assert all(x.same and x.like == 1.0 for x in r)
    rest = {1: "a b. c\nf", 3: "x\ny"}
    for i, t in rest.items():
        x = df.filter(F.col("i") == i).select(
            (fp.removed(f("t"), f("gone")) == f(F.lit(t))).alias("out"), (fp.added(f(F.lit(t)), f("gone")) == f("t")).alias("back"), (f("t") == f(F.lit(t))).alias("same")
        ).first()
        assert x.out and x.back and not x.same
    long = spark.createDataFrame([("a. b\n" * 100_000,)], "t string").repartition(1).select(fp.fingerprint(F.col("t")).alias("f"))
    assert len(long.first().f) == 51


def test_fingerprint_lanes_and_likeness_by_force(spark):
    vocabulary = [f"Sentence number {i}." for i in range(60)]
    r = random.Random(4)
    rows = [(i, *["\n".join(" ".join(r.choice(vocabulary[: 20 + 8 * (i % 5)]) for _ in range(4)) for _ in range(12)) for _ in range(2)]) for i in range(12)]
    rows += [(100, "É\n\nÉ", "É"), (101, "", "x")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    near = []
    for x in df.select("*", fp.fingerprint(F.col("a")).alias("f"), fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("like")).collect():
        digests = [hashlib.sha256(p.encode()).digest() for p in x.a.split("\n")]
        assert x.f[1:9] == [sum(int.from_bytes(d[4 * k : 4 * k + 4], "big") for d in digests) % 2**32 for k in range(8)]
        u, v = (collections.Counter(re.split(r"\n|(?<=[.!?]) ", t)) for t in (x.a, x.b))
        assert x.f[0] == sum(u.values())
        cosine = sum(u[k] * v[k] for k in u) / math.sqrt(sum(n * n for n in u.values()) * sum(n * n for n in v.values()))
        assert 0 <= x.like < 1 and abs(x.like - cosine) < 0.4
        near.append(x.like - cosine)
    # 126 random signs: a standard error of at most 0.09 each
    assert sum(e * e for e in near) / len(near) < 0.12**2


def test_edited_texts(spark):
    got = fp.compared(table(spark), parts=5).collect()
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = collections.Counter()
    for k, (i, t, _) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()] += 1
    assert collections.Counter((r.id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    halves = {r.id: r for r in fp.compared(documents(spark, [(i, prose(400, i), "s") for i in range(30)]), parts=7).collect()}
    assert sum(r.near_edited > r.near_next + 0.15 for r in halves.values()) >= 28
    assert fp.compared(table(spark).limit(0)).count() == 0
    one = fp.compared(documents(spark, [(5, "abcdef", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0


# --- personal data


@pytest.mark.parametrize("text,spans", [
    ("mail a.b+c@x-y.example.com, or a@b", "email:5:26"),
    ("at 10.0.0.255 not 10.0.0.256 nor 1.2.3", "ip:3:13"),
    ("1.2.3.4.5", "ip:0:7"),
    ("card 4111 1111-1111 1111 and 4111111111111112", "card:5:24"),
    ("call +1 (415) 555-0100 or +12", "phone:5:22"),
    ("+4111111111111111", "card:1:17"),
    ("4111111111111111@x.de", "email:0:21,card:0:16"),
    ("", ""), (None, ""),
])
def test_base_spans(spark, text, spans):
    row = pii.scan(documents(spark, [(1, text, "s")])).select(pii.written(F.col("spans")).alias("s")).first()
    assert row.s == spans


def test_bootstrap_learns_from_context(spark):
    r = random.Random(2)
    rows = [(i, f"{prose(20, i)} write to user{i}@mail.example.org today {prose(9, 900 + i)}", "s") for i in range(40)]
    rows += [(100, "please write to kim7[at]mail today and rest", "s"), (101, "the number 4711-x stands alone here", "s")]
    got = {x.id: x.s for x in pii.scan(documents(spark, rows)).select("id", pii.written(F.col("spans")).alias("s")).collect()}
    assert got[100] == "email:16:28" and got[101] == ""
    assert r and all(got[i].count(",") == 0 and got[i].startswith("email:") for i in range(40))


@pytest.mark.parametrize("base,unseen", [(60, 40), (5, 1), (20, 20), (10, 5)])
def test_bootstrap_finds_many_unseen(spark, base, unseen):
    number = lambda i: f"{210 + i}555{1000 + 37 * i}"
    rows = [(i, f"{prose(9, i)} my phone: {'+1' if i < base else ''}{number(i)} today {prose(9, 900 + i)}", "s") for i in range(base + unseen)]
    # as many words between which numbers of all sorts lie, only some of them found by the base patterns
    rows += [(1000 + i, f"{prose(9, i)} about the +1{number(300 + i)} rest", "s") for i in range(base)]
    rows += [(2000 + i, f"{prose(9, i)} about the {1900 + i} rest", "s") for i in range(base)]
    got = {x.id: x.s for x in pii.scan(documents(spark, rows)).select("id", pii.written(F.col("spans")).alias("s")).collect()}
    assert all(got[i].startswith("phone:") and "," not in got[i] for i in range(base + unseen))
    assert not any(got[2000 + i] for i in range(base))


@pytest.mark.parametrize("text,found", [
    ("phone 212 555 0187 now", ["212 555 0187"]), ("at (212) 555-0187, or (212)555.0187.", ["(212) 555-0187", "(212)555.0187"]),
    ("tel:212 (555) 0187", ["212 (555) 0187"]), ("(212 555 0187)", ["212 555 0187"]), ("4711-x 2020 z9 12", ["4711-x", "2020"]),
    ("2125550187 4155550100", ["2125550187", "4155550100"]), ("4111 1111 1111 1112!", ["4111 1111 1111 1112"]),
    ("x212 555 0187y 12345", ["x212", "0187y", "12345"]), ("1 " * 30 + "2020", ["2020"]),
])
def test_candidates_in_groups(text, found):
    assert [o[3] for o in pii.occurrences(text, pii.base_spans(text))] == found


def test_bootstrap_finds_grouped_numbers(spark):
    rows = [(i, f"{prose(9, i)} my phone +1 {210 + i} 555 {1000 + i} today", "s") for i in range(20)]
    rows += [(100 + i, f"my phone {310 + i} 555 {2000 + i} today", "s") for i in range(9)] + [(200 + i, f"my phone ({410 + i}) 555-{3000 + i} today", "s") for i in range(9)]
    got = {x.id: x.s for x in pii.scan(documents(spark, rows)).select("id", pii.written(F.col("spans")).alias("s")).collect()}
    assert all(got[100 + i] == "phone:9:21" and got[200 + i] == "phone:9:23" for i in range(9))


def test_bootstrap_heeds_contradicting_patterns(spark):
    number = lambda i: f"{210 + i}555{1000 + 37 * i}"
    rows = [(i, f"we saw +1{number(i)} there", "s") for i in range(8)]
    rows += [(100 + i, f"we saw {number(50 + i)} there", "s") for i in range(8)] + [(200 + i, f"the order {number(50 + i)} came", "s") for i in range(8)]
    got = {x.id: x.s for x in pii.scan(documents(spark, rows)).select("id", pii.written(F.col("spans")).alias("s")).collect()}
    assert all(got[i].startswith("phone:") for i in range(8)) and not any(got[100 + i] or got[200 + i] for i in range(8))


def test_pii_awkward_rows(spark):
    assert pii.scan(table(spark)).count() == len(TEXTS) and pii.scan(table(spark).limit(0)).count() == 0


# --- quality


def test_quality_keeps_clean_text(spark):
    good = [(i, prose(60 + i % 50, i), "s") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "$$$ ###" for w in prose(60, 5000 + i).split()), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 3)] + [(1000 + i, 0, 0) for i in range(0, 60, 3)] + [(None, 1, None), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = good + junk + [(5000, None, None), (5001, "", None), (None, None, None)]
    got = quality.resample(table(spark, rows), labels)
    kept = {r.id for r in got.filter("kept").collect()}
    assert kept >= {i for i, _, _ in good} and not kept & {i for i, _, _ in junk}
    assert got.count() == len(rows)
    again = quality.resample(table(spark, rows), labels)
    assert {r.id for r in again.filter("kept").collect()} == kept
    few = quality.resample(table(spark, rows), labels, keep=7)
    best = few.filter("kept").collect()
    assert len(best) == 7 and {r.place for r in best} == set(range(7))
    stay = quality.keep_quality(table(spark, rows), labels)
    assert stay.columns == table(spark, rows).columns and {r.doc_id for r in stay.collect()} == kept


@pytest.mark.parametrize("half", [0, 1])
def test_quality_keeps_good_text_not_labelled(spark, half):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    hidden = {x.doc_id: x.quality for x in labels.filter(F.expr(f"pmod(xxhash64(doc_id), 2) = {half}")).collect()}
    rows = {x.id: x for x in quality.resample(docs, labels.filter(F.expr(f"pmod(xxhash64(doc_id), 2) <> {half}"))).collect()}
    good = [rows[i] for i in hidden if i in rows and hidden[i] == 1]
    assert len(good) >= 25 and max(x.n_features for x in good) > 4000 and all(x.kept for x in good)
    bad = [rows[i] for i in hidden if i in rows and hidden[i] == 0]
    assert len(bad) >= 3 and sum(x.kept for x in bad) <= len(bad) / 2


def test_quality_scores_labels_unseen():
    table = np.array([[4.0, 2.0, 0.0, 7.0], [5.0, 9.0, 3.0, 9.0]])
    found = np.array([0, 0, 3])
    rest = table - np.array([[2.0, 0, 0, 1.0], [0, 0, 0, 0]]) * 2
    assert quality.unseen_sum(found, 2, table, quality.log_ratios(table)) == pytest.approx(quality.log_ratios(rest)[found].sum())
    sizes = np.array([10, 1000, 10, 1000])
    rate, cut = quality.best_line(np.array([-1.0, -100, -5, -500]), sizes, np.array([True, True, False, False]))
    assert -0.5 < rate < -0.1 and cut <= 0


def test_quality_cut_leaves_good_rows(spark):
    s, one = np.arange(101.0), np.arange(101) == 0
    assert quality.best_cut(s, np.zeros(101, bool)) == -np.inf and quality.best_cut(s, one) == -np.inf
    assert quality.best_cut(s, one[::-1]) == 99.5
    assert quality.best_cut(s, np.isin(s, [0, 50])) < 50
    rows = [(i, prose(30, i), "s") for i in range(40)]
    for few in (0, 1):
        labels = spark.createDataFrame([(i, int(i < few)) for i in range(30)], "doc_id bigint, quality int")
        kept = {x.id for x in quality.resample(documents(spark, rows), labels).filter("kept").collect()}
        assert len(kept) == 40 if few == 0 else 0 in kept


def test_quality_by_force_and_empty(spark):
    rows = [(i, prose(30, i), "s") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(20)], "doc_id bigint, quality int")
    got = {r.id: r for r in quality.resample(documents(spark, rows), labels, buckets=64).collect()}
    raw, target = np.ones(64), np.ones(64)
    feats = {i: quality.features(t, 64).astype(int) for i, t, _ in rows}
    for i in feats:
        raw += np.bincount(feats[i], minlength=64)
        target += np.bincount(feats[i], minlength=64) if i < 20 and i % 4 else 0
    w = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert all(got[i].log_weight == pytest.approx(w[f].sum()) and got[i].n_features == len(f) for i, f in feats.items())
    assert quality.resample(table(spark).limit(0), labels).count() == 0
    no_labels = quality.resample(documents(spark, rows), labels.limit(0))
    assert no_labels.filter("kept").count() == len(rows)
    s, g = np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, False, True, True])
    assert quality.best_cut(s, g) == 1.5


def test_remembered_pieces_are_the_library_s_and_plain_words_skip_its_pre_tokenizer(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_LIMIT", 300)
    encoder = token_files.Encoder(BYTES)
    ids_of, seen = encoder.ids_of, []
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeéßñøÀł") for _ in range(draw.randrange(1, 9)))
    mixed = lambda: draw.choice([word, word, lambda: word() + draw.choice(".,;:!?"), lambda: "it's", lambda: "7" + word(), lambda: ",,", lambda: "漢字,", lambda: "Ⅷ.", lambda: "a×b", lambda: "x²!"])()
    for make in (word, mixed, mixed):
        texts = [draw.choice([" ", "\n"]).join(make() for _ in range(60)) for _ in range(40)] + ["", "\n", " two  blanks\n\n", "tab\tend "]
        monkeypatch.setattr(encoder, "ids_of", lambda text: seen.append(len(text)) or ids_of(text))
        flat, counts = encoder.encode(pa.array(texts))
        monkeypatch.setattr(encoder, "ids_of", ids_of)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [ids_of(t) for t in texts]
        if make is word:
            assert sum(seen) < 100
    assert len(encoder.names) < 5000
