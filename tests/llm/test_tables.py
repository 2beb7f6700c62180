import base64
import collections
import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxlens.llm import mixing, queries, warc
from tests.oracle import compare, duck

from .cases import TEXTS, documents, low_words, table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name in queries.ORACLES:
        assert compare(name, df, duck(FOLDER), queries.ORACLES[name]) is None
    else:
        assert df.count() > 0


# --- archive


def test_archive_round_trip(spark, tmp_path):
    pages = [(3, "http://a", "<p>é</p>"), (1, "http://b\r\nX: y", "<p>é</p>"), (2, None, None), (5, "u", ""), (4, "u", "WARC-Type: revisit\r\n"), (None, "n", "<p>é</p>"), (None, None, "alone"), (7, "u", "x" * 400_000), (7, "u", "x" * 400_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    warc.write_archive(df, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, h in pages:
        first[h or ""] = min((x for x in (i, first.get(h or "")) if x is not None), default=None)
    for r in got:
        text = bytes(r.payload).decode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        assert (r.type == "response") == (r.refers_to is None)
        if r.type == "revisit":
            assert r.refers_to == first[text]
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        assert head + b"\r\n\r\n" == bytes(r.header) and block == (b"" if r.type == "revisit" else bytes(r.payload)) + b"\r\n\r\n"
        assert f"Content-Length: {len(block) - 4}" in head.decode()
    assert collections.Counter(bytes(r.payload).decode() for r in got) == collections.Counter(h or "" for _, _, h in pages)
    assert collections.Counter(bytes(r.payload).decode() for r in got if r.type == "response") == collections.Counter({h or "" for _, _, h in pages})
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == len(first)


def test_archive_limits_and_faults(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id bigint, url string, html string")
    warc.write_archive(df, str(tmp_path / "m"), min_revisit_bytes=3, hot_groups=2)
    assert [(r.id, r.type, r.refers_to) for r in warc.read_archive(spark, str(tmp_path / "m")).orderBy("id").collect()] == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]
    warc.write_archive(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0
    spark.createDataFrame([(bytearray(b"no"), bytearray(b"such"), 1)], "digest binary, payload binary, n bigint").write.mode("append").parquet(str(tmp_path / "m/payloads"))
    headers = spark.read.parquet(str(tmp_path / "m/headers"))
    headers.withColumn("digest", F.lit(bytearray(b"no"))).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc._rebuilt(spark.read.parquet(str(tmp_path / "bad")), spark.read.parquet(str(tmp_path / "m/payloads"))).collect()


# --- mixing


def shares(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated sharing out of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    open_ = [s for s in names if sizes[s] > 0]
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], cap * sizes[s])
        open_ = [s for s in open_ if target[s] < cap * sizes[s]]
    return target


@pytest.mark.parametrize("rows", [TEXTS, [(i, "w " * (1 + i % 7), f"s{i % 5 if i % 3 else 0}") for i in range(900)], [(1, "a b", "x"), (2, "c " * 1000, "y"), (3, None, "z")]])
def test_mix_meets_its_targets(spark, rows):
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.id, r.size) for r in got) == collections.Counter((i, low_words(t)) for i, t, _ in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += low_words(t)
    want, taken, most = shares(dict(sizes)), collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.times * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        repeats = collections.Counter((i, t) for i, t, x in rows if x == s).most_common(1)[0][1]
        assert abs(taken[s] - want[s]) <= most[s] * repeats
    again = mixing.mix(table(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_rows_and_empty(spark):
    df = table(spark)
    taken = collections.Counter()
    for r in mixing.mix(df).collect():
        taken[r.id, r.size] += r.times
    rows = mixing.mixed_rows(df)
    assert rows.columns == df.columns
    assert collections.Counter((r.doc_id, low_words(r.text)) for r in rows.collect()) == +taken
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("text is null")).filter("taken > 0").count() == 0


# --- pipeline


def test_pipeline_stages(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, FOLDER)
        seen[name] = out.collect()
        if name != "pieces":
            assert out.columns == docs.columns
            at = spark.createDataFrame(seen[name], docs.schema)
    start = {r.doc_id: r for r in docs.collect()}
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    kept = {r.doc_id for r in seen["quality"]}
    assert good <= kept and len(bad & kept) <= 0.2 * len(bad)
    last = {}
    for r in seen["quality"]:
        key = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in seen["exact"]) == sorted(last.values())
    from .test_dedup import near_by_force

    rows = [(r.doc_id, r.text, r.source) for r in seen["exact"]]
    want = {c for (_, _, c) in near_by_force(rows, 5, (80, 100))}
    assert sorted(r.doc_id for r in seen["near"]) == sorted(want)
    times = {r.id: r.times for r in mixing.mix(spark.createDataFrame(seen["near"], docs.schema)).collect()}
    assert collections.Counter(r.doc_id for r in seen["mixture"]) == +collections.Counter(times)
    assert all(r.round_trip and r.decoded_sha256 == hashlib.sha256(start[r.doc_id].text.encode()).hexdigest() for r in seen["pieces"])
    assert collections.Counter(r.doc_id for r in seen["pieces"]) == +collections.Counter(times)


def test_stages_take_awkward_rows(spark):
    at = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, FOLDER)
        assert stage(spark, at.limit(0), FOLDER).count() == 0
        if name != "pieces":
            at = spark.createDataFrame(out.collect(), at.schema)
    assert os.path.isdir(FOLDER) and out.count() > 0
