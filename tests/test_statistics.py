import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlens.functions.hashing import md5_divmod
from boxlens.operators import curves as C
from boxlens.operators import features as X
from boxlens.operators import ranks as R
from boxlens.operators import resample as E
from boxlens.operators import splits as P
from boxlens.operators.matching import evaluate
from boxlens.operators.predicates import row_tags
from boxlens.plans.stand_ins import DETECTORS, Inputs

FOLDER = "/root/testdata/sf0.001"


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [(rng.choice("ab"), 5.0 if rng.random() < 0.34 else rng.expovariate(0.01), rng.random() < 0.4) for _ in range(n)]


def test_percentiles_of_a_skewed_group_are_exact(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, v double, y boolean")
    got = {r.g: r for r in R.exact_percentiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for g in "ab":
        want = np.percentile([v for k, v, _ in rows if k == g], [0, 25, 50, 90, 100])
        assert np.allclose([got[g][c] for c in ("p0", "p25", "p50", "p90", "p100")], want)
    totals = [sorted(map(tuple, R.running_totals(df, ["g"], "v", {"n": F.count("*")}, buckets=b).collect())) for b in (2, 64)]
    assert totals[0] == totals[1]


def test_auc_counts_ties_as_half(spark):
    rows = [("f", float(v), y) for v, y in [(1, True), (1, False), (2, True), (2, False), (2, True), (3, False), (0, True)]]
    pos, neg = [v for _, v, y in rows if y], [v for _, v, y in rows if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    got = R.auc(spark.createDataFrame(rows, "f string, v double, y boolean"), ["f"], "v", F.col("y")).first()
    assert got.auc == pytest.approx(want) and (got.n_pos, got.n_neg) == (4, 3)


def test_kth_largest_and_top_k(spark):
    rows = skewed(500)
    df = spark.createDataFrame(rows, "g string, v double, y boolean").withColumn("id", F.monotonically_increasing_id())
    values = sorted((v for _, v, _ in rows), reverse=True)
    for k in (1, 100, 500):
        assert R.kth_largest(df, "v", k).first().threshold == values[k - 1]
    assert R.kth_largest(df, "v", 501).first().threshold is None
    top = R.salted_top_k(df, ["g"], [F.col("v").desc(), F.col("id")], 7, F.col("id")).collect()
    for g in "ab":
        assert sorted((r.v for r in top if r.g == g), reverse=True) == sorted((v for k, v, _ in rows if k == g), reverse=True)[:7]


def test_ordinals_number_every_group_without_gaps(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 50) END AS g")
    rows = R.ordinals(df, ["g"], 9, "id").collect()
    for g, part in itertools.groupby(sorted(rows, key=lambda r: (r.g, r.ordinal)), key=lambda r: r.g):
        part = list(part)
        assert [r.ordinal for r in part] == list(range(len(part)))
        keys = [hashlib.md5(f"9|{r.id}".encode()).hexdigest() for r in part]
        assert keys == sorted(keys)


def test_split_is_the_running_accumulator(spark):
    df = spark.range(563).selectExpr("id AS image", "concat('s', id % 7) AS source", "concat('g', id % 3) AS grp", "id % 2 AS dmg")
    out = P.stratified_systematic_split(df, ["source", "grp", "dmg"], 0.3, key="image", start=0.25).collect()
    order = sorted(out, key=lambda r: (r.source, r.grp, r.dmg, hashlib.md5(f"20261006|{r.image}".encode()).hexdigest()))
    acc, want = 0.25, []
    for n, r in enumerate(order, 1):
        want.append("test" if int(0.25 + n * 0.3) > int(0.25 + (n - 1) * 0.3) else "dev")
    assert [r.split for r in order] == want
    assert sum(r.split == "test" for r in out) in (168, 169)


def test_md5_divmod_uses_the_whole_digest(spark):
    names = [f"Japan_{i:06d}.jpg" for i in range(50)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    low, pick = md5_divmod(F.md5(F.concat(F.lit("mixed:"), "n")), 10000, 2)
    got = {r.n: (r.a, r.b) for r in df.select("n", low.alias("a"), pick.alias("b")).collect()}
    for n in names:
        h = int(hashlib.md5(("mixed:" + n).encode()).hexdigest(), 16)
        assert got[n] == (h % 10000, h // 10000 % 2)


def test_greedy_filters_equal_a_sequential_search(spark):
    rng = np.random.default_rng(4)
    real = rng.random(400) < 0.4
    cols = {"a": rng.normal(size=400) + real, "b": rng.normal(size=400) - 1.5 * real, "c": rng.normal(size=400)}
    rows = [(int(r), *map(float, v)) for r, *v in zip(real, *cols.values())]
    got = X.greedy_filters(spark.createDataFrame(rows, "real int, a double, b double, c double"), ["a", "b", "c"], cap=0.15)
    keep, used, want = np.ones(400, bool), [], []
    while True:
        best = None
        for k in cols:
            if k in used:
                continue
            r, f = cols[k][keep & real], cols[k][keep & ~real]
            auc = np.mean([(f < v).mean() + 0.5 * (f == v).mean() for v in r])
            t = np.quantile(r, 0.05 if auc >= 0.5 else 0.95)
            gain = (f < t).mean() if auc >= 0.5 else (f > t).mean()
            if gain >= 0.15 and (best is None or gain > best[2]):
                best = (k, t, gain, auc >= 0.5)
        if best is None:
            break
        k, t, gain, low = best
        new = keep & ((cols[k] >= t) if low else (cols[k] <= t))
        if 1 - (new & real).sum() / real.sum() > 0.15:
            break
        keep, used = new, used + [k]
        want.append((k, low, pytest.approx(t), pytest.approx(gain), (keep & real).sum(), (keep & ~real).sum()))
    assert want and [(s["feature"], s["drop_low"], s["threshold"], s["gain"], s["n_real"], s["n_fake"]) for s in got] == want


def test_poisson_and_multinomial_intervals_agree(spark):
    i = Inputs(spark, FOLDER)
    scores = evaluate(i.images, i.det, i.truth, DETECTORS)
    groups = row_tags(i.images.filter("has_gt")).select("tag", "image")
    configs = [(d, "crack", "in50") for d in DETECTORS]
    a, b = (
        {(r.tag, r.detector): r for r in E.bootstrap_ci(E.replicates(scores, groups, configs, 200, method=m)).collect()} for m in ("multinomial", "poisson")
    )
    one = a[("all", "D1")]
    assert one.lo < one.f1 < one.hi
    for k in a:
        width = a[k].hi - a[k].lo
        assert a[k].f1 == pytest.approx(b[k].f1) and abs(a[k].lo - b[k].lo) < width and abs(a[k].hi - b[k].hi) < width


def test_join_path_of_the_bootstrap_equals_the_broadcast_path(spark, monkeypatch):
    i = Inputs(spark, FOLDER)
    scores = evaluate(i.images, i.det, i.truth, DETECTORS)
    groups = row_tags(i.images.filter("has_gt")).select("tag", "image")
    configs = [("D1", "crack", "in50")]
    small = E.replicates(scores, groups, configs, 5)
    rows = small.collect()
    monkeypatch.setattr(E, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, E.replicates(scores, groups, configs, 5).collect())) == sorted(map(tuple, rows))


def test_interpolation_outside_the_curve_is_null(spark):
    curve = spark.createDataFrame([("h", "a", 1.0, 0.2), ("h", "b", 3.0, 0.4), ("p", "c", 2.0, 0.3)], "family string, config string, fake_per_img double, recall double")
    got = {(r.family, r.level): r.recall for r in C.interp_at(curve, [0.5, 2.0, 3.0]).collect()}
    assert got[("h", 0.5)] is None and got[("h", 2.0)] == pytest.approx(0.3) and got[("h", 3.0)] == pytest.approx(0.4) and got[("p", 2.0)] == pytest.approx(0.3)


def test_verdict_table(spark):
    rows = [
        (0.2, 0.1, True, 0.0, False, 2.0, "improvement"), (0.2, 0.0, False, 0.1, True, 0.0, "improvement"), (0.2, -0.1, True, 0.1, True, 0.0, "recall_loss"),
        (0.2, 0.1, False, 0.1, False, 0.0, "no_difference"), (0.05, 0.1, True, 0.0, False, 0.0, "below_precision_floor"),
        (0.2, 0.0, False, 0.1, True, 0.5, "no_difference"), (0.2, 0.1, True, 0.1, True, 0.5, "improvement"),
    ]
    df = spark.createDataFrame(rows, "precision double, delta_recall double, recall_significant boolean, delta_precision double, precision_significant boolean, delta_fake_per_img double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", C.verdict()).collect())


def test_grid_search_treats_hot_images_the_same(spark):
    from boxlens.plans.stats_queries import GRID

    i = Inputs(spark, FOLDER)
    cands = i.det.filter("detector = 'D1'").selectExpr(
        "CASE WHEN image % 3 = 0 THEN 7 ELSE image END AS image", "kind", "did", "x1", "y1", "x2", "y2", "double(did div 10 % 97) AS chroma",
        "greatest(x2-x1, y2-y1)/least(x2-x1, y2-y1) AS aspect", "(y1+y2)/2/440.0D AS rel_y",
    )
    truth = i.truth.withColumn("image", F.expr("CASE WHEN image % 3 = 0 THEN 7 ELSE image END"))
    parts = i.images.selectExpr("image", "CASE WHEN image % 10 < 7 THEN 'tune' ELSE 'val' END AS split")
    grid = GRID[::9]
    a, b = (sorted(map(tuple, X.grid_search(cands, truth, parts, grid, ["rel_y"], limit=n).collect())) for n in (1 << 40, 400))
    assert a == b and len(a) == 2 * len(grid)


def test_one_group_of_many_values_spreads_over_many_tasks(spark):
    df = spark.range(200_000).selectExpr("'g' AS g", "double(id % 150000) AS v")
    cum = R.running_totals(df, ["g"], "v", {"n": F.count("*")}, buckets=16)
    sizes = cum.groupBy(F.spark_partition_id()).count().collect()
    assert cum.count() == 150_000 and cum.agg(F.max("cum_n"), F.min("all_n")).first() == (200_000, 200_000)
    plan = R.exact_percentiles(df, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [g" not in plan and sizes


def test_bootstrap_queries_draw_as_often_as_the_reference():
    from boxlens.plans import stats_queries

    assert stats_queries.N_BOOT >= 1000
    for name in ("E1_bootstrap_ci", "E1_bootstrap_poisson", "E2_bootstrap_compare", "E3_compare_runs", "E4_paired_recall_delta", "E5_bootstrap_two_sample", "E21_verdict", "E22_pick_config"):
        assert "range(1, 1001)" in entry_sql()[name], name


def entry_sql():
    import __spark_entry__

    return __spark_entry__.oracle_sql()


def test_cells_on_a_limit_as_in_sql(spark, tmp_path):
    """Pairs of values 40 apart deviate by 20, the limit of D12_quality_limits: the side depends on how the sum is rounded."""
    from boxlens.plans.catalogue import ORACLES, QUERIES
    from tests.oracle import compare

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("""CREATE TABLE events AS SELECT 500 * (i // 2) + i % 2 AS event_id, 0::BIGINT AS user_id,
        CASE WHEN i % 11 < 9 THEN ((i // 2) * 7919 % 16000 + 4000 * (i % 2)) / 100.0e0 END AS value FROM range(8000) r(i)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert compare("D12", QUERIES["D12_quality_limits"](spark, str(tmp_path)), con, ORACLES["D12_quality_limits"]) is None


def test_many_keys_hash_as_single_ones():
    from boxlens.functions import lanes

    for prefix in (b"20261006|all|17|", b"1|", b"x" * 50 + b"|"):
        for start, stop in ((0, 25), (95, 1203), (9990, 10020), (99_950, 110_050)):
            got = np.concatenate(list(lanes.numbered(prefix, start, stop)))
            assert got.tolist() == [lanes.head(prefix + str(k).encode()) for k in range(start, stop)]
    keys = [str(k).encode() for k in (1, 22, 5, 123456, -4)] + [b"", b"y" * 60]
    ends = [b"|1", b"|22", b"|1000"]
    for end, got in zip(ends, lanes.suffixed(b"20261006|", keys, ends)):
        assert got.tolist() == [lanes.head(b"20261006|" + k + end) for k in keys]


@pytest.mark.parametrize("chunk, block", [(1 << 22, 1 << 16), (64, 16), (1 << 22, 16)])
def test_replicates_over_many_blocks_and_nothing_broadcast(spark, monkeypatch, chunk, block):
    """Draws cut into chunks and blocks give the sums of a plain loop; no side of a join goes through the driver."""
    monkeypatch.setattr(E, "CHUNK", chunk)
    monkeypatch.setattr(E, "BLOCK", block)
    n, n_boot = 203, 7
    scores = spark.range(n).selectExpr("id AS image", "'D1' AS detector", "'crack' AS kind", "'in50' AS criterion", "id % 5 AS tp", "id % 7 AS fp", "id % 3 AS fn", "id AS n_det")
    groups = spark.range(n).selectExpr("id AS image", "explode(array('all', concat('t', id % 2))) AS tag")
    reps = E.replicates(scores, groups, [("D1", "crack", "in50")], n_boot)
    got = {(r.tag, r.b): (r.tp, r.fp, r.fn, r.n_det) for r in reps.collect()}
    want = {}
    for tag, ids in (("all", range(n)), ("t0", range(0, n, 2)), ("t1", range(1, n, 2))):
        order = sorted(ids, key=lambda i: hashlib.md5(f"{E.SEED}|{i}".encode()).hexdigest())
        for b in range(n_boot + 1):
            picks = order if not b else [order[int(int(hashlib.md5(f"{E.SEED}|{tag}|{b}|{k}".encode()).hexdigest()[:13], 16) / 2.0**52 * len(order))] for k in range(len(order))]
            want[tag, b] = (sum(i % 5 for i in picks), sum(i % 7 for i in picks), sum(i % 3 for i in picks), sum(picks))
    assert got == want
    assert "Broadcast" not in reps._jdf.queryExecution().toString()
    drawn = E.draws(spark.createDataFrame([("all", n)], "tag string, n bigint"), ["tag"], n_boot)
    assert drawn.count() <= n_boot * -(-n // min(chunk, n)) * -(-n // block)  # blocks of counts, not a row for each draw


def test_two_sample_counts_ties_nulls_and_unequal_sides(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 32)
    n_boot, rng = 6, random.Random(3)
    rows = [(i, i % 3 == 0, rng.choice([None, 1.0, 2.0, 2.5, 4.0]), float(rng.randrange(6))) for i in range(150)]
    df = spark.createDataFrame(rows, "key bigint, side boolean, a double, c double")
    got = {r.statistic: r for r in E.bootstrap_two_sample(df, "key", "side", {"x": "a", "y": "c"}, n_boot, 2.0).collect()}
    diffs = {"share": [], "auc": []}
    for b in range(n_boot + 1):
        drawn = {}
        for side in (True, False):
            order = sorted((r for r in rows if r[1] == side), key=lambda r: hashlib.md5(f"{E.SEED}|{r[0]}".encode()).hexdigest())
            name = str(side).lower()
            drawn[side] = order if not b else [order[int(int(hashlib.md5(f"{E.SEED}|{name}|{b}|{k}".encode()).hexdigest()[:13], 16) / 2.0**52 * len(order))] for k in range(len(order))]
        share, auc = [], []
        for c in (2, 3):
            share.append(np.mean([r[c] is not None and r[c] >= 2 for r in drawn[True]]) - np.mean([r[c] is not None and r[c] >= 2 for r in drawn[False]]))
            p, q = ([r[c] for r in drawn[s] if r[c] is not None] for s in (True, False))
            auc.append(np.mean([(x > y) + (x == y) / 2 for x in p for y in q]))
        diffs["share"].append(share[1] - share[0])
        diffs["auc"].append(auc[1] - auc[0])
    for name, d in diffs.items():
        assert got[name].delta == pytest.approx(d[0])
        assert (got[name].lo, got[name].hi) == pytest.approx(tuple(np.percentile(d[1:], [2.5, 97.5])))


def test_images_are_not_broadcast_to_the_grid(spark):
    from boxlens.plans.stats_queries import grid_of

    results = grid_of(Inputs(spark, FOLDER))
    assert "BroadcastHashJoin [image" not in results._jdf.queryExecution().toString()
    assert sorted(r.split for r in X.pick_setting(results, 1e9).collect()) == ["tune", "val"]


def test_threshold_sweep_makes_no_row_for_each_cell(spark):
    rng = random.Random(2)
    rows = [(rng.random(), 1 + 4 * rng.random(), box is not None, box) for box in (rng.choice([None, "a", "b", "c", "d"]) for _ in range(60))]
    df = spark.createDataFrame(rows, "area_ratio double, elong double, inside boolean, box string")
    areas, elongs = [i / 10 for i in range(9)] + [2.0], [1 + i / 2 for i in range(8)]
    out = X.threshold_sweep(df, areas, elongs, 5)
    got = {(r.min_area, r.elong_limit): r for r in out.collect()}
    assert len(got) == 80
    for (a, e), r in got.items():
        kept = [x for x in rows if x[0] >= a and x[1] >= e]
        p, q = (sum(x[2] for x in kept) / len(kept) if kept else 0.0), len({x[3] for x in kept} - {None}) / 5
        assert (r.kept, r.purity, r.recall) == (len(kept), pytest.approx(p), pytest.approx(q))
    assert "Expand" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_draws_of_replicates_are_looked_up_where_they_are_made(spark, monkeypatch, slice_bytes):
    """No counts of draws are written or dealt out, whether a tag's rows are one slice or several."""
    def written(*_):
        raise AssertionError("draws are written")

    monkeypatch.setattr(E, "draws", written)
    monkeypatch.setattr(E, "SLICE_BYTES", slice_bytes, raising=False)
    n, n_boot = 90, 5
    scores = spark.range(n).selectExpr("id AS image", "'D1' AS detector", "'crack' AS kind", "'in50' AS criterion", "id % 2 AS tp", "id * 40 AS fp", "-id AS fn", "id << 33 AS n_det")
    groups = spark.range(n + 9).selectExpr("id AS image", "CASE WHEN id % 9 = 4 THEN CAST(NULL AS STRING) WHEN id % 9 < 3 THEN 'a' ELSE 'b' END AS tag")
    groups = groups.unionByName(groups.filter("image < 10"))  # an image may carry a tag twice
    got = {(r.tag, r.b): (r.tp, r.fp, r.fn, r.n_det) for r in E.replicates(scores, groups, [("D1", "crack", "in50")], n_boot).collect()}
    want = {}
    for tag in "ab":
        ids = [i for i in [*range(n), *range(10)] if i % 9 != 4 and (i % 9 < 3) == (tag == "a")]
        order = sorted(ids, key=lambda i: hashlib.md5(f"{E.SEED}|{i}".encode()).hexdigest())
        for b in range(n_boot + 1):
            picks = order if not b else [order[int(int(hashlib.md5(f"{E.SEED}|{tag}|{b}|{k}".encode()).hexdigest()[:13], 16) / 2.0**52 * len(order))] for k in range(len(order))]
            want[tag, b] = (sum(i % 2 for i in picks), sum(i * 40 for i in picks), -sum(picks), sum(i << 33 for i in picks))
    assert got == want


def test_poisson_hashes_an_image_once_for_all_its_tags_and_any_length_of_its_name(spark, monkeypatch):
    """More sets of tags than are held at once, names of four lengths and a tag carried twice; one pass of hashes a replicate over rows of any length."""
    from boxlens.functions import lanes

    passes = []
    states = lanes._states
    monkeypatch.setattr(lanes, "_states", lambda words, n: passes.append(n) or states(words, n))
    assert len(list(lanes.suffixed(b"s|", [b"1", b"22", b"333", b"4444"], [b"|1", b"|22"]))) == 2 and passes == [4, 4]
    monkeypatch.setattr(lanes, "_states", states)
    monkeypatch.setattr(E, "TAG_SETS", 3, raising=False)
    n, n_boot = 130, 6
    scores = spark.range(n).selectExpr("id * id AS image", "'D1' AS detector", "'crack' AS kind", "'in50' AS criterion", "id % 5 AS tp", "id AS fp", "id % 3 AS fn", "1L AS n_det")
    groups = spark.range(n).selectExpr("id * id AS image", "explode(array('all', concat('t', id % 4), concat('u', id % 3), concat('u', id % 2))) AS tag")
    got = {(r.tag, r.b): (r.tp, r.fp, r.fn, r.n_det) for r in E.replicates(scores, groups, [("D1", "crack", "in50")], n_boot, method="poisson").collect()}
    want = {}
    for i in range(n):
        for b in range(n_boot + 1):
            u = int(hashlib.md5(f"{E.SEED}|{i * i}|{b}".encode()).hexdigest()[:13], 16) / 2.0**52
            times = sum(u >= t for t in E.POISSON_UPTO) if b else 1
            for tag in ("all", f"t{i % 4}", f"u{i % 3}", f"u{i % 2}"):
                old = want.get((tag, b), (0, 0, 0, 0))
                want[tag, b] = tuple(o + times * v for o, v in zip(old, (i % 5, i, i % 3, 1)))
    assert got == want
