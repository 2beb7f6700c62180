"""Near duplicates: fast similarity sketches, banding, exact verification on full shingle sets, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, maybe_in, row_hash, rows_kept, staged, whole_text
from .shingles import mix, shingle_numbers, shingle_sets, similarity_sketch, word_true_sets
from .token_files import slices

ROWS = 5
#: about so many sets of a bucket lead in the first round, and STEP times as many in each further one
LEADS, STEP = 2, 8


def bands_for(similarity: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    """Bands of ``rows`` coordinates that miss a pair of this similarity with at most the probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1_000_000):
                numbers, starts = shingle_numbers(part.column(0), width)
                sketch = similarity_sketch(np.ascontiguousarray(numbers[:, 0]), starts, bands * rows).reshape(len(part), bands, rows)
                keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), sketch.shape[:2])
                for i in range(rows):
                    keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + sketch[:, :, i])
                ids = [hashlib.blake2b(numbers[i:j].tobytes(), digest_size=16).digest() for i, j in zip(starts.tolist(), starts[1:].tolist())]
                sizes = np.diff(starts)
                flat, offsets = keys.astype(np.int64).reshape(-1), np.arange(len(part) + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(sizes), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    [*part.schema.names[1:], "n_shingles", "set_id", "bands"],
                )

    return run


def _verify(width: int, share: tuple[int, int]):
    part_of, whole = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2_000_000):
                sets = word_true_sets(pa.concat_arrays([part.column(2), part.column(3)]), width)
                linked = []
                for a, b in zip(sets[: len(part)], sets[len(part) :]):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    linked.append(whole * both >= part_of * (len(a) + len(b) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _elements(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4, 1_000_000):
                elements, starts = shingle_sets(part.column(4), width)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(elements.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], lists], ["a", "set_id", "n", "low", "elements"])

    return run


def best_pivots(led: DataFrame) -> DataFrame:
    """``bucket, pivot``: for each bucket of ``led`` (bucket, set_id, a) the leader with most sets that any of its sets has met, which names a group of buckets.

    A pair that shares a bucket is in one group, however groups are drawn; a family in one group is compared with one core.
    """
    followers = led.select("a", "set_id").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("met"))
    best = join_groups(led.select("a", "set_id"), followers, "a", "met").groupBy("set_id").agg(F.max(F.struct("met", "a")).alias("best"))
    return led.select("bucket", "set_id").join(best, "set_id").groupBy("bucket").agg(F.max("best").alias("best")).select("bucket", F.col("best.a").alias("pivot"))


def deviations(open_sets: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """``a, set_id, n, low, size, inside, good, extra, missing``: each open set by what tells it from the core of its group.

    ``open_sets`` (a, set_id, n, low) gives each set its group ``a`` and the least size ``low`` a partner there may have.  The core, of
    ``size`` shingles, holds those that more than half of the group's sets have, which need not be a set of the table: it lies in
    the middle of a family whatever each member has lost.  ``inside`` counts a set's shingles in the core, ``extra`` are its others, and
    ``missing`` are the core's that it lacks, or null where a set has so little in the core that any partner shares an extra one.
    """
    part_of, both = share[0], share[0] + share[1]
    found = open_sets.join(texts, "set_id").select("a", "set_id", "n", "low", "text")
    sets = staged(found.mapInArrow(_elements(width), "a binary, set_id binary, n bigint, low bigint, elements array<bigint>"), "near-elements")
    members = sets.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    often = sets.select("a", F.explode("elements").alias("element")).groupBy("a", "element").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    cores = often.join(members, "a").filter("2 * often > members").groupBy("a").agg(F.collect_list("element").alias("core"))
    groups = staged(members.join(cores, "a", "left").select("a", "members", F.coalesce("core", F.array().cast("array<bigint>")).alias("core")), "near-cores")
    extra, size = F.array_except("elements", "core"), F.size("core").cast("bigint")
    rows = join_groups(sets, groups, "a", "members").select("a", "set_id", "n", "low", "elements", "core", size.alias("size"), extra.alias("extra"))
    rows = rows.withColumn("inside", F.col("n") - F.size("extra")).withColumn("good", both * F.col("inside") - part_of * F.col("n"))
    missing = F.when(both * F.col("inside") >= part_of * (F.col("n") + F.col("low")), F.array_except("core", "elements"))
    return staged(rows.select("a", "set_id", "n", "low", "size", "inside", "good", "extra", missing.alias("missing")), "near-apart")


def best_of_groups(apart: DataFrame) -> DataFrame:
    """``a, best, best_good``: of each group the set that lies closest to its core."""
    best = apart.filter("missing IS NOT NULL").groupBy("a").agg(F.max(F.struct("good", "set_id")).alias("best"))
    return best.select("a", F.col("best.set_id").alias("best"), F.col("best.good").alias("best_good"))


def meetings(apart: DataFrame, best: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``a, set_id, n, size, inside, good, lacks, element, left``: where two similar sets meet that the core alone does not decide.

    Write i for what a set has in the core of k shingles.  Two sets share at least i + i' - k shingles there, so those for which that is enough
    (``good`` + ``good``' >= both * k) are similar for certain, and the best set of the group is similar to either.  Any others that are similar share an
    extra shingle or miss one in common.  Ordered by rarity, all that they share of a kind lies behind the first common one, so there neither
    may have too few ``left``: see ``may_link``.  Shingles that one set alone has or misses meet nobody.
    """
    part_of, both = share[0], share[0] + share[1]
    told = ["a", "set_id", "n", "low", "size", "inside", "good"]
    extra = apart.select(*told, F.lit(False).alias("lacks"), F.explode("extra").alias("element"))
    rows = extra.unionByName(apart.select(*told, F.lit(True).alias("lacks"), F.explode("missing").alias("element")))
    common = staged(rows.groupBy("a", "lacks", "element").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "near-common")
    met = join_groups(rows, common, ["a", "lacks", "element"], "often")
    behind = Window.partitionBy("a", "set_id", "lacks").orderBy(F.desc("often"), F.desc("element"))
    met = met.withColumn("left", F.row_number().over(behind).cast("bigint")).join(best.select("a", "best_good"), "a", "left")
    shares = both * (F.col("left") + F.col("inside")) >= part_of * (F.col("n") + F.col("low"))
    lacking = F.col("good") + F.col("best_good") + both * F.col("left") >= both * F.col("size")
    return met.filter(F.when(F.col("lacks"), lacking).otherwise(shares)).select("a", "set_id", "n", "size", "inside", "good", "lacks", "element", "left")


def may_link(share: tuple[int, int]) -> Column:
    """Whether two sets may be similar that share at most ``left`` and ``left_a`` extra shingles, or miss at most as many in common and share no extra one."""
    part_of, both = share[0], share[0] + share[1]
    left = both * F.least("left", "left_a")
    shares = left + both * F.least("inside", "inside_a") >= part_of * (F.col("n") + F.col("n_a"))
    return F.when(F.col("lacks"), left + F.col("good") + F.col("good_a") >= both * F.col("size")).otherwise(shares)


def verified(pairs: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """``a, b, linked`` of pairs of set ids, decided on the words of the full shingle sets of both texts."""
    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verify(width, share), "a binary, b binary, linked boolean")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``set_id, label`` with one label for each connected component.

    ``labels`` gives every set's label so far, the id of a set that carries itself as its label; ``links`` are new pairs
    of sets.  Links are lifted to labels; then each round every label takes the least one among its neighbours, and what
    it points to is followed to its own, until nothing changes.
    """
    a = labels.select(F.col("set_id").alias("a"), F.col("label").alias("x"))
    b = labels.select(F.col("set_id").alias("b"), F.col("label").alias("y"))
    edges = links.join(a, "a").join(b, "b").filter("x <> y").select("x", "y").distinct()
    edges = staged(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "near-edges")
    if edges.limit(1).count() == 0:
        return labels
    names = staged(edges.select(F.col("x").alias("v")).distinct().withColumn("to", F.col("v")), "near-names")
    while True:
        least = edges.join(names.select(F.col("v").alias("y"), "to"), "y").groupBy(F.col("x").alias("v")).agg(F.min("to").alias("near"))
        stepped = names.join(least, "v").select("v", F.col("to").alias("was"), F.least("to", "near").alias("to"))
        stepped = staged(stepped, "near-step")
        onward = stepped.select(F.col("v").alias("to"), F.col("to").alias("further"))
        new = staged(stepped.join(onward, "to").select("v", "was", F.least("to", "further").alias("to")), "near-names")
        names = new.select("v", "to")
        if new.filter("was <> to").limit(1).count() == 0:
            break
    moved = names.select(F.col("v").alias("label"), "to")
    return labels.join(moved, "label", "left").select("set_id", F.coalesce("to", "label").alias("label"))


def several_labels(rest: DataFrame, labels: DataFrame) -> DataFrame:
    """``rest`` with label, size and size of the label's part of each bucket, without buckets of one label."""
    marked = rest.drop("label", "members", "of_label").join(labels, "set_id")
    sizes = marked.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("of_label"))
    mixed = sizes.groupBy("bucket").agg(F.sum("of_label").alias("members"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").drop("labels")
    return marked.join(mixed, "bucket").join(sizes, ["bucket", "label"])


def linked_sets(mates: DataFrame, sets: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """``set_id, label``: the components of the sets under verified links.

    ``mates`` (bucket, set_id, copies) lists buckets of two or more sets.  First each member of a bucket is compared with its leader,
    the set with most copies; that joins large groups in linear time.  Sets left in buckets of several components are told by their ``deviations``
    from the core of a group.  Those that the core alone makes similar are compared with the best set of their group, one pair for each set.  All
    others go on to buckets of single deviations that similar sets must have in common (``meetings``); most of them meet nobody there,
    which settles them without a partner.  Then only buckets that still hold sets of different components are gone through, in rounds: a few
    members lead, drawn by hash, more of them in each round, and are compared with every member of another component that ``may_link``.  It ends when
    each pair that shares a bucket is linked, in one component, or refuted (by counts alone where those do not allow it).
    """
    fits = share[1] * F.least("n", "n_a") >= share[0] * F.greatest("n", "n_a")  # sets of other sizes cannot be similar enough
    leader = mates.groupBy("bucket").agg(F.min(F.struct(-F.col("copies"), F.col("set_id"), F.col("n"))).alias("lead")).select("bucket", F.col("lead.set_id").alias("a"), F.col("lead.n").alias("n_a"))
    pairs = staged(mates.join(leader, "bucket").filter("a <> set_id").filter(fits).select("a", F.col("set_id").alias("b")).distinct(), "near-pairs")
    done = staged(verified(pairs, texts, width, share), "near-verified")
    labels = staged(components(sets.select("set_id", F.col("set_id").alias("label")), done.filter("linked")), "near-labels")
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    seen = staged(done.filter("NOT linked").select(least, most).distinct(), "near-seen")
    pivots = leader.join(mates.groupBy("bucket").agg(F.min("n").alias("least")), "bucket")
    rest = several_labels(mates.select("bucket", "set_id", "n").join(leader.select("bucket", F.col("a").alias("set_id")), ["bucket", "set_id"], "left_anti"), labels)
    led = staged(rest.select("bucket", "set_id", "n").join(pivots, "bucket"), "near-led")
    low = F.greatest("least", F.ceil(F.col("n") * share[0] / share[1])).alias("low")
    sets_of = led.join(best_pivots(led), "bucket").select("pivot", "set_id", "n", low).groupBy(F.col("pivot").alias("a"), "set_id")
    open_sets = staged(sets_of.agg(F.min("n").alias("n"), F.min("low").alias("low")), "near-open")
    apart = deviations(open_sets, texts, width, share)
    best = staged(best_of_groups(apart), "near-best")
    near = apart.filter("missing IS NOT NULL").select("a", "set_id", "size", "good").join(best, "a").filter(F.col("good") + F.col("best_good") >= sum(share) * F.col("size"))
    to_best = near.join(labels, "set_id").join(labels.select(F.col("set_id").alias("best"), F.col("label").alias("label_a")), "best").filter("label <> label_a")
    done = staged(verified(to_best.select(F.col("best").alias("a"), F.col("set_id").alias("b")).distinct(), texts, width, share), "near-verified")
    labels = staged(components(labels, done.filter("linked")), "near-labels")
    # from here on a bucket holds sets of one group that meet in an extra or missing shingle
    kept = ["bucket", "set_id", "n", "size", "inside", "good", "lacks", "left"]
    rest = staged(meetings(apart, best, share).withColumn("bucket", F.xxhash64("a", "lacks", "element")).select(*kept), "near-meetings")
    fits = fits & may_link(share)
    leads_each, turn = LEADS, 0
    while True:
        rest = staged(several_labels(rest, labels), "near-open")
        if rest.limit(1).count() == 0:
            return labels
        turn += 1
        # the same sets lead in all their buckets, so that a pair meets but once or twice
        rank = F.pmod(F.xxhash64(F.lit(turn), "set_id"), F.lit(1 << 30))
        first = rest.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "set_id")).alias("first")).select("bucket", F.col("first.set_id").alias("first_id"))
        drawn = rank * F.col("members") < F.lit(leads_each << 30)
        leads = rest.join(first, "bucket").filter(drawn | (F.col("set_id") == F.col("first_id"))).select("bucket", F.col("set_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "inside", "good", "left", "label")])
        leads = staged(leads, "near-leads")
        pairs = rest.join(leads, "bucket").filter("label <> label_a").filter(fits).select(F.least("a", "set_id").alias("a"), F.greatest("a", "set_id").alias("b")).distinct()
        new = staged(pairs.join(seen, ["a", "b"], "left_anti"), "near-pairs")
        done = staged(verified(new, texts, width, share), "near-verified")
        labels = staged(components(labels, done.filter("linked")), "near-labels")
        seen = staged(seen.unionByName(done.filter("NOT linked").select(least, most)), "near-seen")
        rest = rest.select(*kept).join(leads.select("bucket", F.col("a").alias("set_id")), ["bucket", "set_id"], "left_anti")
        leads_each *= STEP


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per input row: ``id, row_key, n_shingles, component_id, kept``.

    Rows are linked if their sets of ``width``-word shingles (words lower-cased A-Z, cut at blanks, tabs and line ends) have a
    Jaccard similarity of at least ``share``; ``component_id`` is the smallest id in a row's connected component, and the
    row that has it is kept.  A text of fewer words has its whole sequence as its one shingle; a text without words (or
    null) has none and stands alone.  Null ids count as larger than any other; a component of nothing but null ids keeps one row of them.
    Rows that repeat an id in one component keep the one of least row key; rows that repeat id and text share key and decision.
    An empty table gives an empty result.  Columns other than id and text are not read.

    Rows with equal sets are one set throughout, so copies never make pairs; sets are equal if a 16-byte digest of all their shingles, themselves
    mixed from 16-byte digests of words, agrees.  Candidates share one of ``bands_for``
    bands, which misses a pair at the threshold with a probability of at most one in a million; each is verified on the
    words of the full sets.
    """
    bands = bands_for(share[0] / share[1])
    docs = df.select(whole_text(text_col).alias("text"), F.col(id_col).cast("bigint").alias("id"), row_hash(F.col(id_col), whole_text(text_col)).alias("row_key"))
    members = staged(docs.mapInArrow(_sketch(width, bands, ROWS), "id bigint, row_key binary, n_shingles bigint, set_id binary, bands array<bigint>"), "near-members")
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row_key").alias("row_key"))
    filled = members.filter("n_shingles > 0")
    sets = staged(filled.groupBy("set_id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n")), "near-sets")
    chosen = sets.select("set_id", F.col("first.row_key").alias("row_key"), "copies", "n")
    one_each = filled.select("row_key", "set_id", "bands").join(chosen, ["row_key", "set_id"])
    # rows that repeat id and text come twice here
    placed = one_each.select("set_id", "copies", "n", F.explode("bands").alias("bucket")).groupBy("bucket", "set_id").agg(F.max("copies").alias("copies"), F.max("n").alias("n"))
    crowded = staged(placed, "near-buckets")
    shared = crowded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    mates = staged(crowded.join(shared, "bucket"), "near-mates")
    wanted = mates.select("set_id").distinct().join(chosen, "set_id").select("row_key", "set_id")
    texts = staged(maybe_in(docs.select("row_key", "text"), "row_key", wanted).join(wanted, "row_key").dropDuplicates(["set_id"]).select("set_id", "text"), "near-texts")
    labels = linked_sets(mates, sets, texts, width, share)
    firsts = sets.join(labels, "set_id")
    least = firsts.groupBy("label").agg(F.min("first").alias("least"))
    named = firsts.join(least, "label").select("set_id", "copies", F.col("least.id").alias("component_id"), F.col("least.row_key").alias("component_key"))
    grouped = join_groups(filled.drop("bands"), staged(named, "near-named"), "set_id", "copies")
    alone = members.filter("n_shingles = 0").select("id", "row_key", "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    kept = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("component_key"))
    return grouped.select("id", "row_key", "n_shingles", "component_id", kept.alias("kept")).unionByName(alone)


def keep_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``df`` that stay, whole and with all their columns: one of each component, and all without words."""
    return rows_kept(df, row_hash(F.col(id_col), whole_text(text_col)), near_dedup(df, id_col, text_col, width, share))
