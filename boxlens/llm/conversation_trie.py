"""Conversations as a forest of shared prefixes: nodes, members, and sums over subtrees by centroid decomposition.

Nothing here needs a whole conversation, node or subtree in one task.  Turns are ranked over sorted ranges, prefixes are named by running sums of
turn digests, and subtrees are added up by splitting components at their centroids until each fits one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, staged
from .shingles import mix

#: components of at most so many memberships are finished inside one task
SMALL = 1 << 16
LANE = (1 << 62) - 1
KEY = ["depth", "k1", "k2"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``pos``: the rank of a row among those of its first column in this task, which come together."""
    last, seen = None, 0
    for batch in batches:
        keys = np.asarray(batch.column(0))
        if not len(keys):
            continue
        starts = _runs(keys)
        first = np.repeat(starts, np.diff(np.append(starts, len(keys))))
        pos = np.arange(1, len(keys) + 1) - first
        if last == keys[0]:
            pos[first == 0] += seen
        last, seen = keys[-1], int(pos[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos)], [*batch.schema.names, "pos"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what the turns of a conversation in this task sum up to, before and with each row: ``p1, p2, k1, k2``."""
    last, carried = None, np.zeros(2, np.uint64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, depth = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.uint64)
        digest = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(n, 4)
        starts = _runs(keys)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        out = []
        for lane in range(2):
            own = mix(digest[:, 2 * lane] + mix(digest[:, 2 * lane + 1] + mix(depth, lane), 2), 3) & np.uint64(LANE)
            total = np.cumsum(own)
            before = np.concatenate((np.zeros(1, np.uint64), total[:-1]))
            base = before[starts]
            if last == keys[0]:
                base[0] -= carried[lane]
            upto, ahead = (total - base[run]) & np.uint64(LANE), (before - base[run]) & np.uint64(LANE)
            carried[lane] = upto[-1]
            out += [ahead.astype(np.int64), upto.astype(np.int64)]
        last = keys[-1]
        names = ["p1", "k1", "p2", "k2"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o) for o in out)], [*batch.schema.names, *names])


def _sorted_pass(df: DataFrame, order: list[str], run, added: str, name: str) -> DataFrame:
    """``df`` in ranges of ``order`` through ``run``, stored, with the number of its range in ``pid``."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", " + added
    return staged(ranged.mapInArrow(run, schema), name)


def _carried(rows: DataFrame, key: str, order: str, amounts: list[str], modulus: int | None = None) -> DataFrame:
    """``rows`` with ``add_<amount>``: what the ranges before hold of the conversation that a range goes on with, else null.

    Only the last conversation of a range can go on, so a range gives one row, and their number bounds the broadcast.
    """
    ends = rows.groupBy("pid").agg(F.max(F.struct(*dict.fromkeys([key, order, *amounts]))).alias("last"), F.min(key).alias("first"))
    wide = ends.select("pid", "first", F.col(f"last.{key}").alias("held"), *[F.col(f"last.{a}").cast("decimal(38,0)").alias(a) for a in amounts])
    # a conversation held last by ranges a..b and first in b+1 has its earlier ranges among those that hold it last
    both = wide.select("pid", F.col("held").alias("k"), *amounts).unionByName(wide.filter("first <> held").select("pid", F.col("first").alias("k"), *[F.lit(0).cast("decimal(38,0)").alias(a) for a in amounts]))
    w = Window.partitionBy("k").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda a: F.sum(a).over(w) if modulus is None else F.pmod(F.sum(a).over(w), F.lit(modulus).cast("decimal(38,0)"))
    starts = both.select(F.col("pid").alias("_pid"), F.col("k").alias("_k"), *[total(a).cast("bigint").alias(f"add_{a}") for a in amounts])
    starts = starts.filter(F.col(f"add_{amounts[0]}").isNotNull())
    return rows.join(F.broadcast(starts), (F.col("pid") == F.col("_pid")) & (F.col(key) == F.col("_k")), "left").drop("_pid", "_k")


def kept_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the one it forks from."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(9)).cast("bigint")


def original_turns(df: DataFrame) -> DataFrame:
    """``conv, pos, digest, bytes``: every turn by its rank in its conversation, null turns first and ties by digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = df.select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.octet_length(text).cast("bigint").alias("bytes"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
    ).filter("conv IS NOT NULL")
    ranked = _sorted_pass(turns, ["conv", "turn", "digest"], _ranks, "pos bigint", "trie-turns")
    return _carried(ranked, "conv", "pos", ["pos"]).select("conv", (F.col("pos") + F.coalesce("add_pos", F.lit(0))).alias("pos"), "digest", "bytes")


def forked_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv, depth, digest, bytes, len`` and conversations ``conv, len``, those without turns too.

    A conversation c starts with the first turns of c - c % 5 and goes on with its own behind as many.
    """
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    sizes = sizes.select("conv", "n", kept_turns(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    bases = sizes.filter("conv = base").select("base", F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = staged(sizes.join(bases, "base", "left").select("conv", "base", "n", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-convs")
    own = join_groups(turns.filter((F.col("pos") > kept_turns(F.col("conv"))) | (F.col("conv") % 5 == 0)), convs, "conv", "n")
    own = own.select("conv", F.when(F.col("conv") == F.col("base"), F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes", "len")
    heads = turns.filter((F.col("conv") % 5 == 0) & (F.col("pos") <= 8)).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "digest", "bytes")
    taken_over = heads.join(convs.filter("conv <> base").select("conv", "base", "taken", "len"), "base").filter("depth <= taken")
    return own.unionByName(taken_over.select("conv", "depth", "digest", "bytes", "len")), convs.select("conv", "len")


def prefix_rows(rebuilt: DataFrame) -> DataFrame:
    """Adds to each turn the names of the prefix that ends with it, ``k1, k2``, and of the one before, ``p1, p2``.

    A name is the sum of 62-bit hashes of (depth, digest) in two lanes, so ranges of a conversation sum on their own.
    """
    rows = _sorted_pass(rebuilt.select("conv", "depth", "digest", "bytes", "len"), ["conv", "depth"], _prefixes, "p1 bigint, k1 bigint, p2 bigint, k2 bigint", "trie-prefixes")
    moved = _carried(rows, "conv", "depth", ["k1", "k2"], LANE + 1)
    on = lambda c, a: F.when(F.col(a).isNull(), F.col(c)).otherwise((F.col(c) + F.col(a)).bitwiseAND(F.lit(LANE)))
    return moved.select("conv", "depth", "digest", "bytes", "len", on("k1", "add_k1").alias("k1"), on("k2", "add_k2").alias("k2"), on("p1", "add_k1").alias("p1"), on("p2", "add_k2").alias("p2"))


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix, and the root, with members, children, parent and the memberships below (``mass``).

    A name stands for one prefix only if all its rows have one last turn and one prefix before it; by induction from the root that is
    equality of whole prefixes.  It is checked, and the job stops should two prefixes ever share a name.
    """
    one = lambda c: F.min(c) == F.max(c)
    first = F.when(one("digest") & one("p1") & one("p2"), F.min("conv")).otherwise(F.raise_error(F.lit("two prefixes share a name")).cast("bigint"))
    found = rows.groupBy(*KEY).agg(first.alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("len").alias("lens"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bytes").alias("bytes"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("len").alias("lens")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("k1", "k2")], "conv_id", "n_convs", "lens", *[F.lit(0).cast("bigint").alias(c) for c in ("p1", "p2", "bytes")])
    nodes = staged(found.unionByName(root), "trie-names")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    mass = F.col("lens") - F.col("n_convs") * (F.col("depth") - 1)
    counted = staged(nodes.join(children, KEY, "left").select(*KEY, "p1", "p2", "conv_id", "n_convs", "bytes", F.coalesce("n_children", F.lit(0)).alias("n_children"), mass.alias("mass")), "trie-counted")
    parents = counted.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    inner = join_groups(counted.filter("depth > 0"), parents, ["depth", "p1", "p2"], "size").drop("size")
    return inner.unionByName(counted.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")))


def rolled_up(parent: np.ndarray, top: np.ndarray, mass: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a row for each node) over the subtrees of components that fit this task.

    ``parent`` is a node's position or -1, ``top`` the position of its component's top, ``mass`` the weight of its subtree inside the component.
    Nodes with at least half of their component's mass are the path from the top to the centroid.  The subtree of the
    centroid counts for all of them; then the centroid goes and every piece is a component of its own.
    """
    out, mass, parent, top = values * 0, mass.copy(), parent.copy(), top.copy()
    left = np.arange(len(parent))
    while len(left):
        whole = mass[top[left]]
        path = left[2 * mass[left] >= whole]
        order = np.lexsort((mass[path], top[path]))
        centre_of = np.full(len(parent), -1)
        firsts = path[order][_runs(top[path][order])]
        centre_of[top[firsts]] = firsts
        centre = centre_of[top[left]]
        under = (parent[left] == centre) & (parent[left] >= 0)
        # every node follows its parents to the top of its piece
        jump = np.arange(len(parent))
        jump[left] = np.where(under | (top[left] == left), left, parent[left])
        while True:
            further = jump[jump[left]]
            if (further == jump[left]).all():
                break
            jump[left] = further
        piece = jump[left]
        lower = np.zeros(len(parent), bool)
        lower[left[under]] = True
        below = lower[piece] | (left == centre)
        totals = np.zeros_like(out)
        np.add.at(totals, centre[below], values[left[below]])
        on_path = centre_of[top[path]]
        out[path] += totals[on_path]
        mass[path] -= np.where(path == on_path, 0, mass[on_path])
        top[left] = piece
        left = left[left != centre]
    return out


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sums of a component's nodes to what they have from larger components.  Components come together."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        depth, conv, up = get("depth"), get("conv_id"), table.column("parent_conv_id").fill_null(0).to_numpy()
        _, code = np.unique(np.concatenate((conv, up)), return_inverse=True)
        deep = int(depth.max()) + 2
        ids, over = code[: len(conv)] * deep + depth, code[len(conv) :] * deep + depth - 1
        order = np.argsort(ids)
        place = np.clip(np.searchsorted(ids[order], over), 0, len(ids) - 1)
        parent = np.where((ids[order][place] == over) & (depth > 0), order[place], -1)
        cut = np.stack([get(c) for c in ("comp_depth", "comp1", "comp2")])
        comps = np.flatnonzero(np.concatenate(([True], (cut[:, 1:] != cut[:, :-1]).any(axis=0))))
        sizes = np.diff(np.append(comps, len(ids)))
        top_of = np.flatnonzero((np.stack([depth, get("k1"), get("k2")]) == cut).all(axis=0))
        top = np.repeat(top_of, sizes)
        parent[top_of] = -1
        sums = rolled_up(parent, top, get("mass"), np.stack([get("own_leaves"), get("own_saved")], axis=1))
        for i, c in enumerate(("leaves", "saved")):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(get(c) + sums[:, i]))
        yield from table.combine_chunks().to_batches(max_chunksize=20_000)

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < 4 * SMALL:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = np.stack([table.column(c).to_numpy() for c in ("comp_depth", "comp1", "comp2")])
        same = (cut == cut[:, -1:]).all(axis=0)
        start = int(np.argmax(same))
        if start:
            yield from solve(table.slice(0, start))
            held = table.slice(start).to_batches()
            rows = table.num_rows - start
    if held:
        yield from solve(pa.Table.from_batches(held).combine_chunks())


COMP = ["comp_depth", "comp1", "comp2"]


def subtree_sums(nodes: DataFrame, rows: DataFrame, leaves: Column, saved: Column, small: int = SMALL) -> DataFrame:
    """``nodes`` with ``leaves`` and ``saved`` summed over their subtrees, by centroid decomposition.

    While components have more than ``small`` memberships, a round over the cluster cuts each at its centroid: the least node with at least half of the
    mass.  The total of the centroid's subtree goes to all nodes of at least half the mass, which are the path from it to
    the top; what hangs below the centroid is dealt to the components of its children by the membership of the nodes' own conversations
    in ``rows``.  Each round halves the largest component.  Small components are finished in one task each.
    """
    zero = F.lit(0).cast("bigint")
    todo = nodes.select("*", leaves.alias("own_leaves"), saved.alias("own_saved"), zero.alias("leaves"), zero.alias("saved"), *[zero.alias(c) for c in COMP])
    done: list[DataFrame] = []
    columns = todo.columns
    # the mass of the whole: the root's own
    todo = staged(todo, "trie-round")
    while True:
        tops = todo.filter(" AND ".join(f"{k} = {c}" for k, c in zip(KEY, COMP))).filter(F.col("mass") > small)
        large = staged(tops.select(*COMP, F.col("mass").alias("whole")), "trie-large")
        if large.limit(1).count() == 0:
            break
        inside = todo.join(large, COMP)
        half = inside.filter(2 * F.col("mass") >= F.col("whole"))
        centres = half.groupBy(*COMP).agg(F.min(F.struct("mass", *KEY)).alias("z")).select(*COMP, F.col("z.mass").alias("z_mass"), F.col("z.depth").alias("z_depth"), F.col("z.k1").alias("z1"), F.col("z.k2").alias("z2"))
        centres = staged(large.join(centres, COMP), "trie-centres")
        # members of the children of a centroid, with the child they pass through
        wanted = centres.select(*COMP, (F.col("z_depth") + 1).alias("depth"), F.col("z1").alias("p1"), F.col("z2").alias("p2"))
        passing = rows.join(wanted, ["depth", "p1", "p2"]).select(F.col("conv").alias("conv_id"), *COMP, F.col("k1").alias("u1"), F.col("k2").alias("u2"))
        dealt = todo.join(centres, COMP).join(passing, ["conv_id", *COMP], "left")
        below = F.col("u1").isNotNull() & (F.col("depth") > F.col("z_depth"))
        centre = (F.col("depth") == F.col("z_depth")) & (F.col("k1") == F.col("z1")) & (F.col("k2") == F.col("z2"))
        dealt = staged(dealt.withColumn("below", below).withColumn("centre", centre), "trie-dealt")
        totals = dealt.filter("below OR centre").groupBy(*COMP).agg(F.sum("own_leaves").alias("t_leaves"), F.sum("own_saved").alias("t_saved"))
        cut = dealt.join(totals, COMP)
        path = 2 * F.col("mass") >= F.col("whole")
        to = {"comp_depth": F.col("z_depth") + 1, "comp1": F.col("u1"), "comp2": F.col("u2")}
        moved = {c: F.when(F.col("below"), to[c]).otherwise(F.col(c)).alias(c) for c in COMP}
        moved["leaves"] = F.when(path, F.col("leaves") + F.col("t_leaves")).otherwise(F.col("leaves")).alias("leaves")
        moved["saved"] = F.when(path, F.col("saved") + F.col("t_saved")).otherwise(F.col("saved")).alias("saved")
        moved["mass"] = F.when(path, F.col("mass") - F.col("z_mass")).otherwise(F.col("mass")).alias("mass")
        after = staged(cut.select("centre", *[moved.get(c, F.col(c)) for c in columns]), "trie-cut")
        done += [after.filter("centre").select(*columns), ]
        rest = todo.join(large, COMP, "left_anti")
        todo = staged(rest.unionByName(after.filter("NOT centre").select(*columns)), "trie-round")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema)
    out = todo.repartition(*COMP).sortWithinPartitions(*COMP).mapInArrow(_finish, schema)
    for centres in done:
        out = out.unionByName(centres)
    return out.drop("own_leaves", "own_saved", *COMP, "mass")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decimal ids of each run of one node, comma-joined, with the number of the piece in this task."""
    number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(i)) for i in range(3)])
        starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        ids = list(map(str, batch.column(3).to_pylist()))
        ends = np.append(starts[1:], len(ids))
        texts = [",".join(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
        pid = np.asarray(batch.column(4))[starts]
        order = np.arange(number, number + len(starts))
        number += len(starts)
        yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in keys), pa.array(pid), pa.array(order), pa.array(texts)], ["depth", "k1", "k2", "pid", "piece", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come in order, commas between them."""
    key, state = None, None
    row = lambda: pa.RecordBatch.from_pylist(ready, schema=schema)
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    ready: list[dict] = []
    for batch in batches:
        for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids"))):
            if (d, a, b) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                ready.append(dict(zip(schema.names, (*key, state.hexdigest()))))
            key, state = (d, a, b), hashlib.sha256(ids.encode())
        if ready:
            yield row()
            ready = []
    if key is not None:
        ready.append(dict(zip(schema.names, (*key, state.hexdigest()))))
        yield row()


def ends_digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of nodes where conversations end.

    Ids are sorted and joined in ranges over the cluster; what meets in one task is the joined text alone, as a stream, since a
    SHA-256 runs from its first byte to its last.
    """
    zero = F.lit(0).cast("bigint")
    ends = rows.filter("depth = len").select(*KEY, "conv").unionByName(convs.filter("len = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv"))
    ranged = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").withColumn("pid", F.spark_partition_id())
    pieces = ranged.mapInArrow(_pieces, "depth bigint, k1 bigint, k2 bigint, pid int, piece bigint, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "pid", "piece").mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def conversation_trie(df: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations of ``df`` (conv_id, turn, role, text), the root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``, and the names ``k1, k2``.
    Null roles and texts are empty; null turns come first; rows of an equal turn are ordered by the SHA-256 of role and text, and repeated rows are
    turns of their own.  Rows without a conv_id belong to no conversation and give no node.  Very long texts enter by digest and length
    alone.  c % 5 of a negative id is towards zero.  An empty table gives an empty result.  Other columns are not read.
    """
    rebuilt, convs = forked_turns(original_turns(df))
    rows = prefix_rows(rebuilt)
    nodes = trie_nodes(rows, convs)
    leaf = (F.col("n_children") == 0).cast("bigint")
    summed = subtree_sums(nodes, rows, leaf, (F.col("n_convs") - 1) * F.col("bytes"), small)
    found = summed.join(ends_digests(rows, convs), KEY, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "k1", "k2",
    )
