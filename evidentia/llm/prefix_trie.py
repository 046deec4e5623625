"""The prefix trie of conversations, rolled up by a centroid decomposition of the forest of its parent edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidentia.llm.common import keep, keep_small, numbered, prepare
from evidentia.session import broadcast_if_small

#: A component of at most so many (conversation, turn) rows is decomposed by one task.
TASK_ROWS = 1 << 16


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, slice, place, k1, k2, words)``: the turns of every conversation numbered from 1, their role and text as 128 bits.

    Turns are ordered by ``turn`` (null first), those of one number by their hashes. The whole table is
    range-partitioned in that order, so a conversation of any length is numbered slice by slice.
    Null roles and texts are empty; rows without a ``conv_id`` belong to no conversation and are left out.
    """
    spark = prepare(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit(1), text, role).alias("k2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        F.monotonically_increasing_id().alias("uid"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2"), F.col("uid")]
    ranged = keep(turns, "turns").repartitionByRange(_partitions(spark), F.col("conv_id"), *order)
    sliced = keep(ranged.withColumn("slice", F.spark_partition_id()), "sliced-turns")
    return keep(numbered(sliced, ["conv_id"], "slice", order, "place").drop("turn", "uid"), "numbered-turns")


def with_shared_heads(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first h turns replaced by those of the last conversation whose id divides by ``every``.

    h is the crc32 of the id as text modulo ``heads``. Gives ``(conv_id, length)`` and the turns. Where the other conversation
    is shorter or absent, what it lacks is left out; a conversation may end up without a turn.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = own.select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % heads).cast("long").alias("h"),
        (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
    )
    lent = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = keep(convs.withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    # The few facts of a conversation reach its turns by its slices, so a long one is no hot key.
    facts = turns.select("conv_id", "slice").distinct().join(convs.select("conv_id", "h", "lent"), "conv_id")
    kept = turns.join(facts, ["conv_id", "slice"]).filter("place > h").withColumn("place", F.col("lent") + F.col("place") - F.col("h"))
    first = turns.filter((F.col("place") < heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    taken = first.join(convs.select("conv_id", "base", "h"), "base").filter("place <= h").withColumn("slice", F.lit(-1))
    columns = ["conv_id", "slice", "place", "k1", "k2", "words"]
    return convs.select("conv_id", "length"), keep(kept.select(columns).unionByName(taken.select(columns)), "rebuilt-turns")


def trie_rows(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv_id, depth, a, b, pa, pb, words, below)``: the node (a, b) of every turn, its parent, and the turns from it on.

    A node is known by the exclusive or of 128 hashed bits of its turns and their places, a running aggregate
    that is carried over from slice to slice of a long conversation. The root is (0, 0).
    """
    bits = turns.withColumn("x1", F.xxhash64("place", "k1", "k2")).withColumn("x2", F.xxhash64("k2", "place", "k1"))
    totals = bits.groupBy("conv_id", "slice").agg(F.expr("bit_xor(x1)").alias("t1"), F.expr("bit_xor(x2)").alias("t2"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.join(convs, "conv_id").select(
        "conv_id", "slice", "length", *(F.coalesce(F.expr(f"bit_xor(t{k})").over(earlier), F.lit(0)).alias(f"c{k}") for k in (1, 2))
    )
    so_far = Window.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = bits.withColumn("r1", F.expr("bit_xor(x1)").over(so_far)).withColumn("r2", F.expr("bit_xor(x2)").over(so_far))
    rows = running.join(carried, ["conv_id", "slice"])
    a, b = F.col("r1").bitwiseXOR(F.col("c1")), F.col("r2").bitwiseXOR(F.col("c2"))
    first = F.col("place") == 1
    return keep(
        rows.select(
            "conv_id", F.col("place").cast("long").alias("depth"), a.alias("a"), b.alias("b"),
            F.when(first, 0).otherwise(a.bitwiseXOR(F.col("x1"))).cast("long").alias("pa"),
            F.when(first, 0).otherwise(b.bitwiseXOR(F.col("x2"))).cast("long").alias("pb"),
            F.col("words").cast("long").alias("words"), (F.col("length") - F.col("place") + 1).cast("long").alias("below"),
        ), "trie-rows",
    )


_NODE = ["a", "b", "pa", "pb", "owner", "depth", "weight", "n_convs", "n_children", "parent_owner", "leaf", "saved"]
_STATE = [*_NODE, "leaves_sum", "saved_sum", "ca", "cb"]


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: smallest member, members, children, what it saves by itself, and its weight.

    The weight of a node is the number of ``rows`` at and below it. It adds up along with the members,
    so the decomposition is balanced by it without a rollup beforehand.
    """
    root = convs.agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") + 1).cast("long").alias("weight")
    ).filter("n_convs > 0")
    inner = rows.groupBy("a", "b").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("owner"), F.min("depth").alias("depth"),
        F.sum("below").alias("weight"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = root.select(zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), "owner", zero.alias("depth"), "weight", "n_convs", zero.alias("words"))
    nodes = keep(inner.unionByName(top), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    # The root's smallest member is one number; every other parent's comes by a join.
    smallest = nodes.filter("depth = 0").agg(F.min("owner")).first()[0]
    parents = nodes.filter("depth > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent_owner"))
    linked = nodes.join(children, ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    saved = (F.col("n_convs") - 1) * F.col("words")
    return linked.select(
        *_NODE[:8], F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.col("depth") == 1, F.lit(smallest).cast("long")).otherwise(F.col("parent_owner")).alias("parent_owner"),
        F.col("n_children").isNull().cast("long").alias("leaf"), saved.alias("saved"),
    )


def rollup(nodes: DataFrame, rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``nodes`` with ``leaves_sum`` and ``saved_sum``, the sums of ``leaf`` and ``saved`` over their subtrees.

    Centroid decomposition: the centroid of a component is its deepest node that holds more than half of the weight. All
    nodes that do lie on the path from it to the component's top. Taking it out splits the component into
    what is above and one component for each child; the totals of the centroid and these are added along the path. The
    weight of a component at least halves each time, so a chain of any length takes a logarithmic number of rounds.

    Components above ``task_rows`` are split by joins: the conversations through the centroid tell which child
    a node is below. Smaller ones are decomposed to the end by one task each.
    """
    zero = F.lit(0).cast("long")
    state = keep(nodes.select(*_NODE, zero.alias("leaves_sum"), zero.alias("saved_sum"), zero.alias("ca"), zero.alias("cb")), "forest")
    small: list[DataFrame] = []
    done: list[DataFrame] = []
    while True:
        large = state.filter("a = ca and b = cb").filter(F.col("weight") > task_rows)
        large = keep_small(large.select("ca", "cb", F.col("weight").alias("total")), "large-components")
        if not large.take(1):
            small.append(state)
            break
        chosen = broadcast_if_small(large)
        small.append(state.join(chosen, ["ca", "cb"], "left_anti"))
        split, centroids = _split(state.join(chosen, ["ca", "cb"]), rows)
        done.append(split.filter("centre").select(_STATE))
        state = split.filter("not centre").select(_STATE)
    parts = small[0]
    for other in small[1:]:
        parts = parts.unionByName(other)
    result = _decomposed(parts.select(_STATE))
    for part in done:
        result = result.unionByName(part)
    return result.drop("ca", "cb")


def _split(big: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: the nodes of large components (with ``total``) after their centroids are taken out (``centre``)."""
    heavy = F.col("weight") * 2 > F.col("total")
    deepest = big.filter(heavy).groupBy("ca", "cb").agg(F.max(F.struct("depth", "a", "b", "weight")).alias("x"))
    centroids = keep_small(
        deepest.select("ca", "cb", F.col("x.a").alias("xa"), F.col("x.b").alias("xb"), F.col("x.depth").alias("xdepth"), F.col("x.weight").alias("xweight")),
        "centroids",
    )
    few = broadcast_if_small(centroids)
    through = rows.join(few.select(F.col("xa").alias("pa"), F.col("xb").alias("pb"), "ca", "cb"), ["pa", "pb"]).select(
        F.col("conv_id").alias("owner"), "ca", "cb", F.col("a").alias("na"), F.col("b").alias("nb")
    )
    centre = (F.col("a") == F.col("xa")) & (F.col("b") == F.col("xb"))
    below = F.col("na").isNotNull() & (F.col("depth") > F.col("xdepth"))
    moved = keep(
        big.join(few, ["ca", "cb"]).join(through, ["owner", "ca", "cb"], "left").withColumn("centre", centre)
        .withColumn("below", below).withColumn("path", heavy).drop("total", "xa", "xb", "xdepth"), "split-components",
    )
    totals = keep_small(
        moved.filter("below or centre").groupBy("ca", "cb").agg(F.sum("leaf").alias("leaf_total"), F.sum("saved").alias("saved_total")),
        "component-totals",
    )
    added = moved.join(broadcast_if_small(totals), ["ca", "cb"])
    on_path = lambda c: F.when(F.col("path"), F.col(c)).otherwise(F.lit(0))
    return added.select(
        *(c for c in _NODE if c != "weight"),
        F.when(F.col("path") & ~F.col("centre"), F.col("weight") - F.col("xweight")).otherwise(F.col("weight")).alias("weight"),
        (F.col("leaves_sum") + on_path("leaf_total")).alias("leaves_sum"), (F.col("saved_sum") + on_path("saved_total")).alias("saved_sum"),
        F.when(F.col("below"), F.col("na")).otherwise(F.col("ca")).alias("ca"),
        F.when(F.col("below"), F.col("nb")).otherwise(F.col("cb")).alias("cb"), "centre",
    ), centroids


def _decomposed(parts: DataFrame) -> DataFrame:
    """Whole components, each decomposed within one task; a task holds a few components at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < TASK_ROWS // 4:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            ca, cb = table["ca"].to_numpy(), table["cb"].to_numpy()
            edges = np.flatnonzero((ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1]))
            if len(edges):
                end = int(edges[-1]) + 1  # the last component may go on in the next batch
                yield from _summed(table.slice(0, end))
                held = table.slice(end).combine_chunks().to_batches()
                count = table.num_rows - end
        if held:
            yield from _summed(pa.Table.from_batches(held))

    fields = ", ".join(f"{c} long" for c in _STATE)
    return parts.repartition("ca", "cb").sortWithinPartitions("ca", "cb", "depth").mapInArrow(run, fields)


def _summed(table: pa.Table) -> list[pa.RecordBatch]:
    column = {c: table[c].to_numpy(zero_copy_only=False) for c in ("a", "b", "ca", "cb", "depth", "weight", "leaf", "saved")}
    parents = zip(table["pa"].to_pylist(), table["pb"].to_pylist())
    place = {key: k for k, key in enumerate(zip(column["a"].tolist(), column["b"].tolist()))}
    parent = np.array([place.get(key, -1) for key in parents], dtype=np.int64)
    parent[(column["a"] == column["ca"]) & (column["b"] == column["cb"])] = -1
    sums = centroid_sums(parent, column["depth"], column["weight"], np.stack([column["leaf"], column["saved"]], axis=1))
    for k, name in enumerate(("leaves_sum", "saved_sum")):
        table = table.set_column(table.column_names.index(name), name, pa.array(table[name].to_numpy() + sums[:, k]))
    return table.to_batches()


def centroid_sums(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` in a forest (``parent`` -1: a top), by centroid decomposition of all its trees at once.

    ``weight`` is any positive weight added up over subtrees. Each round takes out the centroid of every
    component left; labels of the parts follow by pointer jumping.
    """
    order = np.argsort(depth, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    up = np.where(parent[order] >= 0, rank[parent[order]], -1)
    weight, values = weight[order].copy(), values[order]
    sums = np.zeros_like(values)
    nodes = np.arange(len(order))
    top = _tops(nodes, np.where(up < 0, nodes, up))
    while len(nodes):
        heavy = nodes[2 * weight[nodes] > weight[top[nodes]]]
        centre_of = np.full(len(order), -1)
        centre_of[top[heavy]] = heavy  # by rising depth: the deepest stays
        out = np.zeros(len(order), dtype=bool)
        out[centre_of[top[heavy]]] = True
        cut = (up < 0) | (top == np.arange(len(order))) | out | out[up]
        after = _tops(nodes, np.where(cut, np.arange(len(order)), up))
        below = nodes[out[nodes] | (after[nodes] != top[nodes])]
        totals = np.zeros_like(values)
        np.add.at(totals, top[below], values[below])
        sums[heavy] += totals[top[heavy]]
        centre = centre_of[top[heavy]]
        weight[heavy] -= np.where(heavy == centre, 0, weight[centre])
        nodes, top = nodes[~out[nodes]], after
    back = np.empty_like(sums)
    back[order] = sums
    return back


def _tops(nodes: np.ndarray, up: np.ndarray) -> np.ndarray:
    """The end of every node's pointers, by pointer jumping."""
    top = up.copy()
    while True:
        further = top[top[nodes]]
        if (further == top[nodes]).all():
            return top
        top[nodes] = further


def member_digests(ends: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)``: the digest of the ids (ascending, comma-joined) of the conversations that end at a node.

    Ids are sorted across the cluster and joined to stretches of text; a digest streams over the stretches of its node.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (batch.column(c).to_numpy() for c in ("a", "b", "conv_id"))
            if not len(ids):
                continue
            cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(a[cuts]), pa.array(b[cuts]), pa.array(ids[cuts]), pa.array(texts)], names=["a", "b", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids")):
                text = text.as_py().encode()
                if (a, b) == key:
                    state.update(b"," + text)
                    continue
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(text)
            if found:
                yield _digests(found)
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    spread = ends.repartitionByRange(_partitions(ends.sparkSession), "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    texts = spread.mapInArrow(join, "a long, b long, first long, ids string")
    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends_sha256 string")


def _digests(found: list[tuple]) -> pa.RecordBatch:
    a, b, digest = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest)], names=["a", "b", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of every trie node.

    ``turns`` as ``numbered_turns`` gives them, numbered from 1 without a gap in each conversation; ``convs`` holds
    ``conv_id`` and ``length`` of all conversations, also of those without a turn. A node is named by its smallest member
    and its depth. Equal conversations are members of the same nodes; a conversation of any length is split into slices
    and its chain of nodes by centroids. No conversations give no rows, and only empty ones the root alone.
    """
    rows = trie_rows(turns, convs)
    done = rollup(trie_nodes(rows, convs), rows, task_rows)
    ends = rows.filter("below = 1").select("a", "b", "conv_id")
    turnless = convs.filter("length = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id")
    digests = member_digests(keep(ends.unionByName(turnless), "ends"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return done.join(digests, ["a", "b"], "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves_sum").alias("n_leaves"), F.col("saved_sum").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
