"""Near-duplicate texts by fast similarity sketching, banding and exact verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import keep, keep_small, map_batches, prepare, text_frame
from evidentia.llm.components import connected_components
from evidentia.llm.words import WHITE_SPACE, mix, utf8, word_hashes
from evidentia.session import broadcast_if_small

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**6)**42, three in a million.
BANDS, ROWS = 42, 6
_SIZE = 256  # coordinates of a sketch, a power of two; the bands use the first ones
_BITS = _SIZE.bit_length() - 1
_SHIFT = np.uint64(64 - _BITS)
#: A seed for each round; round 0 uses the shingle hashes as they are.
_SEEDS = mix(np.arange(2 * _SIZE, dtype=np.uint64) + np.uint64(77))
_EDGES = np.arange(_SIZE + 1, dtype=np.uint64)[:-1] << _SHIFT
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_PER_PASS = 2048  # hashes of several rounds that a short set computes at once
#: Members of a bucket in a block, and shared hashes that two blocks compare at a time.
_BLOCK, _SLICE = 64, 16384
_NONE = -(2**63)
#: Ids of documents that share a bucket, as a broadcast filter of the second text scan: 8 bytes each.
_SMALL = 1_000_000


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the ``size``-word shingles of each text.

    Fewer words, but not none, make the whole sequence one shingle; no words make an empty set.
    """
    words, bounds = word_hashes(*utf8(texts), WHITE_SPACE)
    scale = _ODD[:size]
    runs = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size if len(runs) else 0):
        runs += words[k : k + len(runs)] * scale[k]
    runs = mix(runs)
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high - low >= size:
            yield np.unique(runs[low : high - size + 1])
        elif high > low:
            yield mix((words[low:high] * scale[: high - low]).sum(dtype=np.uint64, keepdims=True) + np.uint64(high - low))
        else:
            yield runs[:0]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One coordinate per bin from a non-empty sorted set.

    Round ``i`` throws every element into a random bin with a fresh hash; a bin takes the smallest value
    of the first round that reaches it. After as many rounds as there are bins, one further round per
    bin throws all elements into that bin, so every coordinate is filled.
    """
    out = np.zeros(_SIZE, dtype=np.uint64)
    at = np.searchsorted(hashes, _EDGES)
    filled = at < np.append(at[1:], len(hashes))
    out[filled] = hashes[at[filled]]
    done = 1
    while done < _SIZE and not filled.all():
        rounds = min(_SIZE - done, max(1, _PER_PASS // len(hashes)))
        values = mix(hashes[None, :] ^ _SEEDS[done : done + rounds, None])
        bins = (values >> _SHIFT).astype(np.int64)
        open_ = ~filled[bins]
        which, rest, turn = bins[open_], values[open_], np.nonzero(open_)[0]
        order = np.lexsort((rest, turn, which))
        which, rest = which[order], rest[order]
        first = np.flatnonzero(np.diff(which, prepend=-1))
        out[which[first]] = rest[first]
        filled[which[first]] = True
        done += rounds
    for b in np.flatnonzero(~filled):
        out[b] = mix(hashes ^ _SEEDS[_SIZE + b]).min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a sketch; bands never share keys."""
    parts = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS) * _ODD[:ROWS]
    return mix(parts.sum(axis=1, dtype=np.uint64) + _ODD[:BANDS]).view(np.int64)


def _sketches(size: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, ids, keys = [], [], []
        for found in shingle_sets(batch.column("text"), size):
            sizes.append(len(found))
            ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            keys.append(band_keys(sketch(found)) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array(ids, type=pa.binary()),
                pa.array(keys, type=pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "set_id", "bands"],
        )

    return run


def _sets(size: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [x.tobytes() for x in shingle_sets(batch.column("text"), size)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, type=pa.binary())], names=["doc_id", "shingles"])

    return run


def _agree(percent: int):
    """Pairs whose sets, of all shingles, are similar enough."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        stays = []
        for left, right in zip(batch.column("left_set"), batch.column("right_set")):
            x, y = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (left, right))
            if len(x) > len(y):
                x, y = y, x
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            stays.append(100 * common >= percent * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(stays))

    return run


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    A document's set holds its distinct ``size``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
    lower-cased); fewer words make one shingle; null, empty and blank texts make none and link
    with nothing. Documents link when 100 * intersection >= ``percent`` * union. ``component_id`` is
    the smallest id reachable by links; ``kept`` tells that it is the row's own.

    Equal sets are one class and go on as its smallest id. Classes that share a band's key are
    candidates. The smallest member of a bucket meets all others first, which settles most groups of
    near copies. Where a bucket still holds several components, its members meet in blocks, every two once,
    so each pair of a bucket is verified on full sets unless its ends are connected already.

    An id that repeats is one node. Null ids are kept and not linked. No rows for an empty
    table; other columns are not read.
    """
    prepare(docs.sparkSession)
    texts = text_frame(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = keep(map_batches(texts, _sketches(size), "doc_id long, n_shingles long, set_id binary, bands array<long>"), "sketches")
    sets = rows.filter("set_id is not null and doc_id is not null")
    classes = keep(
        sets.groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("_c"))
        .select("set_id", F.col("_c.doc_id").alias("rep"), F.col("_c.n_shingles").alias("n"), "_c.bands"),
        "classes",
    )
    members = keep(_shared_buckets(classes), "buckets")
    component = _connected(texts, members, size, percent)
    of_class = classes.select(F.col("set_id").alias("_set"), "rep").join(
        component, F.col("rep") == F.col("node"), "left"
    ).select("_set", F.coalesce("component", "rep").alias("_component"))
    labelled = rows.select("doc_id", "n_shingles", "set_id").join(
        of_class, (F.col("set_id") == F.col("_set")) & F.col("doc_id").isNotNull(), "left"
    ).select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))
    return _one_node(labelled).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _one_node(labelled: DataFrame) -> DataFrame:
    """Rows that repeat an id with other texts join their groups through the id."""
    again = labelled.groupBy("doc_id").agg(F.min("component_id").alias("_least"), F.max("component_id").alias("_most"))
    bridges = keep_small(again.filter("_least < _most"), "bridges")
    if not bridges.take(1):
        return labelled
    both = labelled.join(bridges.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("a"), F.col("component_id").alias("b")
    )
    joined = connected_components(both)
    return labelled.join(joined, F.col("component_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id")
    )


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """``(key, rep, n, centre, centre_n)``: the members of buckets with several, and their smallest."""
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    several = banded.groupBy(F.col("key").alias("_key")).agg(
        F.min(F.struct("rep", "n")).alias("_least"), F.count(F.lit(1)).alias("m")
    ).filter("m > 1")
    return banded.join(several, F.col("key") == F.col("_key")).select(
        "key", "rep", "n", F.col("_least.rep").alias("centre"), F.col("_least.n").alias("centre_n")
    )


def _connected(texts: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """``(node, component)`` of the classes connected by candidate pairs similar enough, as a written table."""
    wanted = broadcast_if_small(members.select(F.col("rep").alias("doc_id")).distinct(), _SMALL)
    chosen = texts.join(wanted, "doc_id", "left_semi")
    sets = keep(map_batches(chosen, _sets(size), "doc_id long, shingles binary"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left_set"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right_set"))
        return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "left_set", "right_set"), _agree(percent), "a long, b long")

    links = keep_small(verified(_pairs(members, percent)), "links", per_core=4)
    component = connected_components(links)
    left = keep_small(_undecided(members.filter("rep != centre").select("key", "rep", "n"), component), "undecided")
    if not left.take(1):
        return component
    known = component.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    found = keep_small(_block_links(left, sets, percent), "links", per_core=4)
    return connected_components(known.unionByName(found))


def _block_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join different components within a bucket.

    The members of a bucket form blocks of about ``_BLOCK`` and every two blocks meet once: what is shuffled
    and joined are blocks, what comes out is a spanning forest. A component with a block's worth of members has blocks
    of its own, and those do not meet each other.
    """
    own = left.groupBy(F.col("key").alias("_key"), F.col("component").alias("_component")).agg(F.count(F.lit(1)).alias("_c"))
    placed = left.join(own, (F.col("key") == F.col("_key")) & (F.col("component") == F.col("_component")))
    large = F.col("_c") >= _BLOCK
    placed = placed.select(
        "key", "rep", "component", F.when(large, F.col("component")).alias("whole"),
        F.when(large, F.pmod(F.xxhash64("rep"), F.ceil(F.col("_c") / _BLOCK)))
        .otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("m") / _BLOCK))).alias("part"),
    )
    filled = placed.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    blocks = keep(
        filled.groupBy("key", "whole", "part").agg(F.collect_list(F.struct("rep", "component", "shingles")).alias("members"))
        .withColumn("block", F.struct(F.coalesce("whole", F.lit(_NONE)).alias("whole"), "part")).select("key", "whole", "block", "members"),
        "blocks",
    )
    other = blocks.select(*(F.col(c).alias(f"_{c}") for c in blocks.columns))
    different = F.coalesce(F.col("whole") != F.col("_whole"), F.lit(True))
    met = blocks.join(other, (F.col("key") == F.col("_key")) & (F.col("block") <= F.col("_block")) & different)
    return map_batches(met.select("members", "_members"), _meet(percent), "a long, b long").distinct()


def _meet(percent: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        links = []
        for left, right in zip(batch.column(0), batch.column(1)):
            links += _forest(left.as_py(), right.as_py(), percent)
        a, b = zip(*links) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    return run


def _forest(left: list[dict], right: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between members of two blocks that connect components not connected by one before."""
    common = _intersections([m["shingles"] for m in left], [m["shingles"] for m in right])
    sizes = [np.array([len(m["shingles"]) // 8 for m in side], dtype=np.int64) for side in (left, right)]
    similar = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(similar)):
        p, q = root(left[i]["component"]), root(right[j]["component"])
        if p != q:
            parent[max(p, q)] = min(p, q)
            links.append((left[i]["rep"], right[j]["rep"]))
    return links


def _intersections(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The sizes of the intersections of all sets of two lists, a slice of the common hashes at a time."""
    sides = [[np.frombuffer(x, dtype=np.uint64) for x in side] for side in (left, right)]
    flat = [np.concatenate(side) for side in sides]
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in sides]
    shared = np.intersect1d(flat[0], flat[1])
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for low in range(0, len(shared), _SLICE):
        part = shared[low : low + _SLICE]
        dense = []
        for hashes, row, side in zip(flat, rows, sides):
            at = np.minimum(np.searchsorted(part, hashes), len(part) - 1)
            there = part[at] == hashes
            matrix = np.zeros((len(side), len(part)), dtype=np.float32)
            matrix[row[there], at[there]] = 1
            dense.append(matrix)
        total += (dense[0] @ dense[1].T).astype(np.int64)  # exact: counts below 2**24
    return total


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of member and centre whose sizes allow the similarity."""
    near_size = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    return met.filter((F.col("rep") != F.col("centre")) & near_size).select(
        F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")
    ).distinct()


def _undecided(left: DataFrame, component: DataFrame) -> DataFrame:
    """Members, with their components, of buckets that still hold several components."""
    labelled = left.join(component, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    mixed = labelled.groupBy(F.col("key").alias("_key")).agg(
        F.count(F.lit(1)).alias("m"), F.min("component").alias("_low"), F.max("component").alias("_high")
    ).filter("_low < _high")
    return labelled.join(mixed, F.col("key") == F.col("_key")).select("key", "rep", "n", "component", "m")
