"""SimHash near-duplicates, linked exactly through vantage-point trees.

1. Every text gets a 64-bit fingerprint (bits set in over half of the XXH64
   values of its word shingles).  Equal fingerprints are one class.
2. The 64 bits are cut into ``parts`` of equal width.  Fingerprints that differ in
   at most ``radius`` bits differ in at most ``radius / parts`` bits of some part,
   so each part gets vantage-point trees of its own, over the Hamming distance in
   that part, whose triangle bounds have the smaller radius.  Where a part is the
   same in too many fingerprints to be split, the distance in all bits and the
   whole radius go on.
3. For each part, a tree over a bounded sample cuts the space into shards.  A
   fingerprint has one home shard and is also sent, as a guest, to every later
   shard that the triangle bound allows to hold a partner.
4. Each shard builds its own vantage-point tree over its home fingerprints and
   is queried by homes and guests; candidates are compared in all bits, so the
   pairs are exact.  Only a forest of them leaves the task.
5. Components of the forests give each document its class.

Shards travel as packed arrays, a few bytes a fingerprint.  The sample shapes
the cut only; every fingerprint is compared wherever the bound requires.

Nulls: a null text has no words, fingerprint zero, linked like any other; a null
id is never a class id unless all ids of the class are null.  Repeated rows are
equal members of a class.  Empty input: no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import Scratch, hash_sample, spread
from .components import components, local_roots

CHUNK = 1 << 15


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """The fingerprint of one whole text as a signed 64-bit integer."""
    # bytes.lower() maps A-Z only and bytes.split() cuts at 0x20 and 0x09-0x0D
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    flat = b" ".join(words)
    if n <= k:
        values = [h(flat, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        values = [h(flat[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())]
    hashes = np.array(values, dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="int64")


ALL = np.uint64(2**64 - 1)


def part_masks(parts: int) -> list[np.uint64]:
    """The bits of each part."""
    width = 64 // parts
    assert parts * width == 64
    return [np.uint64(((1 << width) - 1) << width * k) for k in range(parts)]


def distance(x: np.ndarray, v, mask=ALL) -> np.ndarray:
    return np.bitwise_count((x ^ v) & mask).astype(np.int8)


def grow_tree(points: np.ndarray, at: np.ndarray, ways: list[tuple[np.uint64, int]], rng: np.random.Generator, leaf, level: int = 0):
    """A vantage-point tree: ``(vantage, mask, radius, median, inner, outer)``, or what ``leaf`` makes of indices.

    ``ways`` are masks to measure distances by and the radii that go with them;
    the next one is taken where all points are at one distance by the first.
    """
    if (end := leaf(at, level)) is not None:
        return end
    # of a few candidates, the vantage whose distances spread most prunes best
    tries, seen = points[at[rng.integers(0, len(at), 4)]], points[at[:: max(1, len(at) // 256)]]
    for k, (mask, radius) in enumerate(ways):
        v = max(tries, key=lambda t: distance(seen, t, mask).std())
        d = distance(points[at], v, mask)
        m = int(np.median(d))
        if not (d > m).any():
            m -= 1
        inner = d <= m
        if inner.any():
            return v, mask, radius, m, *(grow_tree(points, x, ways[k:], rng, leaf, level + 1) for x in (at[inner], at[~inner]))
    return leaf(at, None)


def top_tree(sample: np.ndarray, depth: int, ways: list[tuple[np.uint64, int]]):
    """A tree of ``2 ** depth`` shards at most; its leaves are shard numbers in depth-first order."""
    count = iter(range(1 << 30))
    leaf = lambda at, level: next(count) if level is None or level == depth or len(at) < 8 else None
    return grow_tree(sample, np.arange(len(sample)), ways, np.random.default_rng(7), leaf)


def route(tree, points: np.ndarray):
    """Yields ``(shard, indices of homes, indices of guests)``; a guest's home is an earlier shard."""
    home = np.empty(len(points), np.int64)

    def settle(node, at):
        if isinstance(node, int):
            home[at] = node
        elif len(at):
            d = distance(points[at], node[0], node[1])
            settle(node[4], at[d <= node[3]])
            settle(node[5], at[d > node[3]])

    settle(tree, np.arange(len(points)))

    def visit(node, at):
        if not len(at):
            return
        if isinstance(node, int):
            yield node, at[home[at] == node], at[home[at] < node]
            return
        v, mask, radius, m, inner, outer = node
        d = distance(points[at], v, mask)
        yield from visit(inner, at[d - radius <= m])
        yield from visit(outer, at[d + radius > m])

    yield from visit(tree, np.arange(len(points)))


def near_pairs(homes: np.ndarray, guests: np.ndarray, radius: int, ways: list[tuple[np.uint64, int]], leaf: int = 64, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A forest that links what pairs within ``radius`` link (if also within the first way's radius): of homes, and of guests with homes.

    Indices count homes first, then guests.  Never more than about ``held`` pairs
    wait for being reduced, so a dense group never holds all its pairs at once.
    """
    n = len(homes)
    every = np.concatenate([homes, guests])
    root = np.arange(len(every))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def reduce():
        nonlocal root, count
        if waiting:
            root = local_roots(len(every), *(np.concatenate(x) for x in zip(*waiting)), root)
        waiting.clear()
        count = 0

    def meet(node, at):
        nonlocal count
        if not len(at):
            return
        if isinstance(node, tuple):
            v, mask, radius_, m, inner, outer = node
            d = distance(every[at], v, mask)
            meet(inner, at[d - radius_ <= m])
            meet(outer, at[d + radius_ > m])
            return
        here = homes[node]
        step = max(1, (1 << 21) // max(1, len(node)))
        for i in range(0, len(at), step):
            q = at[i : i + step]
            r, c = np.nonzero(np.bitwise_count(every[q][:, None] ^ here[None, :]) <= radius)
            a, b = root[q[r]], root[node[c]]
            new = a != b
            if new.any():
                waiting.append((a[new], b[new]))
                count += len(waiting[-1][0])
                if count > held:
                    reduce()

    if n:
        meet(grow_tree(homes, np.arange(n), ways, np.random.default_rng(n), lambda at, level: at if level is None or len(at) <= leaf else None), np.arange(len(every)))
    reduce()
    linked = np.flatnonzero(root != np.arange(len(every)))
    return linked, root[linked]


def link(prints: DataFrame, radius: int = 4, parts: int = 4, sample_size: int = 4096, shard_rows: int = 250_000, least_shards: int = 64) -> DataFrame:
    """``a, b`` (long): forests whose components are those of all pairs of distinct ``fp`` within ``radius``.

    ``prints`` has distinct fingerprints (column ``fp``).  There are at least
    about ``least_shards`` shards if the sample is large enough, and more as needed
    to hold about ``shard_rows`` home fingerprints each.
    """
    n = prints.count()
    sample = np.array([r[0] for r in hash_sample(prints, n, sample_size, "fp").collect()], dtype=np.int64).view(np.uint64)
    depth = max(-(-least_shards // parts) - 1, -(-n // shard_rows) - 1).bit_length()
    ways = [[(mask, radius // parts), (ALL, radius)] for mask in part_masks(parts)]
    trees = [top_tree(sample, depth, w) for w in ways]

    def send(batches):
        kept: dict[tuple[int, int, int], list[np.ndarray]] = {}
        held = 0

        def flush():
            rows = [(j, s, g, np.concatenate(x).tobytes()) for (j, s, g), x in sorted(kept.items())]
            kept.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int32()) for k in range(3)), pa.array([r[3] for r in rows], pa.binary())], names=["part", "shard", "guest", "packed"])

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(fp), CHUNK):
                some = fp[i : i + CHUNK]
                for j, tree in enumerate(trees):
                    for shard, *sides in route(tree, some):
                        for guest, at in enumerate(sides):
                            if len(at):
                                kept.setdefault((j, shard, guest), []).append(some[at])
                                held += len(at)
                if held > 4_000_000:
                    yield flush()
                    held = 0
        if kept:
            yield flush()

    def join(table: pa.Table) -> pa.Table:
        guest, packed = table.column("guest").to_pylist(), table.column("packed").to_pylist()
        homes, guests = (np.frombuffer(b"".join(p for p, g in zip(packed, guest) if g == k), np.uint64) for k in (0, 1))
        x, y = near_pairs(homes, guests, radius, ways[table.column("part")[0].as_py()])
        every = np.concatenate([homes, guests]).view(np.int64)
        return pa.table({"a": every[x], "b": every[y]})

    packed = prints.select("fp").mapInArrow(send, "part int, shard int, guest int, packed binary")
    return packed.groupBy("part", "shard").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, name_col: str | None = None, **options) -> DataFrame:
    """``id, name, fp, component_root, component_id`` of every row.

    ``component_id`` is the smallest name (``name_col``, by default the id)
    reachable over links; ``component_root``, a fingerprint, tells components
    apart where names are null.
    """
    ship(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        rows = spread(docs.select(F.col(id_col).alias("id"), F.col(name_col or id_col).alias("name"), F.col(text_col).alias("text")))
        rows = scratch.kept(rows.select("id", "name", fingerprint_udf("text").alias("fp")))
        classes = scratch.stored(rows.groupBy("fp").agg(F.min("name").alias("rep")))
        found = components(link(classes.select("fp"), radius, **options))
        rooted = scratch.stored(classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
        least = scratch.stored(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
        classes = scratch.kept(rooted.join(least, "root").select("fp", F.col("root").alias("component_root"), "component_id"))
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "name", "fp", "component_root", "component_id")
