"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are compared only within one label, by cosine.  On the unit sphere a
cosine bound is a bound on Euclidean distance, so the exact threshold pairs are
found with metric cover trees:

1. equal vectors of a label are one class with a multiplicity;
2. a label with many classes is cut into blocks: every class goes to the nearest
   of centres that are drawn from the classes, so dense regions get more of them;
   a block that is overfull all the same is cut by a hash before it is gathered.
   A block gets a cover tree (nested levels, the radius halves at each);
3. block pairs are found by descent: a cover tree of the blocks' centres, whose
   nodes know how far their blocks' points reach, is traversed from each block, so
   no product of blocks is made.  Block pairs that lie wholly within the threshold
   are counted and joined as blocks, their vectors don't travel;
4. the other block pairs are joined by dual traversal: node pairs are pruned by the
   covering radii, node pairs that lie wholly within the threshold are counted
   without listing them, and what is left is compared exactly.  A block meets its
   partners in portions, so that it travels once for each portion, not for each pair;
5. each task returns link counts and a forest; components finish the classes.

What reaches the driver is bounded by ``max_blocks``: the counts of labels with more
than one block, the centres, and the blocks' summaries.

Vectors without any clusters are about equally far apart in many dimensions; then
no bound prunes, and the work is quadratic in the size of a label.

Nulls: a vector that is null, empty or zero, or holds null or non-finite
components, and a vector with a null label, links with nothing; vectors of
different lengths are not compared.  A null id never names a component unless
all its ids are null.  Repeated rows are vectors of their own.  Empty input: no
rows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Scratch
from .components import components, local_roots

SLACK = 1e-6  # of computed distances
LEAF = 16


@dataclass
class Node:
    """Points of a cover tree node; ``radius`` covers them from ``centre``."""

    centre: int
    radius: float
    points: np.ndarray
    kids: list[Node] | None = None
    kid_centres: np.ndarray | None = None
    kid_radii: np.ndarray | None = None
    kid_single: np.ndarray | None = None


def _far(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ v.T)))


def cover_tree(u: np.ndarray) -> Node:
    """The cover tree of unit vectors.  A node's centre is also the centre of its first child."""

    def grow(points: np.ndarray, centre: int, level: float) -> Node:
        d = _far(u[points], u[centre][None])[:, 0]
        node = Node(centre, float(d.max(initial=0.0)), points)
        if len(points) <= LEAF or node.radius < 1e-9:
            return node
        level = min(level, node.radius)
        while level >= node.radius / 2 + 1e-12:
            level /= 2
        rest, kids, c = points, [], centre
        while len(rest):
            near = _far(u[rest], u[c][None])[:, 0] <= level
            near[rest == c] = True
            kids.append(grow(rest[near], c, level))
            rest = rest[~near]
            c = int(rest[0]) if len(rest) else -1
        node.kids = kids
        node.kid_centres = np.array([k.centre for k in kids])
        node.kid_radii = np.array([k.radius for k in kids])
        node.kid_single = np.array([len(k.points) == 1 for k in kids])
        return node

    mid = int(np.argmax(u @ u.mean(0)))
    return grow(np.arange(len(u)), mid, 2.0)


def dual_links(a: np.ndarray, ua: np.ndarray, ta: Node, ma: np.ndarray, b, ub, tb: Node, mb, threshold: float, same: bool):
    """``(links of a, links of b, local roots of a then b)`` for raw vectors, unit vectors, tree and multiplicities."""
    reach = float(np.sqrt(2.0 - 2.0 * threshold))
    na, nb, n = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), len(a)
    off = 0 if same else n
    size = n if same else n + len(b)
    norm_a, norm_b = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    root = np.arange(size)

    def unite(x, y):
        nonlocal root
        root = local_roots(size, x, y, root)

    def add(i, j):  # exact test of listed pairs
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            ok = (a[p] * b[q]).sum(1) / (norm_a[p] * norm_b[q]) >= threshold
            p, q = p[ok], q[ok]
            if len(p):
                np.add.at(na, p, mb[q])
                np.add.at(nb, q, ma[p])
                unite(p, q + off)

    def meet(stack):
        while stack:
            x, y, me = stack.pop()
            if me:
                if x.kids is None:
                    i, j = np.triu_indices(len(x.points), 1)
                    add(x.points[i], x.points[j])
                    continue
                stack += [(k, k, True) for k in x.kids if len(k.points) > 1]
            else:
                d = float(_far(ua[x.centre][None], ub[y.centre][None])[0, 0])
                if d > reach + x.radius + y.radius + SLACK:
                    continue
                if d + x.radius + y.radius + SLACK < reach:  # all of them link
                    na[x.points] += mb[y.points].sum()
                    nb[y.points] += ma[x.points].sum()
                    hub = np.full(len(x.points) + len(y.points), x.points[0])
                    unite(np.concatenate([x.points, y.points + off]), hub)
                    continue
                if x.kids is None and y.kids is None:
                    i, j = np.meshgrid(x.points, y.points, indexing="ij")
                    add(i.ravel(), j.ravel())
                    continue
                if x.kids is None or (y.kids is not None and y.radius > x.radius and (len(y.points) > 4 * len(x.points))):
                    stack += [(x, k, False) for k, ok in zip(y.kids, _far(ub[y.kid_centres], ua[x.centre][None])[:, 0] <= reach + x.radius + y.kid_radii + SLACK) if ok]
                    continue
                if y.kids is None:
                    stack += [(k, y, False) for k, ok in zip(x.kids, _far(ua[x.kid_centres], ub[y.centre][None])[:, 0] <= reach + y.radius + x.kid_radii + SLACK) if ok]
                    continue
            for s in range(0, len(x.kids), 1024):
                part = slice(s, s + 1024)
                i, j = np.nonzero(_far(ua[x.kid_centres[part]], ub[y.kid_centres]) <= reach + x.kid_radii[part, None] + y.kid_radii[None, :] + SLACK)
                i = i + s
                if me:
                    i, j = i[i < j], j[i < j]
                both = x.kid_single[i] & y.kid_single[j]
                add(x.kid_centres[i[both]], y.kid_centres[j[both]])
                stack += [(x.kids[p], y.kids[q], False) for p, q in zip(i[~both], j[~both])]

    meet([(ta, tb, same)])
    return (na + nb if same else na), nb, root


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    """Rows ``at``, which have ``dim`` elements, of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts = column.offsets.to_numpy()[:-1]
    return column.values.to_numpy(zero_copy_only=False)[starts[at][:, None] + np.arange(dim)]


@dataclass
class Blocks:
    """The blocks of one label: a cover tree of their centres, and how far from a node's centre its blocks' points reach."""

    ids: list[str]
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray  # vectors, with multiplicity
    hubs: np.ndarray  # a member's class of each

    def __post_init__(self):
        self.tree, self.covers = cover_tree(self.centres), {}
        stack = [self.tree]
        while stack:
            node = stack.pop()
            self.covers[id(node)] = float((_far(self.centres[node.points], self.centres[node.centre][None])[:, 0] + self.radii[node.points]).max())
            stack += node.kids or []

    def __getstate__(self):
        return self.ids, self.centres, self.radii, self.sizes, self.hubs

    def __setstate__(self, state):
        self.ids, self.centres, self.radii, self.sizes, self.hubs = state
        self.__post_init__()

    def near(self, centre: np.ndarray, radius: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that may hold a partner of a point within ``radius`` of ``centre``, and their distances."""
        found, stack = [], [self.tree]
        while stack:
            node = stack.pop()
            if float(_far(self.centres[node.centre][None], centre[None])[0, 0]) > reach + radius + self.covers[id(node)] + SLACK:
                continue
            if node.kids is None:
                found.append(node.points)
            else:
                stack += node.kids
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        d = _far(self.centres[at], centre[None])[:, 0]
        ok = d <= reach + radius + self.radii[at] + SLACK
        return at[ok], d[ok]


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block_rows: int = 1500, max_blocks: int = 4096, portion: int = 32) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row.

    Blocks hold about ``block_rows`` classes, more if there would be more than
    ``max_blocks`` of them.  ``portion`` partners of a block are met in one task.
    """
    spark = rows.sparkSession
    ship(spark)
    reach = float(np.sqrt(2.0 - 2.0 * threshold))
    vec = F.col(vec_col).cast("array<double>")
    with Scratch(spark) as scratch:
        rows = scratch.kept(rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("v")))
        fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("v", lambda x: x != 0)
        rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
        classes = rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
        classes = scratch.stored(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))

        target = max(block_rows, -(-classes.count() // max_blocks))
        # at most max_blocks / 2 labels have more than one block
        large = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > 2 * target).select("label", "dim")
        draw = F.xxhash64(F.lit(3), "cid").bitwiseAND(F.lit((1 << 40) - 1)) < int((1 << 40) / target)
        drawn: dict[tuple[str, int], list] = {}
        for r in classes.where(draw).join(F.broadcast(large), ["label", "dim"]).select("label", "dim", "v").collect():
            drawn.setdefault((r["label"], r["dim"]), []).append(r["v"])
        centres = spark.sparkContext.broadcast({k: _unit(np.array(sorted(v), float)) for k, v in drawn.items()})

        def deal(batches):
            for batch in batches:
                label, dim = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
                block, groups = np.zeros(batch.num_rows, np.int32), {}
                for i, key in enumerate(zip(label, dim)):
                    if key in centres.value:
                        groups.setdefault(key, []).append(i)
                for key, at in groups.items():
                    u = _unit(_matrix(batch.column("v"), np.array(at), key[1]))
                    for s in range(0, len(at), 1024):
                        block[at[s : s + 1024]] = (u[s : s + 1024] @ centres.value[key].T).argmax(1)
                yield batch.append_column("block", pa.array(block))

        dealt = scratch.stored(classes.select("label", "dim", "v", "cid", "mult").mapInArrow(deal, "label string, dim int, v array<double>, cid long, mult long, block int"))
        # overfull blocks, at most max_blocks of them
        full = dealt.groupBy("label", "dim", "block").agg(F.ceil(F.count("*") / target).cast("int").alias("cuts")).where("cuts > 2")
        cut = dealt.join(F.broadcast(full), ["label", "dim", "block"], "left").withColumn("sub", F.pmod(F.xxhash64("cid"), F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts")

        def plant(table: pa.Table) -> pa.Table:
            """The tree of one block."""
            label, dim, block, sub = (table.column(k)[0].as_py() for k in ("label", "dim", "block", "sub"))
            x, cid, mult = _matrix(table.column("v"), np.arange(table.num_rows), dim), *(table.column(k).to_numpy() for k in ("cid", "mult"))
            u = _unit(x)
            tree = cover_tree(u)
            row = (label, dim, f"{block}|{sub}|{dim}|{label}", u[tree.centre].tolist(), tree.radius, int(mult.sum()), int(cid.min()), pickle.dumps((x, cid, mult, tree)))
            schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("bid", pa.string()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("size", pa.int64()), ("hub", pa.int64()), ("tree", pa.binary())])
            return pa.Table.from_pylist([dict(zip(schema.names, row))], schema)

        summary = "label string, dim int, bid string, centre array<double>, radius double, size long, hub long"
        blocks = scratch.stored(cut.groupBy("label", "dim", "block", "sub").applyInArrow(plant, f"{summary}, tree binary"))

        known: dict[tuple[str, int], list] = {}
        for r in blocks.join(F.broadcast(large), ["label", "dim"]).select("label", "dim", "bid", "centre", "radius", "size", "hub").collect():
            known.setdefault((r["label"], r["dim"]), []).append(r)
        column = lambda rs, c, kind=None: np.array([r[c] for r in rs], kind)
        forests = spark.sparkContext.broadcast({k: Blocks([r["bid"] for r in rs], column(rs, "centre", float), column(rs, "radius", float), column(rs, "size", np.int64), column(rs, "hub", np.int64)) for k, rs in known.items()})

        def find(batches):
            """Rows of three kinds: a block itself, a portion's partner, and an edge between the hubs of blocks that link wholly."""
            names, types = ["kind", "a", "part", "b", "n", "ea", "eb"], [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            for batch in batches:
                for r in batch.to_pylist():
                    here, out, whole = forests.value.get((r["label"], r["dim"])), [], 0
                    if here is not None:
                        at, d = here.near(np.array(r["centre"]), r["radius"], reach)
                        other = np.array([here.ids[i] != r["bid"] for i in at], bool)
                        at, d = at[other], d[other]
                        within = d + r["radius"] + here.radii[at] + SLACK < reach
                        whole = int(here.sizes[at[within]].sum())
                        out += [("edge", None, None, None, None, r["hub"], h) for h in here.hubs[at[within]].tolist() if h > r["hub"]]
                        later = [here.ids[i] for i in at[~within].tolist() if here.ids[i] > r["bid"]]
                        out += [("pair", r["bid"], k // portion, b, None, None, None) for k, b in enumerate(sorted(later))]
                    out.append(("self", r["bid"], 0, None, whole, None, None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        pairs = scratch.stored(blocks.select(*(x.split()[0] for x in summary.split(", "))).mapInArrow(find, "kind string, a string, part int, b string, n long, ea long, eb long"))
        tree = blocks.select("bid", "hub", "tree")
        slots = pairs.where("kind = 'pair'").select("a", "part", F.lit(-1).cast("long").alias("n")).unionByName(pairs.where("kind = 'self'").select("a", "part", "n")).groupBy("a", "part").agg(F.max("n").alias("n"))
        own = slots.join(tree, F.col("a") == F.col("bid")).select("a", "part", F.lit(0).alias("place"), "n", "hub", "tree")
        partners = pairs.where("kind = 'pair'").join(tree, F.col("b") == F.col("bid")).select("a", "part", F.lit(1).alias("place"), F.lit(0).cast("long").alias("n"), "hub", "tree")
        meeting = own.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", "place")

        def link(batches):
            """A block's own row comes first, then its partners, one at a time."""

            def emit(cids, n, root):
                hit = np.flatnonzero((n > 0) | (root != np.arange(len(root))))
                return pa.RecordBatch.from_arrays([pa.array(cids[hit]), pa.array(n[hit]), pa.array(cids[root[hit]])], names=["cid", "n", "root"])

            for batch in batches:
                for place, n, hub, blob in zip(*(batch.column(k).to_pylist() for k in ("place", "n", "hub", "tree"))):
                    x, cid, mult, t = pickle.loads(blob)
                    u = _unit(x)
                    if place == 0:
                        mine = x, u, t, mult
                        mine_cid = cid
                        if n >= 0:  # the block's first portion: its own links, and those with whole blocks
                            links, _, root = dual_links(*mine, *mine, threshold, True)
                            yield emit(cid, links + n, np.full(len(cid), int(np.flatnonzero(cid == hub)[0])) if n > 0 else root)
                    else:
                        na, nb, root = dual_links(*mine, x, u, t, mult, threshold, False)
                        yield emit(np.concatenate([mine_cid, cid]), np.concatenate([na, nb]), root)

        found = scratch.stored(meeting.mapInArrow(link, "cid long, n long, root long"))
        counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
        edges = found.select(F.col("cid").alias("a"), F.col("root").alias("b")).unionByName(pairs.where("kind = 'edge'").select(F.col("ea").alias("a"), F.col("eb").alias("b")))
        rooted = components(edges).select(F.col("node").alias("cid"), "root")
        named = scratch.stored(classes.join(counts, "cid", "left").join(rooted, "cid", "left").select("label", "v", "rep", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")))
        least = scratch.stored(named.groupBy("root").agg(F.min("rep").alias("component_id")))
        named = scratch.kept(named.join(least, "root").select("label", "v", "n_links", "component_id"))

    linked = rows.where("ok").join(named, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
