"""Exact removal of repeated substrings with a sampled suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else in the corpus.  Suffixes are sampled so that no repeat is missed, grouped
by what they start with, and ordered by deep-shallow sorting:

1. Each window of ``length`` symbols has an anchor, the leftmost of its k-grams
   with the smallest hash.  Equal windows have equal anchors at equal offsets,
   so only the suffixes at anchors (about one in ``length / 2`` bytes) are
   sampled.  An anchor stands for a run of window starts, and for the context
   that they cover.
2. Sampled suffixes whose k-gram occurs once have no repeats.  Of the others,
   equal contexts are collapsed to one with a number of places: contexts are told
   equal by 128-bit digests, which are not compared byte by byte (of 10^12
   contexts, two different ones share a digest with a chance below 10^-14).  A
   context with several places is a repeat as a whole, so copies of any number
   cost a count, not a sort.
3. The contexts that are left are brought together by k-gram.  A k-gram with very
   many contexts (a frequent line) is split first: a window that two contexts
   share goes on equally by half of what it lacks on one side at least, so
   contexts meet by their next bytes to the right or to the left.  Their suffixes, from
   the anchor to the right, and their prefixes, to the left, are ordered by
   deep-shallow sorting: multikey quicksort to a shallow depth, then a blind
   trie for each group with a longer common prefix.  Common prefix lengths of
   neighbours tell exactly which window starts are repeated.
4. Runs of repeated starts are merged per document and cut from its text.

The same is done over words instead of bytes (:data:`WORDS`: a word is a symbol of
eight bytes, its 64-bit hash) to count the words of *passages*, runs of
``passage_words`` words that also stand anywhere else, however many bytes they
have.  Passages are reported, not removed.

What a phase writes to the shared folder is deleted when its runs are known; the
runs stay there, as the returned frame reads them.

Nulls: a null text is empty and keeps the digest of no bytes; a null id is an id
like any other.  Ids may have any type.  Repeated rows are repeats of each other.
Texts shorter than ``length`` are kept whole.  Empty input: no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import Scratch, spread

GRAM = 64  # bytes of a k-gram
SHALLOW = 24
SAMPLED_BYTES = 1 << 20  # of texts that are sampled together
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass(frozen=True)
class Unit:
    """What windows are made of: symbols of ``size`` bytes."""

    size: int

    @property
    def gram(self) -> int:
        """Symbols of a k-gram."""
        return GRAM // self.size

    def symbols(self, raw: bytes) -> bytes:
        """A text as a string of symbols."""
        return raw if self.size == 1 else b"".join(map(xxhash.xxh3_64_digest, raw.split()))

    def gram_hashes(self, flat: bytes) -> np.ndarray:
        """A hash of the k-gram at every symbol, built by doubling from strings of 8 bytes."""
        n, first = len(flat) // self.size, 8 // self.size
        if n < self.gram:
            return np.zeros(0, np.uint64)
        h = np.ascontiguousarray(np.ndarray((n - first + 1,), "<u8", flat, strides=(self.size,)))
        for j in range(3):
            shift = first << j
            a = h[: len(h) - shift] * _M[j]
            a ^= a >> np.uint64(31)
            a += h[shift:]
            h = a
        h = h * _M[3]
        h ^= h >> np.uint64(29)
        h *= _M[0]
        h ^= h >> np.uint64(32)
        return h


#: ``bytes.split()`` cuts words at 0x20 and 0x09-0x0D.
BYTES, WORDS = Unit(1), Unit(8)


def anchors(h: np.ndarray, w: int, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``(part, position, first start, last start)`` of the leftmost minimum of every window of ``w`` hashes.

    ``starts`` and ``ends`` cut the hashes into parts that windows stay in; what
    lies between parts is no one's.  Many small texts are done at once this way.
    """
    n = len(h)
    starts, part_ends = (np.zeros(1, np.int64), np.array([n])) if starts is None else (starts, ends)
    pos = np.flatnonzero(h < np.uint64(int(min(1.0, 14 / w) * (2**64 - 1025))))  # looked at first: most windows have some
    ends = np.concatenate(([-1], pos, [n]))
    for g in np.flatnonzero(np.diff(ends) > w):  # windows without a small hash: look at all of theirs
        pos = np.concatenate([pos, np.arange(ends[g] + 1, ends[g + 1])])
    pos = np.sort(pos)
    val = h[pos]
    m = len(pos)
    before = pos - w  # no smaller or equal one is in any common window
    after = pos + w
    for side in (-1, 1):
        alive, j = np.arange(m), 0
        while len(alive):
            j += side
            other = alive + j
            alive, other = (x[(other >= 0) & (other < m)] for x in (alive, other))
            near = np.abs(pos[other] - pos[alive]) < w
            alive, other = alive[near], other[near]
            stop = val[other] <= val[alive] if side < 0 else val[other] < val[alive]
            (before if side < 0 else after)[alive[stop]] = pos[other[stop]]
            alive = alive[~stop]
    part = np.searchsorted(starts, pos, side="right") - 1
    lo = np.maximum(np.maximum(before + 1, pos - w + 1), starts[part])
    hi = np.minimum(np.minimum(pos, after - w), part_ends[part] - w)
    ok = lo <= hi
    return part[ok], pos[ok], lo[ok], hi[ok]


# -- deep-shallow sorting ------------------------------------------------------


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings that agree before ``at``."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    lo, hi = at, n  # agree before lo, differ before hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie_order(strings: list[bytes], at: list[int], depth: int) -> list[int]:
    """Orders strings that agree before ``depth``, with a blind trie.

    The trie keeps branching depths and branching bytes only.  A string goes down
    by those bytes, is compared with any leaf there to find where it really
    departs, and is put in at that depth.  Ends sort before any byte.
    """
    char = lambda s, d: s[d] if d < len(s) else -1
    # a node is [depth, {byte: child}]; a leaf is a list of equal strings' numbers
    root: list | None = None
    for i in at:
        s = strings[i]
        if root is None:
            root = [None, [i]]
            continue
        path, node = [], root
        while node[0] is not None:
            path.append(node)
            child = node[1].get(char(s, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        other = strings[node[1][0]]
        d = common(s, other, depth)
        if d == len(s) == len(other):
            node[1].append(i)
            continue
        parent, here = None, root
        while here[0] is not None and here[0] < d:
            parent, here = here, here[1].get(char(s, here[0]))
            if here is None:
                break
        if here is None:
            parent[1][char(s, parent[0])] = [None, [i]]
        elif here[0] == d:
            here[1][char(s, d)] = [None, [i]]
        else:
            new = [d, {char(s, d): [None, [i]], char(other, d): here}]
            if parent is None:
                root = new
            else:
                parent[1][char(s, parent[0])] = new
    out: list[int] = []
    stack = [root] if root else []
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Numbers of the strings in order: multikey quicksort to ``shallow`` bytes, blind tries below."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        at, d = stack.pop()
        if len(at) == 1:
            out += at
            continue
        if d >= shallow:
            out += blind_trie_order(strings, at, d)
            continue
        keys = [strings[i][d] if d < len(strings[i]) else -1 for i in at]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        low, same, high = [], [], []
        for i, c in zip(at, keys):
            (same if c == pivot else low if c < pivot else high).append(i)
        if high:
            stack.append((high, d))
        if pivot < 0:  # all of these have ended, so they are equal
            stack += [([i], d) for i in reversed(same)]
        else:
            stack.append((same, d + 1))
        if low:
            stack.append((low, d))
    return out


def neighbours(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Deep-shallow order and the common prefix of each string with the one before it in order."""
    order = deep_shallow_order(strings)
    return order, [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


# -- repeated starts of a group of contexts ------------------------------------


def repeated_starts(contexts: list[bytes], offsets: list[int], length: int, size: int = 1) -> list[np.ndarray]:
    """For different contexts with one anchor k-gram: which of their window starts are repeated.

    ``offsets`` are the anchors' places in their contexts, and ``length`` is that of
    a window, in bytes; both are multiples of ``size``, that of a symbol.  Windows
    match only at equal offsets from the anchor.  The result has a flag for each
    symbol that a window starts at.
    """
    n = len(contexts)
    flags = [np.zeros((len(c) - length) // size + 1, bool) for c in contexts]
    rights = [c[o:] for c, o in zip(contexts, offsets)]
    lefts = [c[:o][::-1] for c, o in zip(contexts, offsets)]
    order, lcp = neighbours(rights)
    left_order, left_lcp = neighbours(lefts)
    left_rank = [0] * n
    for r, i in enumerate(left_order):
        left_rank[i] = r

    def mark(i: int, left: int, right: int):
        # windows from o bytes before the anchor, o <= left, that end within right bytes after it
        lo, hi = offsets[i] // size - min(left, offsets[i]) // size, (offsets[i] + right // size * size - length) // size
        if lo <= hi:
            flags[i][max(lo, 0) : hi + 1] = True

    def joined(a: list[int], b: list[int], depth: int) -> list[int]:
        """Joins left ranks of suffixes that agree for ``depth`` bytes to the right.

        The smaller list goes into the larger one, and each of its members meets
        its neighbours in left order.  Other neighbours have met, at more bytes.
        """
        if depth < need:
            return a  # nothing below this depth can make a window
        if len(a) < len(b):
            a, b = b, a
        for r in b:
            p = bisect(a, r)
            i = left_order[r]
            for q in a[max(0, p - 1) : p + 1]:
                j = left_order[q]
                left = common(lefts[i], lefts[j])
                mark(i, left, depth), mark(j, left, depth)
            a.insert(p, r)
        return a

    # The groups that agree for ever fewer bytes to the right form a tree over the order.  In a group,
    # the best partner to the left of each member is a neighbour in left order.
    need = length - max(offsets, default=0)
    stack: list[tuple[int, list[int]]] = []
    last = [left_rank[order[0]]] if n else []
    for place in range(1, n + 1):
        depth = lcp[place] if place < n else -1
        while stack and stack[-1][0] >= depth:
            d, before = stack.pop()
            last = joined(before, last, d)
        if place < n:
            stack.append((depth, last))
            last = [left_rank[order[place]]]
    return flags


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of set flags as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


# -- the distributed operator --------------------------------------------------


def _sample(unit: Unit, length: int):
    names = ["doc", "th", "gram", "c1", "c2", "span"]  # c1, c2: digest of the context; span: first start, number of further starts, offset of the anchor
    types = [pa.int64()] * len(names)

    def sampled(docs: list[int], ths: list[int], raws: list[bytes]) -> pa.RecordBatch:
        flat, size = b"".join(raws), unit.size
        h = unit.gram_hashes(flat)
        ends = np.cumsum([len(r) // size for r in raws])
        starts = ends - [len(r) // size for r in raws]
        part, pos, lo, hi = anchors(h, length - unit.gram + 1, starts, ends - unit.gram + 1)
        digests = b"".join(xxhash.xxh3_128_digest(flat[a:b], 9) for a, b in zip((lo * size).tolist(), ((hi + length) * size).tolist()))
        ctx = np.frombuffer(digests, np.int64).reshape(-1, 2)
        cols = np.array(docs, np.int64)[part], np.array(ths, np.int64)[part], h[pos].view(np.int64), ctx[:, 0], ctx[:, 1], (lo - starts[part]) << 20 | (hi - lo) << 10 | (pos - lo)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            docs, ths, raws, held = [], [], [], 0
            for doc, th, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = unit.symbols(raw)
                if len(raw) < length * unit.size:
                    continue
                docs.append(doc), ths.append(th), raws.append(raw)
                held += len(raw)
                if held > SAMPLED_BYTES:
                    yield sampled(docs, ths, raws)
                    docs, ths, raws, held = [], [], [], 0
            if raws:
                yield sampled(docs, ths, raws)

    return run, ", ".join(f"{x} long" for x in names)


def _cut_contexts(unit: Unit, length: int, crowd: int):
    """Texts and their wanted spans -> one row a span, with its symbols."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            doc, th, text, spans = (batch.column(i).to_pylist() for i in range(4))
            held, unpack = 0, zstandard.ZstdDecompressor().decompress
            for d, t, z, ss in zip(doc, th, text, spans):
                raw = unit.symbols(unpack(z))
                for s in ss:
                    lo, more, off = s["span"] >> 20, s["span"] >> 10 & 1023, s["span"] & 1023
                    piece = raw[lo * unit.size : (lo + more + length) * unit.size]
                    for key in meeting_keys(piece, off * unit.size, s["gram"], s["m"] > crowd, unit, length):
                        for c, v in zip(out, (d, t, key, lo, off, s["n"], piece)):
                            c.append(v)
                        held += len(piece)
                if held > 8 << 20:
                    yield _contexts(out)
                    out, held = [[] for _ in range(7)], 0
            if out[0]:
                yield _contexts(out)

    return run


def meeting_keys(context: bytes, off: int, gram: int, crowded: bool, unit: Unit, length: int) -> list[int]:
    """Keys such that two contexts of a k-gram that share a window share a key.

    Of the symbols that a window has besides the k-gram, at least half are on one
    side of it.
    """
    if not crowded:
        return [gram]
    half = (length - unit.gram + 1) // 2 * unit.size
    sides = [(off, off + GRAM + half, gram & 0xFFFFFFFF), (off - half, off + GRAM, gram >> 32 & 0xFFFFFFFF | 1 << 32)]
    return [xxhash.xxh3_64_intdigest(context[a:b], seed) - (1 << 63) for a, b, seed in sides if a >= 0 and b <= len(context)]


def _contexts(out):
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())], names=["doc", "th", "key", "lo", "off", "n", "bytes"])


def _settle_groups(unit: Unit, length: int):
    """Rows sorted by key -> runs of repeated starts ``doc, th, lo, hi`` of contexts that occur once."""

    def solve(rows: list[tuple]) -> list[tuple]:
        distinct = {(r[6], r[4]) for r in rows}
        if len(distinct) < 2:
            return []
        keys = sorted(distinct)
        flags = dict(zip(keys, repeated_starts([k[0] for k in keys], [k[1] * unit.size for k in keys], length * unit.size, unit.size)))
        return [(r[0], r[1], r[3] + a, r[3] + b) for r in rows if r[5] == 1 for a, b in runs(flags[(r[6], r[4])])]

    def emit(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["doc", "th", "lo", "hi"])

    def run(batches):
        group, rows, out = None, [], []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if r[2] != group:
                    if len(rows) > 1:
                        out += solve(rows)
                    group, rows = r[2], []
                rows.append(r)
                if len(out) > 50_000:
                    yield emit(out)
                    out = []
        if len(rows) > 1:
            out += solve(rows)
        if out:
            yield emit(out)

    return run


def merged(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Runs of window starts as the maximal spans [a, b) that their windows cover."""
    spans: list[list[int]] = []
    for a, b in sorted(starts):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + length)
        else:
            spans.append([a, b + length])
    return [(a, b) for a, b in spans]


def cut(raw: bytes, starts: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Merged removed spans [a, b) and the remaining bytes."""
    spans = merged(starts, length)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return spans, b"".join(kept)


@F.pandas_udf(T.BinaryType())
def packed(raw: pd.Series) -> pd.Series:
    """Texts as they travel: a third of the size, where the shuffle's own codec gets to two thirds."""
    return raw.map(zstandard.ZstdCompressor(level=3).compress)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("raw"))


def repeated(docs: DataFrame, length: int = 400, unit: Unit = BYTES, id_col: str = "doc_id", text_col: str = "text", heavy_places: int = 200, max_heavy: int = 100_000, crowd: int = 64) -> DataFrame:
    """``doc, th, runs`` of documents with repeats: runs of starts (lo, hi) of repeated windows, in symbols.

    ``doc`` and ``th``, hashes of the id and the text, identify a document's text.
    Two bounds choose how the same rows are found.  Contexts with more than
    ``heavy_places`` places are joined by broadcast instead of being shuffled;
    there are ``max_heavy`` of them at most, as the bound rises with the input.
    K-grams with more than ``crowd`` different contexts are split as told above.
    """
    ship(docs.sparkSession)
    assert 2 * unit.gram <= length < 1000, "offsets are packed into ten bits"
    base = _base(docs, id_col, text_col).where(F.octet_length("raw") >= length)  # a word has a byte at least
    sample, schema = _sample(unit, length)
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.stored(spread(base.select("doc", "th", "raw")).mapInArrow(sample, schema))
        # k-grams that occur once are gone after this join; what follows is about the repeated part only
        often = scratch.stored(found.groupBy("gram").agg(F.count("*").alias("g")).where("g > 1").select("gram"))
        shared = scratch.stored(found.join(often, "gram"))
        scratch.drop(found, often)
        context = ["gram", "c1", "c2"]
        ctx = scratch.stored(shared.groupBy(*context).agg(F.count("*").alias("n"), F.min("doc").alias("one")))
        # contexts with very many places (at most shared / bound of them) are joined by broadcast and never shuffled
        bound = max(heavy_places, shared.count() // max_heavy)
        again = ctx.where("n > 1").select(*context, "n")
        heavy = F.broadcast(again.where(F.col("n") > bound).select(context))
        light = again.where(F.col("n") <= bound).select(context)
        places = shared.join(heavy, context, "left_anti").join(light, context).unionByName(shared.join(heavy, context))
        whole = places.select("doc", "th", F.expr("shiftright(span, 20)").alias("lo"), F.expr("shiftright(span, 20) + (shiftright(span, 10) & 1023)").alias("hi"))
        mixed = scratch.stored(ctx.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"))
        wanted = ctx.join(mixed, "gram").select(*context, "n", F.col("one").alias("doc"), "m")
        wanted = shared.join(wanted, [*context, "doc"]).select("doc", "th", F.struct("gram", "span", "n", "m").alias("s"))
        wanted = scratch.stored(wanted.groupBy("doc", "th").agg(F.collect_list("s").alias("spans")))
        travelling = base.select("doc", "th", packed("raw").alias("z"))
        pieces = travelling.join(wanted.hint("shuffle_hash"), ["doc", "th"]).select("doc", "th", "z", "spans").mapInArrow(_cut_contexts(unit, length, crowd), "doc long, th long, key long, lo long, off long, n long, bytes binary")
        partial = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_settle_groups(unit, length), "doc long, th long, lo long, hi long")
        return scratch.kept(whole.unionByName(partial).distinct().groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, passage_words: int = 51, **options) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words`` of every row (and ``spans, kept`` on request).

    ``n_passages`` and ``n_passage_words`` are the maximal runs that windows of
    ``passage_words`` words which also stand elsewhere cover, and their words.
    """
    spans_of = repeated(docs, length, BYTES, id_col, text_col, **options)
    passages_of = repeated(docs, passage_words, WORDS, id_col, text_col, **options).withColumnRenamed("runs", "word_runs")
    base = _base(docs, id_col, text_col).select("id", "doc", "th", packed("raw").alias("z"))
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long" + (", spans array<struct<first: long, end: long>>, kept binary" if with_kept else "")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words", *(["spans", "kept"] if with_kept else [])]

    @F.pandas_udf(f"struct<{schema}>")
    def removed(z: pd.Series, runs_: pd.Series, word_runs: pd.Series) -> pd.DataFrame:
        rows, unpack = [], zstandard.ZstdDecompressor().decompress
        pairs = lambda s: [(x["lo"], x["hi"]) for x in s] if s is not None else []
        for r, s, w in zip(map(unpack, z), runs_, word_runs):
            spans, kept = cut(r, pairs(s), length)
            passages = merged(pairs(w), passage_words)
            rows.append((len(r), len(r) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(passages), sum(b - a for a, b in passages), *(([{"first": a, "end": b} for a, b in spans], kept) if with_kept else ())))
        return pd.DataFrame(rows, columns=names)

    both = spans_of.join(passages_of, ["doc", "th"], "full")
    joined = base.join(both.hint("shuffle_hash"), ["doc", "th"], "left")
    return joined.select("id", removed("z", "runs", "word_runs").alias("x")).select(F.col("id").alias(id_col), "x.*")
