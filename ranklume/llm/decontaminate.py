"""Benchmark decontamination: rare n-gram seeds, bounds on the score, Smith-Waterman.

Texts are cut into words, with case folded over Unicode.  A document matches an item if their
Smith-Waterman alignment (local, linear gaps) reaches the share ``least`` of the
item's best possible score, and the score of ``n`` words in a row.

1. Seeds.  An alignment that reaches the score matches a number of the item's words
   at least, so if that many less one are set aside, it matches one of the others.
   The most frequent are set aside, by the number of documents that they occur in;
   the rest, the rare ones, are the item's seeds, and a document is joined with the
   items whose seeds it holds.  The n-grams of seeds are single words (n = 1):
   longer ones lose edited copies, where every n-gram of three words may be broken
   although most words are left.
2. Bounds.  Two bounds that no alignment exceeds pick the items worth aligning: the item's words that occur in
   the document at all, and the best run of the document if each of its words counted as
   matched that occurs in the item at all.
3. The alignment is made over the words that such runs can span.

No step loses a pair that reaches the score.

The items are the stated query set: they are taken in blocks of at most
``block_items`` (which bounds what is broadcast), each block against all
documents in two passes (frequencies, alignments): the cost is in proportion to
documents times blocks.

Nulls: null texts are empty; items without ``n`` words match nothing; null ids
are returned as null.  Item ids are integers.  Repeated documents or items are
reported each.  Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import spread

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items times places of a document that are looked at together, which bounds memory.
MOST_HITS = 1 << 22
HIT = "array<struct<item_id: long, score: double, first_word: long, last_word: long>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and anything outside ASCII, composed (NFC) and case-folded over Unicode."""
    text = text or ""
    if not text.isascii():
        text = normalize("NFC", normalize("NFC", text).casefold())
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def smith_waterman(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """``(score, first, last)`` of the best local alignment; first and last index ``doc``.

    One row of the table at a time: the gap along the row is a running maximum.
    """
    m = len(doc)
    step = -GAP * np.arange(1, m + 1)
    row, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, -1)
    for w in item:
        diag = row[:-1] + np.where(doc == w, MATCH, MISMATCH)
        up = row[1:] + GAP
        here = np.maximum(diag, up)
        origin = np.where(diag >= up, start[:-1], start[1:])
        origin = np.where(here > 0, origin, np.arange(1, m + 1))
        here = np.maximum(here, 0)
        lifted = here + step  # a gap from column j costs the same per column from there on
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(m), 0))
        score = top - step
        row = np.concatenate(([0], score))
        start = np.concatenate(([0], np.where(score > 0, origin[source], np.arange(1, m + 1))))
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(start[j + 1]), j)
    return best


def best_end(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """The score of :func:`smith_waterman`, and the first and the last place that an alignment with it ends at.

    Scores are kept with their column's number of gaps added, so that a gap along
    the row costs nothing.
    """
    column = (-GAP * np.arange(len(doc) + 1)).astype(np.int32)
    row, here, up = column.copy(), np.empty(len(doc), np.int32), np.empty(len(doc), np.int32)
    peak, gain = column[1:].copy(), {}
    for w in item.tolist():
        if w not in gain:
            gain[w] = np.where(doc == w, MATCH - GAP, MISMATCH - GAP).astype(np.int32)
        np.add(row[:-1], gain[w], out=here)
        np.add(row[1:], GAP, out=up)
        np.maximum(here, up, out=here)
        np.maximum(here, column[1:], out=here)
        np.maximum.accumulate(here, out=row[1:])
        np.maximum(peak, row[1:], out=peak)
    peak -= column[1:]
    ends = np.flatnonzero(peak == peak.max())
    return int(peak.max()), int(ends[0]), int(ends[-1])


class Index:
    """Words of a block of items, and the items that each word occurs in."""

    def __init__(self, items: list[tuple[int, str]], n: int = 3):
        self.n, self.ids = n, [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.items = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate(self.items) if self.items else np.zeros(0, np.int64)
        count = max(1, len(items))
        pairs, self.times = np.unique(flat * count + np.repeat(np.arange(len(items)), self.sizes), return_counts=True)
        self.owner = pairs % count
        self.first = np.searchsorted(pairs // count, np.arange(len(self.vocabulary) + 1))
        self.choose_seeds(np.diff(self.first))

    def needed(self, least: float) -> np.ndarray:
        """The score that an alignment with each item has to reach."""
        return np.maximum(np.ceil(least * MATCH * self.sizes - 1e-6), MATCH * self.n)

    def choose_seeds(self, frequency: np.ndarray, least: float = 0.0) -> None:
        """Seeds by the frequency of the vocabulary's words, good for alignments of ``least`` or more; by default rare among the items."""
        self.least = least
        spare = np.ceil(self.needed(least) / MATCH).astype(np.int64) - 1  # words that may be set aside
        keys = [word * max(1, len(self.items)) + k for k, item in enumerate(self.items) for word in item[np.argsort(frequency[item], kind="stable")][: max(0, len(item) - spare[k])]]
        pairs = np.unique(np.array(keys, np.int64))
        self.seed_owner = pairs % max(1, len(self.items))
        self.seed_first = np.searchsorted(pairs // max(1, len(self.items)), np.arange(len(self.vocabulary) + 1))

    def words(self, text: str | None) -> np.ndarray:
        """The numbers of a document's words; -1 stands for words of no item."""
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    @staticmethod
    def _postings(first: np.ndarray, words: np.ndarray) -> np.ndarray:
        lengths = first[words + 1] - first[words]
        return np.repeat(first[words] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())

    def candidates(self, ids: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """Items that share a seed with the document, and enough of their words in a run that is good enough."""
        at = np.flatnonzero(ids >= 0)
        words = ids[at]
        seen = np.unique(words)
        seeded = np.zeros(len(self.items), bool)
        seeded[self.seed_owner[self._postings(self.seed_first, seen)]] = True
        if not seeded.any():
            return np.zeros(0, np.int64)
        post = self._postings(self.first, seen)
        owner = self.owner[post]
        shared = np.bincount(owner, weights=self.times[post], minlength=len(self.items))
        wanted = seeded & (MATCH * shared >= needed)
        which = np.flatnonzero(wanted)
        loss, inverse, good = -max(MISMATCH, GAP), np.searchsorted(seen, words), []
        times, theirs = np.bincount(inverse), wanted[owner]
        row = (np.cumsum(wanted) - 1)[owner[theirs]]
        column = np.repeat(np.arange(len(seen)), self.first[seen + 1] - self.first[seen])[theirs]
        step = max(1, MOST_HITS // max(1, len(at)))
        for i in range(0, len(which), step):
            some = which[i : i + step]
            own = np.zeros((len(some), len(seen)), bool)  # which words of the document are the item's
            here = (row >= i) & (row < i + step)
            own[row[here] - i, column[here]] = True
            hits = own @ times  # places of the item's words, at least one
            item = np.repeat(np.arange(len(some)), hits)
            place = np.flatnonzero(own.take(inverse, axis=1)) - item * len(at)
            # the best run between two of an item's places: they score a match each, the words between them a loss
            upto = (MATCH + loss) * np.arange(len(item)) - loss * at[place] - item * (1 << 40)  # items lie too far apart for a run over both
            best = np.maximum.reduceat(upto - np.minimum.accumulate(upto), np.cumsum(hits) - hits) + MATCH
            good.append(some[best >= needed[some]])
        return np.concatenate(good) if good else which

    def align(self, text: str | None, least: float) -> list[tuple[int, float, int, int]]:
        """``(item id, score, first word, last word)`` of every item that scores ``least`` or more in the text."""
        ids = self.words(text)
        needed = self.needed(least)
        assert least >= self.least, "the seeds are for better alignments"
        own = np.zeros(len(self.vocabulary) + 1, bool)  # the last one is for words of no item
        loss, out = -max(MISMATCH, GAP), []
        for k in self.candidates(ids, needed):
            item = self.items[k]
            own[item] = True
            run = np.concatenate(([0], np.cumsum(np.where(own[ids], MATCH, -loss))))
            own[item] = False
            # words that a good enough run covers, in stretches: an alignment lies within one
            good = np.maximum.accumulate(run[:0:-1])[::-1] - np.minimum.accumulate(run[:-1]) >= needed[k]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
            if not len(edges):
                continue
            got, first, last, lo = max(((*best_end(item, ids[lo:hi]), lo) for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist())), key=lambda x: x[0])
            score = got / (MATCH * len(item))
            if got >= MATCH * self.n and score >= least:
                # what is aligned: a score above 0 allows no more words without a match than the matches are worth
                lo, hi = max(lo, lo + first + 1 - (1 + -(-MATCH // loss)) * len(item)), lo + last + 1
                _, a, b = smith_waterman(item, ids[lo:hi])
                out.append((self.ids[k], score, lo + a, lo + b))
        return out


def document_frequency(index: Index, docs: DataFrame, text_col: str) -> np.ndarray:
    """How many documents each word of the items occurs in; as many numbers as the block of items has words."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches):
        total = np.zeros(len(shared.value.vocabulary), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = np.unique(shared.value.words(text))
                total[seen[seen >= 0]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    out = np.zeros(len(index.vocabulary), np.int64)
    for r in spread(docs.select(F.col(text_col).alias("t"))).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def _blocks(docs: DataFrame, text_col: str, items: DataFrame, block_items: int, n: int, least: float, item_id: str, item_text: str) -> Iterator[Index]:
    total = items.count()
    parts = max(1, -(-total // block_items))
    for k in range(parts):
        block = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(parts)) == k) if parts > 1 else items
        index = Index(sorted(((r[0], r[1]) for r in block.select(item_id, item_text).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), n)
        if index.vocabulary:
            index.choose_seeds(document_frequency(index, docs, text_col), least)
        yield index


def aligned(index: Index, docs: DataFrame, text: F.Column, least: float) -> F.Column:
    """An array of hits for each row of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(HIT)
    def hits(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("item_id", "score", "first_word", "last_word"), h)) for h in shared.value.align(t, least)] for t in texts])

    return hits(text)


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.4, n: int = 3, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = 20_000) -> DataFrame:
    """``id, item_id, score, first_word, last_word`` of every document and item that align with ``least`` or more."""
    out = None
    for index in _blocks(docs, text_col, items, block_items, n, least, item_id, item_text):
        part = spread(docs.select(F.col(id_col), F.col(text_col).alias("_text"))).select(id_col, aligned(index, docs, F.col("_text"), least).alias("h")).select(id_col, F.inline("h"))
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, least: float = 0.4, n: int = 3, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that align with no item."""
    kept = docs
    for index in _blocks(docs, text_col, items, block_items, n, least, item_id, item_text):
        kept = kept.where(F.size(aligned(index, docs, F.col(text_col), least)) == 0)
    return kept
