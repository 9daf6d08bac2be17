"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (byte classes, word shapes, repetition) are made in Python,
one pass over each whole text.  Trees are grown on the driver from a bounded
sample of labelled rows; they are complete binary trees kept as flat arrays, so
that scoring a batch is a few numpy gathers per level, without any Python loop
over rows.

Nulls: a null text is an empty one; rows with a null label or a null id are not
learnt from.  An id labelled more than once counts with its largest label; an id
with more than one text is learnt from one of them, the same in every run.
Without any learnable row every score is 0.5.  Empty input: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import hash_sample, settled, spread

_CLASS = np.zeros(256, dtype=np.int64)  # 0: anything else
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()", b"!?", b"#$%&*+=@^~`_", b"|<>[]{}\\/"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
N_CLASSES = 11

STATISTICS = (
    "log_bytes", "log_words", *(f"class_{k}" for k in range(N_CLASSES)), "byte_entropy", "word_mean", "word_sd", "word_long", "word_short",
    "distinct_words", "top_word", "line_mean", "distinct_lines", "ends_alpha", "ends_symbol", "starts_upper", "all_upper", "distinct_pairs",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def statistics(text: str | None) -> list[float]:
    """The document statistics of one text, in the order of ``STATISTICS``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    if not words:
        return [np.log1p(n), *[0.0] * (len(STATISTICS) - 1)]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=N_CLASSES) / n
    p = counts[counts > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    w = len(words)
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    lines = raw.split(b"\n")
    last = np.frombuffer(bytes([x[-1] for x in words]), np.uint8)
    first = np.frombuffer(bytes([x[0] for x in words]), np.uint8)
    upper = sum(map(bytes.isupper, words))
    return [
        np.log1p(n), np.log1p(w), *share, float(-(p * np.log2(p)).sum()), lengths.mean(), lengths.std(), (lengths > 15).mean(), (lengths < 3).mean(),
        len(tally) / w, max(tally.values()) / w, n / len(lines), len(set(lines)) / len(lines), _ALNUM[last].mean(), ((_CLASS[last] >= 6) & (_CLASS[last] <= 9)).mean(),
        _UPPER[first].mean(), upper / w, len(set(zip(words, words[1:]))) / max(1, w - 1),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth, flattened: node j of a tree has the children 2j + 1 and 2j + 2."""

    depth: int
    prior: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; a row goes right if its value is above
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of rows x statistics."""
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2**self.depth - 1)]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Trees grown level by level from gradient histograms (logistic loss).

    ``least`` is the least hessian sum of a leaf.  Columns are cut into at most
    ``bins`` quantile bins once.
    """
    inner, leaves, n_features = 2**depth - 1, 2**depth, x.shape[1] if x.ndim == 2 else len(STATISTICS)
    if len(y) == 0:
        return Trees(depth, 0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    rate_1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(rate_1 / (1 - rate_1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(n_features)])
    total = np.full(len(y), prior)
    features, thresholds, values = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            node = at - first
            gain, best_f, best_b = np.full(wide, 1e-6), np.zeros(wide, np.int64), np.full(wide, -1)
            for f in range(n_features):
                cell = node * bins + binned[f]
                hg = np.bincount(cell, g, wide * bins).reshape(wide, bins).cumsum(1)
                hh = np.bincount(cell, h, wide * bins).reshape(wide, bins).cumsum(1)
                gl, hl, gt, ht = hg[:, :-1], hh[:, :-1], hg[:, -1:], hh[:, -1:]
                score = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                score[(hl < least) | (ht - hl < least)] = -np.inf
                score[:, len(cuts[f]) :] = -np.inf
                b = score.argmax(1)
                s = score[np.arange(wide), b]
                up = s > gain
                gain[up], best_f[up], best_b[up] = s[up], f, b[up]
            for k in np.flatnonzero(best_b >= 0):
                feature[first + k], threshold[first + k] = best_f[k], cuts[best_f[k]][best_b[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf_at = at - inner
        leaf = -rate * np.bincount(leaf_at, g, leaves) / (np.bincount(leaf_at, h, leaves) + l2)
        total += leaf[leaf_at]
        features.append(feature), thresholds.append(threshold), values.append(leaf)
    return Trees(depth, prior, np.array(features), np.array(thresholds), np.array(values))


def is_held_out(id_col: str, fold: int = 5) -> F.Column:
    """crc32 of the id as text is divisible by ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == 0, F.lit(False))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(text: pd.Series) -> pd.Series:
    return pd.Series([[float(v) for v in statistics(t)] for t in text])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Trees:
    """Fits trees on about ``max_rows`` labelled rows at most (a tenth more at the very most), chosen by id hash.

    Held-out ids (:func:`is_held_out`) are never learnt from.  The sample bounds
    what is broadcast and what reaches the driver.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(id_col))
    known = settled(known.groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("double").alias("y")))
    known = hash_sample(known, known.count(), max_rows, "k")
    rows = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(known), "k")
    made = rows.select("k", "y", statistics_udf("t").alias("x")).groupBy("k", "y").agg(F.min("x").alias("x")).orderBy("k").collect()
    return fit(np.array([r["x"] for r in made], float).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in made]), **options)


def score(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # a few thousand numbers

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in text], float).reshape(-1, len(STATISTICS))
        return pd.Series(shared.value.scores(x), dtype="float64")

    return spread(docs).withColumn(score_col, scored(F.col(text_col)))
