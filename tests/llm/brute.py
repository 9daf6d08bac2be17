"""Plain models of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def classes(nodes, links) -> dict:
    """Smallest node reachable from each node."""
    parent = {x: x for x in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in parent}


def simhash(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    values = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in values) > len(values))


def simhash_classes(rows: list[tuple[int, str | None]], radius: int = 4) -> dict[int, tuple[str, int]]:
    prints = {i: simhash(t) for i, t in rows}
    ids = np.array(list(prints))
    values = np.array([prints[i] for i in ids.tolist()], dtype=np.uint64)
    links = []
    for k in range(len(ids)):
        links += [(int(ids[k]), int(j)) for j in ids[np.bitwise_count(values ^ values[k]) <= radius]]
    root = classes(prints, links)
    return {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def shards(rows: list[tuple[int | None, str | None]], n: int = 24, whole_share: float = 0.01) -> list[tuple]:
    """(id, size, crc, shard, slot) from one sorted list."""
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    items = [(h(t or ""), h("" if i is None else str(i)), (i is not None, i or 0), len((t or "").encode()) + 8, i, zlib.crc32((t or "").encode())) for i, t in rows]
    items.sort()
    total = sum(x[3] for x in items)
    size_of, start_of, at = Counter(), {}, 0
    for x in items:
        start_of.setdefault(x[0], at)
        size_of[x[0]] += x[3]
        at += x[3]
    out, at, used = [], 0, Counter()
    for x in items:
        whole = size_of[x[0]] <= whole_share * total / n
        twice = 2 * start_of[x[0]] + size_of[x[0]] if whole else 2 * at + x[3]
        shard = min(n - 1, int(twice * n / (2.0 * total)))
        out.append((x[4], x[3], x[5], shard, used[shard]))
        used[shard] += 1
        at += x[3]
    return out


def repeats(rows: list[tuple[int, str | None]], length: int = 400) -> dict[int, tuple]:
    """(n_bytes, n_removed, n_spans, sha256) of each row, by counting every window."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    count: Counter[bytes] = Counter()
    key = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    for _, raw in raws:
        count.update(key(raw[s : s + length]) for s in range(len(raw) - length + 1))
    out = {}
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if count[key(raw[s : s + length])] > 1:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(rows: list[tuple[int, str | None]], words: int = 51) -> dict[int, tuple[int, int]]:
    """(n_passages, n_passage_words) of each row, by counting every window of words."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = Counter(tuple(w[s : s + words]) for _, w in split for s in range(len(w) - words + 1))
    out = {}
    for i, w in split:
        gone = np.zeros(len(w) + 1, bool)
        for s in range(len(w) - words + 1):
            if count[tuple(w[s : s + words])] > 1:
                gone[s : s + words] = True
        out[i] = (int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), int(gone.sum()))
    return out


def vector_links(rows: list[tuple[int, list | None, int | None]], threshold: float = 0.93) -> dict[int, tuple[int, int, bool]]:
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    groups = defaultdict(list)
    for i, v, label in rows:
        if label is not None and fine(v):
            groups[(label, len(v))].append((i, np.array(v, float)))
    links, n = [], Counter()
    for g in groups.values():
        x = np.array([v for _, v in g])
        c = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
        for p, q in zip(*np.nonzero(c >= threshold)):
            if p < q:
                links.append((g[p][0], g[q][0]))
                n[g[p][0]] += 1
                n[g[q][0]] += 1
    root = classes([i for i, _, _ in rows], links)
    return {i: (n[i], root[i], root[i] == i) for i, _, _ in rows}


def warc_rows(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    body = {i: (t or "").encode() for i, t in rows}
    first: dict[bytes, int] = {}
    for i in sorted(body):
        first.setdefault(body[i], i)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    return {i: (len(b), digest(b), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in body.items()}


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1) -> int:
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1, j] + gap, h[i, j - 1] + gap)
    return int(h.max())
