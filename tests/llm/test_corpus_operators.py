"""Operators on documents, pages and vectors against plain models and on odd rows."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklume.llm import decontaminate, embedding_dedup, license_scan, mixing, quality, sharding, simhash, suffix_dedup, warc
from ranklume.llm.components import components, local_roots
from ranklume.llm.queries import QUERIES, table
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i * 7919 % 997}" for i in range(9000))
ODD = [
    (0, None, "en", "a", None),
    (1, "", "en", "a", 0),
    (2, " \t\n", None, None, 3),
    (3, "one", "en", "b", 3),
    (4, "One  two\tTHREE four", "en", "b", 19),
    (5, "one two three four", "en", None, 18),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG + " end", "en", "b", len(LONG)),
    (8, LONG, "en", "c", len(LONG)),
    (9, "é" * 700 + " ünï " + "日本語 " * 200, "fr", "c", 1),
    (10, "a" * 1500, "en", "c", 1500),
    (11, "It is CC BY. All Rights  reserved; general-public license, all rights reserved", "en", "ä", 0),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# -- components ------------------------------------------------------------


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.classes({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_roots():
    a, b = np.array([3, 4, 8]), np.array([4, 1, 9])
    assert local_roots(10, a, b).tolist() == [0, 1, 2, 1, 1, 5, 6, 7, 8, 8]


# -- 5 SimHash -------------------------------------------------------------


def test_simhash_matches_brute_force(docs):
    got = {r["doc_id"]: (f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute.simhash_classes(texts(docs))


def test_simhash_odd_rows(odd, empty):
    got = {r["doc_id"]: (f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert got == brute.simhash_classes([(r[0], r[1]) for r in ODD])
    assert simhash.near_duplicates(empty).count() == 0


def print_cloud(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    flip = lambda n: np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    near = base[:300] ^ flip(300) ^ flip(300)
    far = base[300:500] ^ flip(200) ^ flip(200) ^ flip(200) ^ flip(200)
    dense = np.uint64(12345) ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))
    one_part = (rng.integers(0, 2**48, 400, dtype=np.uint64) << np.uint64(16)) | np.uint64(77)  # a part that can't be split
    return np.unique(np.concatenate([base, near, far, dense, one_part]))


def print_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    return [(int(p), int(q)) for p in points for q in points[np.bitwise_count(points ^ p) <= radius]]


@pytest.mark.parametrize("depth, parts, radius", [(0, 4, 4), (3, 4, 4), (6, 4, 4), (3, 1, 4), (4, 2, 3), (4, 4, 7)])
def test_vantage_point_shards_find_every_pair(depth, parts, radius):
    points = print_cloud(depth)
    links = []
    for mask in simhash.part_masks(parts):
        ways = [(mask, radius // parts), (simhash.ALL, radius)]
        homes_seen = []
        for _, homes, guests in simhash.route(simhash.top_tree(points[::3], depth, ways), points):
            x, y = simhash.near_pairs(points[homes], points[guests], radius, ways, leaf=16, held=50)
            every = np.concatenate([points[homes], points[guests]])
            links += list(zip(every[x].tolist(), every[y].tolist()))
            homes_seen += homes.tolist()
        assert sorted(homes_seen) == list(range(len(points)))
    assert all((p ^ q).bit_count() <= 64 for p, q in links)
    assert brute.classes(points.tolist(), links) == brute.classes(points.tolist(), print_links(points, radius))


@pytest.mark.parametrize("options", [{}, {"shard_rows": 100, "least_shards": 1}, {"least_shards": 400, "sample_size": 150}, {"parts": 1, "shard_rows": 50}])
def test_distributed_shards_find_every_pair(spark, options):
    points = print_cloud(9)
    prints = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(3)
    links = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.link(prints, **options).collect()]
    assert brute.classes(points.tolist(), links) == brute.classes(points.tolist(), print_links(points, 4))


def test_simhash_with_forced_shards_and_clashing_columns(spark, docs):
    clash = docs.withColumns({c: F.lit("x") for c in ("fp", "name", "id", "rep", "root", "node")})
    got = {r["doc_id"]: (f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in simhash.near_duplicates(clash, shard_rows=20, least_shards=64).collect()}
    assert got == brute.simhash_classes(texts(docs))


# -- 3 sharding ------------------------------------------------------------


def test_shards_match_one_sorted_list(docs, odd):
    for df in (docs, odd):
        got = sorted(tuple(r) for r in sharding.assign_shards(df).select("doc_id", "size", "text_crc32", "shard", "slot").collect())
        assert got == sorted(brute.shards(texts(df)))


def test_shards_are_near_equal_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "copy of one text " * 3 if i % 3 == 0 else f"text {rng.random()} " * rng.randrange(1, 9)) for i in range(6000)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    by = {r["shard"]: r for r in out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()}
    assert len(by) == 8 and all(r["m"] == r["n"] - 1 for r in by.values())
    sizes = [r["b"] for r in by.values()]
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes)


def test_shards_of_nulls_repeats_and_nothing(spark, empty):
    rows = [(None, None), (None, "x"), (1, "x"), (1, "x"), (1, None)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(out) == 5 and {r["grown_shard"] for r in out} == {None}
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(empty).count() == 0


def test_shards_of_one_row_repeated_many_times(spark):
    rows = [(None if i % 2 else 7, "the same text") for i in range(4000)] + [(i, f"text {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("at", "salt", "sub", "rng", "k1", "id", "size")})
    out = sharding.assign_shards(df, 5, ranges=16)
    by = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d"), F.sum("size").alias("b")).collect()
    assert len(by) == 5 and all(r["n"] == r["d"] == r["m"] + 1 for r in by) and max(r["b"] for r in by) - min(r["b"] for r in by) < 100
    placed = sorted(tuple(r) for r in out.select("doc_id", "size", "text_crc32", "shard").fillna(-1).collect())
    assert placed == sorted((-1 if x[0] is None else x[0], *x[1:4]) for x in brute.shards(rows, 5))


def test_splitters_isolate_hot_keys():
    bounds = sharding.splitters([1, 5, 5, 5, 5, 5, 9, 12], 8)
    assert 5 in bounds and 6 in bounds


def test_write_shards(spark, tmp_path, docs):
    sharding.write_shards(docs, sharding.assign_shards(docs, 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and set(back.select("shard").distinct().toPandas()["shard"]) == {0, 1, 2, 3}


# -- 6 mixing --------------------------------------------------------------


def test_mix_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault((r["target"], r["source_size"]), [r["source_size"], 0, 0])
        s[1] += r["taken"]
        s[2] = max(s[2], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert abs(sum(t for t, _ in by) - 1.5 * total) < 1e-6 * total
    for (target, _), (size, taken, largest) in by.items():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= largest


def test_targets_reshare_excess(spark):
    sizes = {"0a": 10, "0b": 1000, "0c": 400, "0d": 0}
    got = {r["sk"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "sk string, s_size long"), 1.5).collect()}
    weights = dict(zip(sorted(sizes), [3, 1, 2, 3]))
    capped: dict[str, float] = {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = 1.5 * sum(sizes.values()) - sum(capped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2.0 * sizes[s] for s in over}
    assert got == pytest.approx(capped | share)


def test_mix_odd_rows(odd, empty, spark):
    first = sorted(map(tuple, mixing.mix(odd).select("doc_id", "size", "taken").collect()))
    assert [r[0] for r in first] == [r[0] for r in ODD] and first[0][1:] == (0, 0)
    assert first == sorted(map(tuple, mixing.mix(odd.repartition(3)).select("doc_id", "size", "taken").collect()))
    assert mixing.mix(empty).count() == 0
    clash = odd.withColumn("size", F.lit("x")).withColumn("e", F.lit(1)).withColumn("b", F.lit(1))
    assert mixing.mix(clash).count() == len(ODD)


def test_mix_of_equal_rows_and_many_buckets(spark):
    rows = [(7, "a b c d", "s")] * 500 + [(None, "a b", "s")] * 300 + [(i, "w " * (i % 9), "t") for i in range(200)] + [(None, None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    totals = set()
    for options in ({}, {"rows_per_bucket": 1}, {"buckets": 1}):
        got = mixing.mix(df, 0.7, **options).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            s = by.setdefault((r["source_size"], r["target"]), [0, 0])
            s[0] += r["taken"]
            s[1] = max(s[1], r["size"])
        assert all(abs(taken - target) <= largest for (_, target), (taken, largest) in by.items())
        totals.add(tuple(sorted((k, v[0]) for k, v in by.items())))
    assert len(totals) == 1


# -- 8 license scan --------------------------------------------------------


def test_license_scan_odd_rows(odd, empty):
    rows = {r["doc_id"]: r for r in license_scan.license_scan(odd).collect()}
    assert len(rows) == len(ODD)
    assert (rows[0]["n_words"], rows[0]["n_base"], rows[0]["first_word"], rows[0]["labels"], rows[0]["score"]) == (0, 0, None, "", 0.0)
    r = rows[11]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (13, 4, 2, 10, "cc-by,gpl,reserved")
    assert rows[6]["n_words"] == 9000 and license_scan.license_scan(empty).count() == 0


def test_license_scan_merges_neighbouring_diagonals(spark):
    text = "x y permission is hereby granted fully free of charge to any person who is obtaining a copy of this software and associated documentation files z"
    r = license_scan.license_scan(spark.createDataFrame([(1, text), (1, text), (None, "released under the MIT license")], "doc_id long, text string")).collect()
    assert [x["labels"] for x in r] == ["mit"] * 3 and len(r) == 3
    span = next(x for x in r if x["doc_id"] == 1)["spans"][0]
    assert span["label"] == "mit" and span["first_word"] >= 0 and 0.6 <= span["cover"] < 1


@pytest.mark.parametrize(
    "text, labels",
    [
        ("licensed under CC BY 4.0", ""),
        ("licensed under CC BY-SA 4.0", ""),
        ("licensed under CC BY-NC-SA 4.0", ""),
        ("licensed under CC BY-NC 4.0", "cc-by-nc"),
        ("This page: CC BY-NC 4.0", "cc-by-nc"),
        ("released under the Apache license", ""),
        ("released under the MIT license", "mit"),
        ("licensed under the Mozilla license, version 2.0", ""),
        ("licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("licensed under Creative Commons Attribution-NonCommercial 4.0 International", ""),
        ("licensed under Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa"),
        ("This work is licensed under the GNU General Public License version 3", "gpl-3.0"),
        ("This work is licensed under the GNU General Public License version 2", ""),
        ("licensed under the GNU Lesser General Public License", "lgpl"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge", ""),
        ("released under the MIT" + " or any other" * 9 + " license", ""),
        ("released under the mit licens\u212a and wor\u212a", ""),
    ],
)
def test_license_scan_tells_neighbouring_licenses_apart(spark, text, labels):
    (r,) = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), base=()).collect()
    assert r["labels"] == labels and [x["label"] for x in r["spans"]] == [x for x in labels.split(",") if x]


def test_license_scan_lower_cases_ascii_only(spark):
    texts = ["this wor\u212a is licensed under the gnu general public license version 3", "\u0130t CC B\u0178", "ALL RIGHTS RESERVED"]
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["labels"] == "gpl,gpl-3.0" and 0.6 < max(x["cover"] for x in got[0]["spans"] if x["label"] == "gpl-3.0") < 1
    assert [r["labels"] for r in got[1:]] == ["", "reserved"] and got[1]["n_words"] == 3


def test_license_scan_of_whole_license_texts(spark):
    whole = {label: words.replace("[", "").replace("]", "") for label, words in license_scan.NOTICES if label.endswith("-text")}
    cut_off = {label: " ".join(t.split()[: len(t.split()) // 2]) for label, t in whole.items()}
    edited = {label: " ".join(x for i, w in enumerate(t.split()) for x in ([w, "1"] if i in (30, 60) else [w])) for label, t in whole.items()}
    for texts, found in ((whole, True), (cut_off, False), (edited, True)):
        for r in license_scan.license_scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect():
            assert (r["doc_id"] in r["labels"].split(",")) == found
            if texts is whole:
                assert r["score"] == 1.0 and (r["doc_id"], 0, r["n_words"] - 1, 1.0) in [tuple(x) for x in r["spans"]]


def test_license_scan_spans_do_not_chain(spark):
    text = " ".join(["provided that the following"] * 400)
    (r,) = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["labels"] == "" and r["score"] == 0.0 and r["n_words"] == 1600


def test_license_scan_keeps_clashing_columns_and_rows_apart(spark):
    df = spark.createDataFrame([(None, "CC BY"), (None, "CC BY"), (5, None)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "id", "words", "tid", "label", "at", "n_words")})
    got = license_scan.license_scan(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_base"], r["base_labels"]) for r in got) == [(0, 2, 1, "cc-by"), (0, 2, 1, "cc-by"), (5, 0, 0, "")]


# -- 1 quality -------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op1_quality"](spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and 1 - sum(bad) / len(bad) > 0.6
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_trees_by_hand():
    trees = quality.Trees(2, 0.5, np.array([[0, 1, 1]]), np.array([[1.0, 5.0, np.inf]]), np.array([[1.0, 2.0, 3.0, 4.0]]))
    x = np.array([[0, 0], [0, 9], [2, 7]], float)
    assert trees.scores(x) == pytest.approx(1 / (1 + np.exp(-(0.5 + np.array([1.0, 2.0, 3.0])))))


def test_quality_without_labels_and_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    trees = quality.train(odd, labels)
    assert {r["score"] for r in quality.score(odd, trees).collect()} == {0.5}
    assert quality.score(empty, trees).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    assert quality.score(odd, quality.train(odd, labels, least=0.1)).count() == len(ODD)


# -- 10 decontamination ----------------------------------------------------


def test_smith_waterman_rows_match_the_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 20)), rng.integers(-1, 4, rng.integers(1, 40))
        score, first, last = decontaminate.smith_waterman(a, b)
        assert score == brute.smith_waterman(a, b)
        if score:
            assert brute.smith_waterman(a, b[first : last + 1]) == score


def test_best_ends_bound_the_alignment():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(-1, 5, rng.integers(1, 80))
        score, first, last = decontaminate.smith_waterman(a, b)
        got, low, high = decontaminate.best_end(a, b)
        assert got == score
        if score:
            assert low <= last <= high
            lo = max(0, low + 1 - 3 * len(a))
            got, f, e = decontaminate.smith_waterman(a, b[lo : high + 1])
            assert (got, lo + f, lo + e) == (score, first, last)


def test_decontamination_finds_edited_copies_only(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(300)] + ["the", "of"] * 60
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(6)]
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(20, 200))
        if i % 10 == 0:
            copy = items[i // 10 % 6][1].split()
            for at in rng.sample(range(30), 4):  # edits
                copy[at] = "edited"
            del copy[rng.randrange(30)]
            words[10:10] = copy
        rows.append((i, " ".join(words).title()))
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i // 10 % 6) for i in range(0, 120, 10)}
    assert all(abs(r["first_word"] - 10) <= 2 for r in got)
    blocks = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_items=2).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == {(r["doc_id"], r["item_id"]) for r in got}
    kept = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(120) if i % 10}


def test_decontamination_of_copies_that_lost_most_ngrams():
    words = [f"w{i}" for i in range(20)]
    copy = ["edited" if i % 5 == 4 else w for i, w in enumerate(words)]  # 8 of 18 3-grams are left
    index = decontaminate.Index([(7, " ".join(words))])
    assert index.align(" ".join(copy), 0.4) == [(7, 0.725, 0, 18)]


@pytest.mark.parametrize("share", [0.2, 0.3, 0.4])
def test_decontamination_matches_alignment_of_everything(share):
    rng = random.Random(int(share * 10))
    vocabulary = [f"v{i}" for i in range(150)] + ["the", "of"] * 20
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 40)))) for k in range(12)]
    index = decontaminate.Index(items)
    found = 0
    for i in range(120):
        copy = items[i % 12][1].split()
        for at in sorted(rng.sample(range(len(copy)), round(share * len(copy))), reverse=True):
            copy[at : at + 1] = rng.choice([[], ["edited"], [copy[at], "edited"]])
        words = rng.choices(vocabulary, k=rng.randrange(60))
        words[len(words) // 2 : len(words) // 2] = copy
        ids = np.array([index.vocabulary.get(w.encode(), -1) for w in words], int)
        best = [brute.smith_waterman(item, ids) for item in index.items]
        want = {k: g / (2 * len(t)) for k, (g, t) in enumerate(zip(best, index.items)) if g >= 6 and g / (2 * len(t)) >= 0.4}
        assert {k: s for k, s, _, _ in index.align(" ".join(words), 0.4)} == want
        found += i % 12 in want
    assert found > 60


@pytest.mark.parametrize("seed", range(6))
def test_seeds_lose_no_alignment(seed, monkeypatch):
    if seed > 3:
        monkeypatch.setattr(decontaminate, "MOST_HITS", 5)
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)] + ["the", "of"] * 20
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 25)))) for k in range(15)]
    index = decontaminate.Index(items)
    index.choose_seeds(np.array([rng.randrange(5) for _ in index.vocabulary]), 0.4)
    for _ in range(150):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(40)))
        ids = np.array([index.vocabulary.get(w.encode(), -1) for w in text.split()], int)
        best = [brute.smith_waterman(item, ids) for item in index.items]
        want = {k: g / (2 * len(t)) for k, (g, t) in enumerate(zip(best, index.items)) if g >= 6 and g / (2 * len(t)) >= 0.4}
        assert {k: s for k, s, _, _ in index.align(text, 0.4)} == want


def test_contaminated_matches_alignment_of_all_documents_with_all_items(spark, docs, sf_dir):
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    short = [(10**6 + k, " ".join(t.split()[:m])) for k, ((_, t), m) in enumerate(zip(items, (1, 2, 3, 4, 5, 6, 8, 11) * 3))]
    bench = spark.createDataFrame(items + short, "item_id long, text string").withColumn("score", F.lit("x"))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs.withColumn("h", F.lit(1)).withColumn("score", F.lit(1)), bench).collect()}
    index, want = decontaminate.Index(items + short), {}
    for i, t in texts(docs):
        ids = index.words(t)
        for k, item in enumerate(index.items):
            if len(item) >= 3 and len(ids):
                g = decontaminate.smith_waterman(item, ids)[0]  # itself tested against the whole table
                if g >= 6 and g / (2 * len(item)) >= 0.4:
                    want[(i, index.ids[k])] = g / (2 * len(item))
    assert got == want and any(k >= 10**6 for _, k in want)


def test_decontamination_of_one_surviving_ngram_and_none():
    words = [f"w{i}" for i in range(20)]
    one = [w if i < 3 or i % 3 else "edited" for i, w in enumerate(words)]
    none = [w if i % 3 else "edited" for i, w in enumerate(words)]
    index = decontaminate.Index([(7, " ".join(words))])
    for copy in (one, none):
        ids = np.array([index.vocabulary.get(w.encode(), -1) for w in copy], int)
        score = brute.smith_waterman(index.items[0], ids) / 40
        assert score >= 0.4 and [(i, s) for i, s, _, _ in index.align(" ".join(copy), 0.4)] == [(7, score)]


@pytest.mark.parametrize("item", ["Être à l'école où l'été naît déjà", "Все люди рождаются свободными и равными", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι λόγος"])
def test_decontamination_folds_case_over_unicode(item):
    index = decontaminate.Index([(7, item)])
    for copy in (item.upper(), item.lower(), unicodedata.normalize("NFD", item.upper())):
        assert [h[:2] for h in index.align(copy, 0.4)] == [(7, 1.0)]
        assert [h[:2] for h in decontaminate.Index([(7, copy)]).align(item, 0.4)] == [(7, 1.0)]
    assert decontaminate.words_of("STRASSE Straße \udc80") == [b"strasse", b"strasse", b"\xed\xb2\x80"]


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "one two three four"), (4, "one two three four")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items).collect()} == {(4, 4), (5, 4)}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0


# -- 2 WARC ----------------------------------------------------------------


def test_warc_round_trip(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    rows = [(r[0], r[1]) for r in pages.collect()]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(9)] + [(2000, None), (2001, ""), (2002, "é\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(i, "http://x/\n" + str(i) if i % 2 else None, t) for i, t in rows], "page_id long, url string, html string")
    path = warc.archive(df)
    got = warc.read(spark, path).collect()
    page = lambda s: None if s is None else int(s.rpartition(":")[2])
    assert {page(r["record_id"]): (r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to"])) for r in got} == brute.warc_rows(rows)
    body = dict(rows)
    assert all(bytes(r["payload"]).decode() == (body[page(r["record_id"])] or "") for r in got if r["record_type"] == "response")
    some = warc.read(spark, path).where("record_type = 'revisit' and payload_bytes > 0")
    assert {r["record_type"] for r in some.collect()} == {"revisit"}
    assert warc.read(spark, path, payload="false").where(F.col("record_id") == "urn:page:2000").collect()[0]["payload"] is None
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.tests == [("record_type", "eq", "response")]


def test_warc_nulls_small_payloads_and_nothing(spark):
    df = spark.createDataFrame([(None, None, "aa"), (None, None, "aa"), (3, None, "b"), (4, None, "b"), (4, None, "long enough"), (4, None, "long enough")], "page_id long, url string, html string")
    kinds = sorted((r["record_id"] or "", r["record_type"]) for r in warc.read(spark, warc.archive(df, min_bytes=2)).collect())
    assert kinds == [("", "response"), ("", "response"), *[("urn:page:3", "response")], *[("urn:page:4", "response")] * 3]
    assert warc.read(spark, warc.archive(df.limit(0))).count() == 0


# -- 7 embeddings ----------------------------------------------------------


def test_embeddings_match_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, sf_dir, "embeddings").collect()]
    rng = np.random.default_rng(4)
    hub = rng.normal(size=64)
    rows += [(10_000 + i, (hub + rng.normal(size=64) * 0.12).tolist(), 1) for i in range(150)]
    rows += [(20_000 + i, rows[i % 5][1], rows[i % 5][2]) for i in range(30)]
    rows += [(30_000, None, 1), (30_001, [0.0] * 64, 1), (30_002, [float("nan")] + [1.0] * 63, 1), (30_003, [None] + [1.0] * 63, 1), (30_004, hub.tolist(), None), (30_005, [1.0, 2.0], 1), (30_006, [2.0, 4.0], 1), (30_007, [], 1), (30_008, [float("inf")] * 64, 1)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    df = spark.createDataFrame(rows, schema)
    want = brute.vector_links([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    for options in ({}, {"block_rows": 40}, {"block_rows": 3, "portion": 2}, {"block_rows": 10, "max_blocks": 20}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, **options).collect()}
        assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_dense_balls_and_clashing_columns(spark):
    rng = np.random.default_rng(11)
    centres = [rng.normal(size=16) for _ in range(3)]
    rows = [(100 * k + i, (c + rng.normal(size=16) * s).tolist(), "x") for k, (c, s) in enumerate(zip(centres, (0.002, 0.05, 0.2))) for i in range(90)]
    rows += [(None, centres[0].tolist(), "x"), (None, centres[0].tolist(), "x"), (5, centres[2].tolist(), "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({c: F.lit("x") for c in ("v", "id", "ok", "cid", "block", "bid")})
    numbered = [(i if r[0] is None or r[2] == "y" else r[0], r[1], r[2]) for i, r in enumerate(rows, 1000)]
    want = brute.vector_links(numbered)
    got = sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, block_rows=8, portion=3).collect())
    assert got == sorted((r[0] is not None, r[0] or 0, want[n[0]][0], 5 if r[2] == "y" else want[n[0]][1]) for r, n in zip(rows, numbered))


def test_descent_finds_all_near_blocks():
    rng = np.random.default_rng(12)
    u = embedding_dedup._unit(rng.normal(size=(400, 3)))
    radii = rng.random(400) * 0.3
    blocks = embedding_dedup.Blocks([str(i) for i in range(400)], u, radii, np.ones(400, np.int64), np.arange(400))
    for i in range(0, 400, 7):
        at, _ = blocks.near(u[i], radii[i], 0.2)
        want = np.flatnonzero(np.linalg.norm(u - u[i], axis=1) <= 0.2 + radii[i] + radii)
        assert set(want.tolist()) <= set(at.tolist()) and len(at) <= len(want) + 1


def test_cover_tree_levels_cover():
    rng = np.random.default_rng(6)
    u = rng.normal(size=(300, 5))
    u /= np.linalg.norm(u, axis=1, keepdims=True)

    def check(node):
        d = np.linalg.norm(u[node.points] - u[node.centre], axis=1)
        assert d.max() <= node.radius + 1e-7
        if node.kids:
            assert sorted(np.concatenate([k.points for k in node.kids]).tolist()) == sorted(node.points.tolist())
            assert all(k.radius <= node.radius / 2 + 1e-7 for k in node.kids) and node.kids[0].centre == node.centre
            for k in node.kids:
                check(k)

    check(embedding_dedup.cover_tree(u))


# -- 9 suffix arrays -------------------------------------------------------


def test_deep_shallow_order_sorts():
    rng = random.Random(9)
    strings = [b"", b"", b"a" * 50, b"a" * 49, b"a" * 30 + b"b"] + [bytes(rng.choices(b"ab", k=rng.randrange(0, 60))) for _ in range(300)] + [b"x" * 40 + bytes(rng.choices(b"abc", k=20)) for _ in range(80)]
    order = suffix_dedup.deep_shallow_order(strings, shallow=6)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


def test_anchors_are_leftmost_minima():
    rng = np.random.default_rng(3)
    for h in (rng.integers(0, 2**64, 900, dtype=np.uint64), rng.integers(0, 5, 300, dtype=np.uint64), np.full(120, 7, np.uint64), rng.integers(2**61, 2**64, 700, dtype=np.uint64)):
        w = 50
        want: dict[int, list[int]] = {}
        for s in range(len(h) - w + 1):
            want.setdefault(s + int(np.argmin(h[s : s + w])), []).append(s)
        _, pos, lo, hi = suffix_dedup.anchors(h, w)
        assert {p: (a, b) for p, a, b in zip(pos.tolist(), lo.tolist(), hi.tolist())} == {p: (s[0], s[-1]) for p, s in want.items()}


def test_anchors_of_parts_are_those_of_each_part():
    rng = np.random.default_rng(5)
    sizes = [130, 10, 49, 50, 400, 0, 90]
    h = rng.integers(0, 2**64, sum(sizes) + 30 * len(sizes), dtype=np.uint64)
    starts = np.cumsum([0] + [s + 30 for s in sizes])[:-1]
    ends = starts + sizes
    want = []
    for p, (a, b) in enumerate(zip(starts, ends)):
        want += [(p, x + a, y + a, z + a) for _, x, y, z in zip(*map(np.ndarray.tolist, suffix_dedup.anchors(h[a:b], 50)))]
    assert list(zip(*map(np.ndarray.tolist, suffix_dedup.anchors(h, 50, starts, ends)))) == want


def test_repeats_with_a_crowded_line(spark):
    rng = random.Random(3)
    word = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))
    lines, passages = [word(n) for n in (14, 16, 20, 36, 60)], [word(n) for n in (75, 90, 120)]
    rows = []
    for i in range(200):
        parts = [word(rng.randrange(0, 40)), lines[i % 2] if i % 3 else rng.choice(lines), word(rng.randrange(0, 60))]
        if i % 4 == 0:
            parts[1:1] = [rng.choice(passages)]
        if i % 5 == 0:
            edited = list(passages[2])
            edited[rng.randrange(len(edited))] = "#"
            parts.append("".join(edited))
        rows.append((i, " ".join(parts)))
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows) and sum(v[1] > 0 for v in got.values()) > 50


def test_repeats_match_counting_every_window(docs):
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute.repeats(texts(docs))


def test_repeats_of_planted_passages(spark, odd, empty):
    rng = random.Random(8)
    word = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randrange(2, 8))) for _ in range(n))
    passages = [word(n) for n in (40, 70, 85, 100, 130, 200, 400)]
    rows = [(r[0], r[1]) for r in ODD]
    for i in range(60):
        parts = [word(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, max(1, len(p) // 4))
            parts += [p[cut : len(p) - rng.randrange(0, 50)], word(rng.randrange(0, 40))]
        rows.append((100 + i, " ".join(parts)))
    rows += [(300, passages[-1] * 2), (301, None), (302, "line of text\n" * 90), (303, "é" * 401)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute.repeats(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    twice = suffix_dedup.remove_repeats(spark.createDataFrame([(1, word(300))] * 2 + [(None, word(120))], "doc_id long, text string"), with_kept=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"] == r["n_bytes"]) for r in twice) == [(0, False), (1, True), (1, True)]


@pytest.mark.parametrize("options", [{"heavy_places": 1, "crowd": 1}, {"heavy_places": 10**6, "crowd": 10**6}, {"heavy_places": 3, "max_heavy": 1}])
def test_bounds_of_the_suffix_operator_change_no_row(spark, options):
    rng = random.Random(13)
    word = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))
    line, passage = word(20), word(110)
    rows = [(i, " ".join([word(rng.randrange(0, 50)), line, passage[: rng.randrange(300, 600)] if i % 2 else passage, word(rng.randrange(0, 50))])) for i in range(70)]
    rows += [(100 + i, rows[i % 4][1]) for i in range(12)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in got} == brute.repeats(rows)
    assert {r["doc_id"]: tuple(r)[5:] for r in got} == brute.passages(rows)


def test_passages_match_counting_every_window(docs, odd, spark):
    rows = texts(docs) + [(10**6 + r[0], r[1]) for r in ODD]
    got = suffix_dedup.remove_repeats(docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))).collect()
    want = brute.passages(rows)
    assert {r["doc_id"]: tuple(r)[5:] for r in got} == want and 0 < sum(v[0] > 0 for v in want.values()) < len(want) / 2


def test_repeats_with_text_ids_clashing_columns_and_nothing_left_behind(spark, tmp_path, monkeypatch):
    from ranklume.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    text = " ".join(f"w{i}" for i in range(150))
    rows = [("a", text), ("b", text + " end"), (None, None), (None, text)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit("x") for c in ("doc", "th", "z", "runs", "gram", "n_bytes", "raw", "id")})
    got = suffix_dedup.remove_repeats(df)
    assert sorted((r["doc_id"] or "", r["n_bytes"], r["n_bytes"] - r["n_removed"], r["n_passage_words"]) for r in got.collect()) == [("", 0, 0, 0), ("", len(text), 0, 150), ("a", len(text), 0, 150), ("b", len(text) + 4, 4, 150)]
    assert len(list(tmp_path.iterdir())) == 2  # the runs of bytes and of words, which the result reads
