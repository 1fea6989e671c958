import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crowdtally.llm import simhash as S
from crowdtally.llm.components import components

DOC = "doc_id long, text string, fp string, keep int, component_id string"


def print_of(text):
    """Bit by bit, over the shingles as they are defined."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=2):
    """Smallest linked index for each, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    p = np.array(prints, np.uint64)
    for i in range(len(p)):
        for j in np.nonzero(np.bitwise_count(p[:i] ^ p[i]) <= radius)[0].tolist():
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(p))]


def test_fingerprints():
    texts = ["", None, "one", "two WORDS", "a b c", "A\tb\x0bc\x0cd\re\nf é\x85x\xa0y\x1cz", "x " * 70_000,
             " ".join(f"w{i}" for i in range(40_000))]
    for t in texts:
        assert S.fingerprint(t) == print_of(t)


@pytest.mark.parametrize("kind", ["random", "cluster", "dense"])
def test_local_links_against_all_pairs(kind):
    rng = np.random.default_rng(7)
    n = 1500
    if kind == "random":
        p = rng.integers(0, 2**63, n, dtype=np.uint64)
        p[: n // 2] = p[n // 2:][: n // 2] ^ np.uint64(5)
    elif kind == "cluster":  # many points a few bits from few centres
        p = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, n)]
        for _ in range(3):
            p = p ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    else:
        p = rng.integers(0, 2**14, n, dtype=np.uint64)
    p = np.unique(p)
    root = {int(x): int(x) for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in S.local_links(p, 2):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    mine = [find(int(x)) for x in p]
    want = classes(p)
    assert len({*zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_top_tree_loses_no_pair(spark, monkeypatch):
    """Shards small enough to need several rounds of splitting."""
    monkeypatch.setattr(S, "SHARD_POINTS", 64)
    monkeypatch.setattr(S, "SHARD_LIMIT", 100)
    monkeypatch.setattr(S, "SAMPLE_BOUND", 300)
    rng = np.random.default_rng(2)
    p = rng.integers(0, 2**63, 700, dtype=np.uint64)
    p = np.unique(np.concatenate([p, p[:300] ^ np.uint64(3), p[:200] ^ np.uint64(1 << 40),
                                  p[:100] ^ np.uint64(7)]))
    points = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    got = {r.fp: r.group for r in S.fingerprint_groups(points).collect()}
    assert len(got) == len(p)
    mine = [got[int(x)] for x in p.view(np.int64)]
    want = classes(p)
    assert len({*zip(mine, want)}) == len(set(mine)) == len(set(want))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_dense_shard_without_a_split(spark, monkeypatch, radius):
    """Points a few bits around a centre, which no vantage point splits, beside others."""
    monkeypatch.setattr(S, "SHARD_POINTS", 64)
    monkeypatch.setattr(S, "SHARD_LIMIT", 100)
    monkeypatch.setattr(S, "SAMPLE_BOUND", 1000)
    rng = np.random.default_rng(4)
    far = rng.integers(0, 2**63, 60, dtype=np.uint64)
    ball = np.full(900, far[0], np.uint64)
    for _ in range(4):  # some of them linked, some not
        ball ^= np.uint64(1) << rng.integers(0, 64, len(ball)).astype(np.uint64)
    p = np.unique(np.concatenate([far, far[:20] ^ np.uint64(1), ball, ball[:100] ^ np.uint64(1 << 63)]))
    points = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    assert radius != 2 or S._split_shards(points, radius)[1]
    want = classes(p, radius)
    for edges in (S.link_edges(points, radius), S._dense_edges(points, radius)):
        got = {r.node: r.root for r in components(edges).collect()}
        mine = [got.get(int(x), int(x)) for x in p.view(np.int64)]
        assert len({*zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_few_copies_of_random_fingerprints(spark):
    """What is shuffled: each of 262,144 fingerprints in fewer than three shards."""
    points = spark.range(1 << 18).select(F.xxhash64("id").alias("fp"))
    shards, dense = S._split_shards(points, 2)
    assert not dense and shards.select("shard").distinct().count() >= 8
    assert shards.count() < 3 << 18


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


BASE = " ".join(f"word{i % 50}" for i in range(400))
TEXTS = ["", None, "  ", BASE, BASE.upper(), BASE + " word3", "other text of its own", "ab", "AB"]


def test_small_table_with_odd_rows(rows):
    data = [(i + 3, t) for i, t in enumerate(TEXTS)] + [(None, BASE), (None, "lonely null"), (3, ""), (6, BASE)]
    docs = rows(DOC, *[(i, t, "clash", 1, None) for i, t in data])
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()]
    prints = [print_of(t) for _, t in data]
    group = classes(prints)
    low = {}
    for (i, _), g in zip(data, group):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    want = [(i, f"{p:016x}", low.get(g)) for (i, _), p, g in zip(data, prints, group)]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == len(set(group)) and all(r.fp == "clash" for r in kept)
    assert {classes(prints)[next(k for k, d in enumerate(data) if d == (r.doc_id, r.text))] for r in kept} \
        == set(group)
    assert S.near_duplicates(docs.limit(0)).collect() == [] == S.deduplicate(docs.limit(0)).collect()


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    group = classes([print_of(t) for _, t in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.query(spark, sf).collect()}
    assert got == {i: (f"{print_of(t):016x}", docs[g][0]) for (i, t), g in zip(docs, group)}
