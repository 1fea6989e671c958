import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from crowdtally.llm import shard as S

SCHEMA = "doc_id long, text string, shard string, size string, key int"


def key_of(t):
    return S.NULL_KEY if t is None else hashlib.md5(t.encode()).hexdigest()


def brute(texts, shards):
    """Group -> shard by the plain rules, group by group."""
    size = Counter()
    for t in texts:
        size[key_of(t)] += len((t or "").encode()) + 8
    total = sum(size.values())
    limit = total // (shards * S.LARGE_PER_SHARD) + 1
    large = sorted((k for k in size if size[k] > limit), key=lambda k: (-size[k], k))
    out, rest, left = {}, total, shards
    for k in large:
        if left == 1 or size[k] * left < rest:
            break
        out[k] = len(out)
        rest, left = rest - size[k], left - 1
    order = [k for k in large if k not in out] + sorted(set(size) - set(large))

    def cut(capacity):
        parts, load = [[]], 0
        for k in order:
            if load and load + size[k] > capacity:
                parts.append([])
                load = 0
            parts[-1].append(k)
            load += size[k]
        return parts

    capacity = max((size[k] for k in order), default=0)
    while len(cut(capacity)) > left:  # small data: every capacity in turn
        capacity += 1
    base = len(out)
    for n, part in enumerate(cut(capacity)):
        out |= {k: base + n for k in part}
    return out


def check(df, texts, ids, shards):
    got = df.collect()
    assert len(got) == len(texts)
    want = brute(texts, shards)
    slots, seen = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        assert want[r.group_key] == r.shard and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        seen[r.doc_id, r.size, r.text_crc32, r.group_key] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert seen == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), key_of(t))
                           for i, t in zip(ids, texts))


@pytest.mark.parametrize("n, shards, hot", [(400, 24, 0), (300, 5, 150), (7, 24, 0), (60, 3, 20)])
def test_against_group_by_group_walk(rows, n, shards, hot):
    rnd = random.Random(n)
    texts = ["x" * rnd.randint(0, 40) + str(rnd.randint(0, n)) for _ in range(n)] + ["hot é"] * hot
    texts += [None, None, "", "z" * 900]
    ids = [*range(len(texts) - 2), None, 3]
    docs = rows(SCHEMA, *[(i, t, "clash", None, 1) for i, t in zip(ids, texts)])
    check(S.shard_documents(docs, shards), texts, ids, shards)


def test_blocks_refined_to_single_groups(rows, monkeypatch):
    monkeypatch.setattr(S, "FIRST_DIGITS", 1)
    texts = [f"text {i} " + "y" * (i * 7 % 50) for i in range(900)]
    docs = rows(SCHEMA, *[(i, t, None, None, None) for i, t in enumerate(texts)])
    check(S.shard_documents(docs, 24), texts, range(900), 24)


def test_empty_and_one_text(rows):
    docs = rows(SCHEMA, *[(i, "same", None, None, None) for i in range(50)])
    assert S.shard_documents(docs.limit(0)).collect() == []
    check(S.shard_documents(docs), ["same"] * 50, range(50), 24)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check(S.query(spark, sf), [d.text for d in docs], [d.doc_id for d in docs], 24)
