import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from crowdtally.llm import packing as P

DOC = "doc_id long, text string, offset string, ids string, sequence_id string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [P.END_ID]


def check(pieces, documents, size=P.SIZE, padding=0):
    """The contract's laws for all pieces; ``documents``: the ids of each, a list by doc_id."""
    whole, windows = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        whole[r["doc_id"], r["doc_tokens"]].append((r["start"], ids.tolist()))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc_id, many in documents.items():
        for ids in many:
            want[doc_id, len(ids)] += ids
    assert {k: sorted(x for _, ids in v for x in ids) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
    for (doc_id, n), parts in whole.items():
        if len(documents[doc_id]) == 1:        # its pieces follow each other without gaps
            assert [x for _, ids in sorted(parts) for x in ids] == documents[doc_id][0]
            assert sum(len(ids) for _, ids in parts) == n
    padded = 0
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
        padded += 0 if at & (at - 1) == 0 else size - at
    assert padded <= padding
    return windows


TEXTS = ["", None, "Hello world", "The quick  brown\n\nfox's <|endoftext|> é漢字🙂", "x y " * 9_000, "q" * 20_000]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_odd_rows_over_partitions(rows, library, parts):
    data = [(10 - i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "word " * (i * 37 % 700)) for i in range(120)]
    data += [(None, "no id")]
    docs = rows(DOC, *[(i, t, "clash", "clash", "clash") for i, t in data]).repartition(parts)
    got = P.pack(docs).collect()
    windows = check(got, {i: [ids_of(library, t)] for i, t in data})
    total = sum(len(ids_of(library, t)) for _, t in data)
    assert total // P.SIZE <= len(windows) <= total // P.SIZE + 11


def test_repeated_and_null_ids(rows, library):
    data = [(None, "a b c"), (None, ""), (7, "again and again"), (7, "again and again"), (7, None)]
    documents = defaultdict(list)
    for i, t in data:
        documents[i].append(ids_of(library, t))
    check(P.pack(rows("doc_id long, text string", *data)).collect(), documents)


def test_empty_table(rows):
    docs = rows("doc_id long, text string", (1, "x")).limit(0)
    assert P.pack(docs).collect() == []


def test_small_windows_merge_over_several_rounds(rows, library, monkeypatch):
    monkeypatch.setattr(P, "FAN", 2)
    data = [(i, "word " * (i * 13 % 60)) for i in range(200)]
    docs = rows("doc_id long, text string", *data).repartition(9)
    got = P.pack(docs, size=64, most_open=3).collect()
    windows = check(got, {i: [ids_of(library, t)] for i, t in data}, size=64)
    assert {w // P.ROUND_STEP for w in windows} >= {0, 1, 4}


def naive(pieces, size, most, shortest):
    """Best fit over plain lists: windows of (name, start, length) in the order emitted, then open ones."""
    out, held = [], []
    for name, n in pieces:
        at = 0
        while n - at >= size:
            out.append([(name, at, size)])
            at += size
        while at < n:
            free = [size - sum(x[2] for x in w) for w in held]
            fits = [i for i, f in enumerate(free) if f >= n - at]
            if fits:
                i = min(fits, key=lambda i: free[i])
            elif len(held) < most:
                held.append([])
                free.append(size)
                i = len(held) - 1
            else:
                i = min(range(len(held)), key=lambda i: free[i])
            take = min(free[i], n - at)
            if take == n - at or take >= shortest:
                held[i].append((name, at, take))
                at += take
                if take < free[i] and at == n:
                    continue
            out.append(held.pop(i))
    return out, held


@pytest.mark.parametrize("shortest", [1, 4])
def test_best_fit_like_the_naive_packer(shortest):
    draw = random.Random(5)
    for _ in range(200):
        size, most = draw.choice([8, 16, 50]), draw.randint(1, 5)
        lengths = [(i, draw.choice([1, 2, 3, draw.randint(1, 3 * size)])) for i in range(draw.randint(0, 60))]
        windows, got = P.Windows(2, size, most, shortest), []
        for name, n in lengths:
            for done in windows.place((name, 0, bytes(2 * n), n)):
                got.append(sorted((p[0], p[1], len(p[2]) // 2) for p in done))
            assert len(windows.free) <= most
        want, held = naive(lengths, size, most, shortest)
        # Equally full windows are interchangeable: compare what is emitted by fill and size.
        assert [sum(x[2] for x in w) for w in got] == [sum(x[2] for x in w) for w in want]
        if shortest == 1:
            assert all(sum(x[2] for x in w) == size for w in got)
        assert sorted(f for f, _ in windows.free) == sorted(size - sum(x[2] for x in w) for w in held)
        ends = [sum(len(p[2]) // 2 for p in w) for w in windows.close()]
        assert not windows.free and all(n == size or n & (n - 1) == 0 for n in ends)
        assert sum(ends) + sum(sum(x[2] for x in w) for w in got) == sum(n for _, n in lengths)


def test_gaps_shorter_than_a_cut_are_padded(rows, library):
    data = [(i, "word " * (i * 37 % 900)) for i in range(150)]
    got = P.pack(rows("doc_id long, text string", *data), most_open=4, shortest_cut=64).collect()
    total = sum(len(ids_of(library, t)) for _, t in data)
    check(got, {i: [ids_of(library, t)] for i, t in data}, padding=total // 30)
    cut = [r for r in got if r["start"] + r["length"] < r["doc_tokens"] and r["sequence_id"] < P.ROUND_STEP]
    assert all(r["length"] >= 64 for r in cut)


def test_sequences_hold_the_pieces_in_place(rows, library):
    data = [(i, "some words " * (i * 7 % 300)) for i in range(60)]
    pieces = P.pack(rows("doc_id long, text string", *data))
    made = {r.sequence_id: r for r in P.sequences(pieces, 2).collect()}
    for r in pieces.collect():
        own = made[r["sequence_id"]]
        assert own["ids"][r["offset"]:r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u2").tolist()
    assert sum(r["length"] for r in made.values()) == sum(len(ids_of(library, t)) for _, t in data)


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    documents = {r.doc_id: ids_of(library, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = P.query(spark, sf).collect()
    assert list(got[0].asDict()) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    spans = defaultdict(list)
    for r in got:
        part = np.array(documents[r.doc_id][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(documents[r.doc_id])
        spans[r.doc_id].append((r.start, r.length))
    for doc_id, ids in documents.items():
        at = 0
        for start, length in sorted(spans[doc_id]):
            assert start == at
            at += length
        assert at == len(ids)
