import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from crowdtally.llm import byte_bpe as B
from crowdtally.llm.common import PieceCache

DOC = "doc_id long, text string, ids string, n_tokens long"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_random_texts_against_the_library(library):
    rnd = random.Random(2)
    parts = ["the", "tion", " ", "  ", "\n", "\t", "é", "漢字", "🙂", "'s", "'ll", "'", "12", "½", "٣", "\x1c", "\x85",
             "　", "!", "--", "_", "<|endoftext|>", "Ünï", "́", "ﬀ", "​", "a" * 40]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(6000)]
    bpe = B.codec(PATH, P.PATTERN)
    for t, ids in zip(texts, bpe.encode(texts)):
        assert ids == packed(library.encode_ordinary(t)), t
        assert bpe.decode(ids) == t.encode()


def test_every_character_is_cut_as_the_library_cuts_it(library):
    """Each code point between letters, digits and spaces, in texts of a thousand."""
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(f"ab{chr(c)}1 {chr(c)}{chr(c)} x" for c in points[k:k + 1000])
             for k in range(0, len(points), 1000)]
    for t, ids in zip(texts, B.codec(PATH, P.PATTERN).encode(texts)):
        assert ids == packed(library.encode_ordinary(t)), hex(ord(t[2]))


def test_long_pre_tokens(library):
    texts = ["ab" * 40_000, " " * 50_000, "漢" * 20_000, "x " * 100_000]
    bpe = B.codec(PATH, P.PATTERN)
    for t, ids in zip(texts, bpe.encode(texts)):
        assert ids == packed(library.encode_ordinary(t)) and bpe.decode(ids) == t.encode()


def test_cache_gives_the_same_when_it_overflows(library):
    bpe = B.codec(PATH, P.PATTERN)
    small = PieceCache(bpe.cache.split, bpe._encode, limit=20, slice_chars=60)
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randint(0, 200)}," for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    assert small.look_up(texts) == [packed(library.encode_ordinary(t)) for t in texts]


TEXTS = ["", None, "Hello  world\n", "Hello  world\n", " é漢", "z" * 100_000]


def test_small_table_with_odd_rows(rows, library):
    data = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)]
    docs = rows(DOC, *[(i, t, "clash", 7) for i, t in data])
    want = sorted((i is None, i or 0, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t in data for ids in [packed(library.encode_ordinary(t or ""))])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in B.digests(docs).collect())
    assert got == want
    back = B.decode(B.encode(docs)).collect()
    assert sorted((bytes(r.decoded), r.n_tokens) for r in back) == sorted(((t or "").encode(), 7) for _, t in data)
    assert B.digests(docs.limit(0)).collect() == []


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = B.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = packed(library.encode_ordinary(texts[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
