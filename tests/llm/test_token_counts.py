import math
import random

import pytest

from crowdtally.llm import token_counts as C
from crowdtally.llm.byte_bpe import _field

DOC = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def scores():
    return C.piece_scores(C.default_model())


def brute(word, scores):
    """Best (score, -tokens) over all segmentations, without sharing."""
    floor = min(scores.values()) - C.UNKNOWN
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:end]], best[s][1] - 1)
                   for s in range(end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            n = len(word[end - 1].encode())
            options.append((best[end - 1][0] + n * floor, best[end - 1][1] - n))
        best.append(max(options))
    return best[-1][0], -best[-1][1]


def test_trie_against_plain_dynamic_programming(scores):
    rnd = random.Random(4)
    stems = ["the", "tion", "un", "berg", "é", "漢", "🙂", "x", "1", "!!", "ing"]
    words = ["".join(rnd.choice(stems) for _ in range(rnd.randint(1, 7))) for _ in range(500)]
    counter = C.Counter(scores)
    got = counter.insert([C.MARK + w for w in words])
    for w, (s, n) in zip(words, got):
        want = brute(C.MARK + w, scores)
        assert n == want[1] and math.isclose(s, want[0])


def test_tokens_against_the_library_s_unigram_model(scores):
    """The same pieces and scores as a sentencepiece unigram model give the same counts."""
    import sentencepiece
    parts = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    parts += [_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, 1))
              for p, s in scores.items()]
    model = b"".join(parts) + _field(2, _field(3, 1) + _field(4, len(scores) + 1)) + _field(
        3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    got = C.Counter(scores).count(words)
    same = sum(g[1] == len(sp.encode(w)) for g, w in zip(got, words))
    assert same >= 398  # the library adds up in single precision: near ties may differ


def test_small_table_with_odd_rows(rows, scores):
    texts = ["", None, " \n\t ", "hello the world", "hello the world", "a " * 100_000, "漢" * 5000, "z" * 200_000]
    docs = rows(DOC, *[(i if i != 4 else None, t, "clash") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in C.count_tokens(docs).collect()}
    assert len(got) == len(texts) and got[0] == got[1] == got[2] == (0, 0)
    assert got[3] == got[None] and got[3][0] == 3
    assert got[5] == (100_000, 100_000 * brute(C.MARK + "a", scores)[1])
    for i in (6, 7):
        assert got[i] == (1, C.Counter(scores).count([texts[i]])[0][1])
    assert C.count_tokens(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark, scores):
    sf = "/root/testdata/sf0.001"
    known, want = {}, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = s = 0
        for w in r.text.split():
            if w not in known:
                known[w] = brute(C.MARK + w, scores)
            s, n = s + known[w][0], n + known[w][1]
        want[r.doc_id] = (len(r.text.split()), n, s)
    got = C.query(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_pretokens, r.n_tokens) == w[:2] and math.isclose(r.score, w[2], rel_tol=1e-9)
