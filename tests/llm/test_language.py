import random
import zlib

import numpy as np
import pytest

from crowdtally.llm import language as G

DOC = "doc_id long, text string, lang string, score string, lang_pred string"
SYLLABLES = {"aa": "ka mo ti ru", "bb": "sch ung be ver", "cc": "lle qui eau tre"}


def say(lang, n, rnd):
    return " ".join("".join(rnd.choice(SYLLABLES[lang].split()) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus(n=240, seed=1):
    rnd = random.Random(seed)
    return [(i, say(l, rnd.randint(5, 60), rnd), l) for i, l in enumerate(["aa", "bb", "cc"] * (n // 3))]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    return G.train(docs)


def test_em_against_one_document_at_a_time():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 7, 40, 3])
    log = rng.normal(-8, 3, (sizes.sum(), 3))
    share, value = G.mixtures(log, sizes, np.ones((4, 3)), rounds=30)
    at = 0
    for d, n in enumerate(sizes):
        own, p = np.exp(log[at:at + n]), np.full(3, 1 / 3)
        at += n
        for _ in range(2000):
            w = own * p
            p = (w / w.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.abs(share[d] - p).max() < 0.02
        assert abs(value[d] - np.log((own * p).sum(axis=1)).sum()) < 0.05


def test_mixtures_keep_the_languages_that_pay(model):
    rnd = random.Random(5)
    words = G.Words(model)
    mixed = say("aa", 70, rnd) + " " + say("cc", 30, rnd)
    flat = mixed.split()
    share = G.infer(words.rows[words.ids(flat)], np.array([len(flat)]))[0]
    assert model.languages == ["aa", "bb", "cc"]
    assert abs(share[0] - 0.7) < 0.05 and share[1] == 0 and abs(share[2] - 0.3) < 0.05
    pure = say("bb", 100, rnd).split()
    assert G.infer(words.rows[words.ids(pure)], np.array([100]))[0].tolist() == [0, 1, 0]
    (lang, score), = G.classify([mixed], words)
    assert lang == "aa" and abs(score - 0.7) < 0.05


def test_more_than_four_languages_in_a_document():
    log = np.full((120, 7), -30.0)
    log[np.arange(120), np.arange(120) % 6] = -5.0
    share = G.infer(log, np.array([120]))[0]
    assert np.abs(share[:6] - 1 / 6).max() < 0.01 and share[6] == 0


def test_slices_and_full_caches_do_not_matter(model):
    rnd = random.Random(6)
    texts = [say(rnd.choice(list(SYLLABLES)), rnd.randint(0, 30), rnd) for _ in range(60)] + [None, "", "12 34"]
    whole = G.classify(texts, G.Words(model))
    small = G.classify(texts, G.Words(model, limit=10), slice_chars=100)
    assert [g[0] for g in whole] == [g[0] for g in small]
    assert np.allclose([g[1] for g in whole], [g[1] for g in small], atol=1e-9, rtol=0)


def test_a_text_gets_the_same_alone_and_among_others(model):
    rnd = random.Random(12)
    texts = [" ".join(say(rnd.choice(list(SYLLABLES)), rnd.randint(1, 9), rnd) for _ in range(rnd.randint(1, 4)))
             for _ in range(400)]
    words = G.Words(model)
    alone = [G.classify([t], words)[0] for t in texts]
    for got, want in zip(G.classify(texts, words), alone):
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9


def test_em_runs_until_it_has_settled(model):
    rng = np.random.default_rng(4)
    sizes = np.array([500, 30])
    log = rng.normal(-8, 0.3, (530, 3))      # words that hardly tell the languages apart
    share, value = G.mixtures(log, sizes, np.ones((2, 3)))
    more, better = G.mixtures(log, sizes, np.ones((2, 3)), rounds=100_000)
    assert np.array_equal(share, more) and np.array_equal(value, better)


def chosen(log, penalty=G.PENALTY):
    """The language set of one document, a language and a word at a time."""
    def em(allowed):
        p = {l: 1 / len(allowed) for l in allowed}
        for _ in range(20_000):
            new = dict.fromkeys(allowed, 0.0)
            for row in log:
                w = {l: p[l] * np.exp(row[l] - max(row)) for l in allowed}
                total = sum(w.values())
                for l in allowed:
                    new[l] += w[l] / total / len(log)
            moved = max(abs(new[l] - p[l]) for l in allowed)
            p = new
            if moved < 1e-7:
                break
        value = sum(np.log(sum(p[l] * np.exp(row[l]) for l in allowed)) for row in log)
        return p, value

    k = len(log[0])
    order = sorted(em(range(k))[0].items(), key=lambda x: (-x[1], x[0]))
    order = [l for l, _ in order]
    best, value = em(order[:1])
    for m in range(2, k + 1):
        p, v = em(order[:m])
        v -= (m - 1) * penalty * 0.5 * np.log(len(log) + 1)
        if v <= value:
            break
        best, value = p, v
    return best


def test_language_sets_of_documents_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    model = G.train(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"))
    words, rnd = G.Words(model), random.Random(3)
    texts = [" ".join(r.text.split()[:60]) for r in docs[:25]]
    texts += [" ".join(rnd.sample(a.split() + b.split(), 20)) for a, b in zip(texts, texts[1:])]
    several = 0
    for text, (lang, score) in zip(texts, G.classify(texts, words)):
        ids = words.ids(text.split())
        best = chosen(words.rows[ids[words.lettered[ids]]].astype(float).tolist())
        top = max(best, key=lambda l: (best[l], -l))
        several += len(best) > 1
        assert abs(score - best[top]) < 2e-3
        assert model.languages[top] == lang or abs(best[top] - sorted(best.values())[-2]) < 2e-3
    assert several > 3


@pytest.mark.parametrize("text", ["² ½", "Ⅷ", "¾", "①②", "123", "_", "٣", "", None, " \n"])
def test_numerals_are_no_letters(model, text):
    assert G.classify([text], G.Words(model)) == [("und", 0.0)]


@pytest.mark.parametrize("text", ["ª", "漢", "x²", "Ⅷa", "五"])
def test_letters_of_any_script_are(model, text):
    assert G.classify([text], G.Words(model))[0][0] in model.languages


def test_held_out_accuracy(rows, model):
    data = corpus(seed=9)
    docs = rows(DOC, *[(i, t, None, "clash", "clash") for i, t, _ in data])
    got = {r.doc_id: r for r in G.predict(docs, model).collect()}
    assert sum(got[i].lang_pred == l for i, _, l in data) >= 0.99 * len(data)
    assert all(0 < r.score <= 1 for r in got.values())


def test_only_documents_that_are_not_held_out_teach(spark):
    data = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 3 == 1 else l) for i, t, l in corpus()]
    assert G.train(spark.createDataFrame(data, "doc_id long, text string, lang string")).languages == ["aa", "bb", "cc"]


def test_small_table_with_odd_rows(rows, model):
    texts = ["", None, "123 !? 45", "kamo tiru", "kamo tiru", "schung " * 60_000, "漢字 かな", "x"]
    docs = rows(DOC, *[(i if i != 4 else None, t, None, "clash", "clash") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.predict(docs, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3] == got[None] and got[3][0] == "aa"
    assert got[5][0] == "bb" and got[6][0] in model.languages and len(got) == 8
    assert G.predict(docs.limit(0), model).collect() == []
    untaught = G.train(docs.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in G.predict(docs, untaught).collect()} == {"und"}


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = G.query(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
