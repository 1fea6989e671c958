import base64
import hashlib

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from crowdtally.llm import toxicity
from test_decontaminate import WORD, brute as hits, lower  # noqa: F401
from test_pii import brute as base_spans
from test_simhash import classes, print_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and of each stage's result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(docs.collect())
    return out


def by_id(rows):
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_toxic_documents_go(spark, stages):
    wanted = {r.doc_id for r in toxicity.query(spark, SF).where("predicted = 0").collect()}
    before = by_id(stages[0])
    assert by_id(stages[1]) == {i: before[i] for i in wanted}


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    group = classes([print_of(r.text) for r in rows])
    assert by_id(stages[2]) == {rows[g].doc_id: rows[g] for g in set(group)}


def test_contamination_goes(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k:k + 13]) for _, t in items for w in [WORD.findall(lower(t))]
             for k in range(max(1, len(w) - 12)) if w}
    after = by_id(stages[3])
    for r in stages[2]:
        words = WORD.findall(lower(r.text))
        hit = [False] * len(words)
        for n in {len(g) for g in grams}:
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in grams:
                    hit[i:i + n] = [True] * n
        if any(hit) and 20 * sum(hit) >= len(words):
            assert r.doc_id not in after
        else:
            left = [w for w, h in zip(words, hit) if not h]
            assert WORD.findall(lower(after[r.doc_id].text)) == left
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
            assert any(hit) or after[r.doc_id].text == r.text


def test_personal_data_is_replaced(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys()
    changed = 0
    for i, r in before.items():
        assert not base_spans(after[i].text) and after[i].n_chars == len(after[i].text)
        if base_spans(r.text):
            changed += 1
            assert after[i].text != r.text
    assert changed


def test_tokens_of_what_is_left(stages):
    import public_tokenizers as P
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(stages[5])
    assert len(got) == len(stages[4])
    for r in stages[4]:
        ids = np.array(enc.encode_ordinary(r.text), "<u4").tobytes()
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                        hashlib.sha256(r.text.encode()).hexdigest())


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[5])


WIDE = ("doc_id long, text string, lang string, source string, n_chars int, score string, fp string, spans int, "
        "component_id string, `a.b` string")


def test_stages_on_odd_tables(rows):
    text = " ".join(f"word{i % 90}" for i in range(500))
    data = [(1, text), (2, text), (1, text), (None, text), (3, None), (4, ""), (5, "you idiot scum moron trash"),
            (None, None), (6, "mail a@b.cd"), (7, "x " * 50_000), (8, "   ")]
    docs = rows(WIDE, *[(i, t, None, "s", 7, "clash", None, k, "clash", "dot") for k, (i, t) in enumerate(data)])
    spark = docs.sparkSession
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).collect() == []
        out = stage(spark, docs, SF)
        if n < 4:
            assert out.dtypes == docs.dtypes
            rest = [r for r in out.collect() if r.doc_id in (7, 8)]
            assert {r["a.b"] for r in rest} <= {"dot"} and {r.score for r in rest} <= {"clash"}
        docs = spark.createDataFrame(out.collect(), out.schema)
        got = sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i or 0))
        # The insult goes, then all but one of each group (3 stands for the empty ones).
        assert got == ([1, 1, 2, 3, 4, 6, 7, 8, None, None] if n == 0 else [1, 3, 6, 7])
    assert {r.doc_id: r.n_tokens for r in docs.collect()}[3] == 0
