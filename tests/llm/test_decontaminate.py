import hashlib
import random
import re

import pytest

from crowdtally.llm import decontaminate as D

DOC = "doc_id long, text string, lang string, n_hit string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items, window=13):
    """(words, hit flags, ids of items with an occurring window)"""
    words = WORD.findall(lower(text))
    hit, found = [False] * len(words), set()
    for item_id, t in items:
        own = WORD.findall(lower(t))
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == own[k:k + n]:
                    hit[i:i + n] = [True] * n
                    found.add(item_id)
    return words, hit, found


def expected(text, items):
    words, hit, found = brute(text, items)
    names = sorted(str(i) for i in found if i is not None)
    return (len(words), sum(hit), len(names),
            hashlib.sha256(",".join(names).encode()).hexdigest(),
            sum(hit) > 0 and 20 * sum(hit) >= len(words))


@pytest.mark.parametrize("seed", range(30))
def test_automaton_against_brute_force(seed):
    rnd = random.Random(seed)
    abc = "abcdefghij"[:rnd.choice([2, 3, 10])]
    window = rnd.choice([2, 3, 5])
    least = rnd.choice([0, 1, window])
    items = [(k, " ".join(rnd.choice(abc) for _ in range(rnd.randint(least, 9))))
             for k in range(rnd.randint(1, 6))]
    auto = D.Automaton([(i, D.words_of(t)) for i, t in items], window)
    for _ in range(30):
        text = " ".join(rnd.choice(abc + "zZ") for _ in range(rnd.randint(0, 25)))
        if rnd.random() < 0.5:
            text += " " + rnd.choice(items)[1] + " " + text
        words, hit, found = brute(text, items, window)
        spans, got = auto.match(D.words_of(text))
        flags = [False] * len(words)
        for a, b in spans:
            flags[a:b] = [True] * (b - a)
        assert (flags, got) == (hit, found)


def test_words_follow_the_pattern():
    text = "Ab-c É1_x 漢字'q\x00r\x7fs t ñ" + "".join(map(chr, range(300)))
    assert [w.decode() for w in D.words_of(text)] == WORD.findall(lower(text))


ITEM = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, ITEM), (10, ITEM.upper()), (2, "short item"), (3, None), (4, ""), (None, "lonely word here")]
TEXTS = ["", None, "clean text of no interest", "some Short, item!", ITEM, "x " * 400 + ITEM,
         " ".join(f"w{i}" for i in range(12)), "lonely word here", "x " * 3000 + "short item",
         "y " * 50_000 + ITEM]


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256,
                   r.contaminated) for r in df.collect())


def query_over(docs, bench, block):
    from pyspark.sql import functions as F
    rows = D.match_benchmark(docs, bench, block_words=block, keep=["doc_id"])
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                       D.contaminated().alias("contaminated"))


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 21])
def test_small_table_with_odd_rows(rows, block):
    data = [(k, t, None, "clash") for k, t in enumerate(TEXTS)] + [(None, ITEM, "en", None), (4, ITEM, "en", None)]
    docs, bench = rows(DOC, *data), rows("item_id long, text string", *ITEMS)
    want = sorted((d[0] is None, d[0] or 0, *expected(d[1], ITEMS)) for d in data)
    assert result(query_over(docs, bench, block)) == want


def test_empty_tables(rows):
    docs, bench = rows(DOC, (1, ITEM, None, None)), rows("item_id long, text string", *ITEMS)
    assert result(query_over(docs.limit(0), bench, 100)) == []
    assert result(query_over(docs, bench.limit(0), 100))[0][2:5] == (20, 0, 0)


def test_removal_keeps_clean_rows_and_cuts_spans(rows):
    data = [(k, t, "en", "clash") for k, t in enumerate(TEXTS)]
    docs, bench = rows(DOC, *data), rows("item_id long, text string", *ITEMS)
    out = {r.doc_id: r for r in D.remove_contamination(docs, bench).collect()}
    for k, t in enumerate(TEXTS):
        assert (k in out) == (not expected(t, ITEMS)[4])
    assert out[2].text == TEXTS[2] and out[0].text == "" and out[1].text is None
    assert out[2].n_hit == "clash"
    assert out[8].text == "x " * 3000
    assert out[5].text == "x " * 400 if 5 in out else True


def test_query_against_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {}
    for i, t in items:
        own = WORD.findall(lower(t))
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            grams.setdefault(tuple(own[k:k + n]), set()).add(i)
    sizes = {len(g) for g in grams}
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = WORD.findall(lower(r.text))
        hit, found = [False] * len(words), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                own = grams.get(tuple(words[i:i + n]))
                if own:
                    hit[i:i + n] = [True] * n
                    found |= own
        names = sorted(map(str, found))
        want.append((False, r.doc_id, len(words), sum(hit), len(names),
                     hashlib.sha256(",".join(names).encode()).hexdigest(),
                     sum(hit) > 0 and 20 * sum(hit) >= len(words)))
    got = result(D.query(spark, sf))
    assert got == sorted(want) and any(g[6] for g in got)


def test_query_against_its_oracle(spark):
    import duckdb
    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = D.query(spark, sf)
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({D.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
