import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from crowdtally.llm import source_audit as A

DOC = "text string, lang string, source string, term string, n string, rank string, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, least, top=A.TOP_TERMS):
    docs = [((t or ""), (l or ""), (s or "")) for t, l, s in data]
    uses, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, l, s in docs:
        words = [w.translate(LOWER) for w in TERM.findall(t)]
        uses[l, s].update(words)
        df[l].update(set(words))
        groups[l].add(s)
    out = []
    for l, sources in groups.items():
        kept = sorted(w for w, n in df[l].items() if n >= least)

        def shares(count):
            n = sum(count[w] for w in kept)
            return {w: 1 + (10**9 * (count[w] + 5)) // (n + 5 * len(kept)) for w in kept}

        p = {s: shares(uses[l, s]) for s in sources}
        q = shares(sum((uses[l, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if uses[l, s][w] and p[s][w] > q[w]]
            for part, lines, most in (("pair", pairs, None), ("term", terms, top)):
                lines.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(l, s, part, item, value, i + 1) for i, (value, item) in enumerate(lines[:most])]
    return sorted(out)


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def made(n, sources, words, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        s = draw.choice(sources)
        own = [draw.choice(words[:draw.choice([3, 20, len(words)])]) for _ in range(draw.randint(0, 60))]
        out.append((draw.choice([" ", ", ", "\n", "1-"]).join(own), draw.choice(["en", "de", None]), s))
    return out


WORDS = ["the", "The", "a", "ab", "abcdefgh", "abcdefghi", "abcdefgh" * 2, "abcdefgh" * 2 + "x", "straße", "STRASSE", "É", "é",
         "漢字", "漢", "🙂", "z" * 300, "z" * 299 + "y", "q" * 5000] + [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
ODD = [(None, None, None), ("", "en", "empty"), (None, "en", None), ("123 ... 456", "en", "digits"), ("the the", "xx", "lonely"),
       ("a`b[c]d{e}f~g@h", "en", "s1"), (" x ", "de", "s1"), ("word " * 40_000 + "q" * 60_000, "en", "s2")]


@pytest.mark.parametrize("slice_bytes", [1, 3000, A.SLICE_BYTES])
@pytest.mark.parametrize("least", [1, 4, 10_000])
def test_small_corpus_against_brute_force(rows, slice_bytes, least):
    data = made(150, ["s1", "s2", "s3", None, "é"], WORDS) + ODD + ODD[4:5] * 3
    docs = rows(DOC, *[(*d, "clash", "clash", "clash", "clash") for d in data])
    assert result(A.audit(docs, least_docs=least, slice_bytes=slice_bytes)) == brute(data, least)


def test_blocks_of_sources_and_terms(rows, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_SOURCES", 4)
    monkeypatch.setattr(A, "BLOCK_TERMS", 16)
    data = made(200, [f"s{i}" for i in range(11)], WORDS, seed=2) + [("", "en", f"none{i}") for i in range(3)]
    docs = rows("text string, lang string, source string", *data)
    assert result(A.audit(docs, least_docs=3)) == brute(data, 3)


def test_empty_table_and_no_terms(rows):
    docs = rows("text string, lang string, source string", ("1", "en", "a"), ("", "en", "b"))
    assert result(A.audit(docs)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert result(A.audit(docs.limit(0))) == []


@pytest.mark.parametrize("small", [100, A.SMALL])
def test_pointer_sort_orders_all_words(monkeypatch, small):
    monkeypatch.setattr(A, "SMALL", small)
    draw = random.Random(3)
    texts = [" ".join(draw.choice(WORDS + ["zz" * k for k in range(40)]) for _ in range(400)).encode() for _ in range(20)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    words = A.Pointers(data, np.cumsum([len(t) for t in texts]))
    order, first = words.sort()
    got = [words.word(i) for i in order.tolist()]
    want = sorted(w.translate(LOWER).encode() for t in texts for w in TERM.findall(t.decode()))
    assert got == want
    assert first.tolist() == [i == 0 or want[i] != want[i - 1] for i in range(len(want))]


def test_documents_do_not_run_into_each_other():
    data = np.frombuffer(b"abcdef", np.uint8)
    words = A.Pointers(data, np.array([2, 2, 3, 6]))
    assert [words.word(i) for i in range(3)] == [b"ab", b"c", b"def"]


def test_slices_take_whole_documents_from_any_buffer():
    texts = ["abc", "", None, "de" * 50, "x", "éé"]
    whole = pa.record_batch({"text": pa.array(["skipped", *[t or "" for t in texts], "cut"])}).slice(1, 6)
    for limit in (1, 5, 1000):
        got = []
        for data, ends, held in A.slices([whole, whole], limit):
            assert len(ends) == sum(b.num_rows for b in held)
            got += [data[a:b].tobytes().decode() for a, b in zip([0, *ends], ends)]
        assert got == [t or "" for t in texts] * 2


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F
    got = spark.range(1).select(A.share(F.lit(10**15), F.lit(3 * 10**15), F.lit(10**9)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 5 * 10**9)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert result(A.query(spark, sf)) == sorted(con.execute(A.ORACLE).fetchall())
