import hashlib
import re

import duckdb
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crowdtally.llm import fill_middle as M

DOC = "doc_id long, text string, n string, output string, H1 string"
UNITS = regex.compile(f"({M.LINE})*")


def brute(doc_id, text, fim=100, spm=50):
    """The contract, unit by unit."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return doc_id, n, "plain", None, None, text, text
    k, m = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, mid, s = "".join(lines[:k]), "".join(lines[k:m]), "".join(lines[m:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(mid), f"<S>{s}<P>{p}<M>{mid}", text
    return doc_id, n, "psm", len(p), len(mid), f"<P>{p}<S>{s}<M>{mid}", text


def rows_of(df):
    got = df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output",
                    M.restore(F.col("output"), F.col("form")).alias("back")).collect()
    return sorted(map(tuple, got), key=repr)


TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "é漢🙂\n\r\nx y\n", "has <P> in it\nx", "<S>", "<M",
         "a<\nS>\n<\nP>", "x<P\n>y\n<S\n", "line\n" * 30_000, "w" * 100_000, "\x00\n\t"]


@pytest.mark.parametrize("fim,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_every_text_against_the_contract(rows, fim, spm):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (None, None), (3, "a\nb\nc"), (3, "a\nb\nc")]
    docs = rows(DOC, *[(i, t, "clash", "clash", "clash") for i, t in data])
    got = rows_of(M.transform(docs, fim_percent=fim, spm_percent=spm))
    assert got == sorted((brute(i, t, fim, spm) for i, t in data), key=repr)


def test_forms_and_cuts_all_occur(rows):
    docs = rows("doc_id long, text string", *[(i, "a\nbb\nccc") for i in range(400)])
    got = M.transform(docs).collect()
    assert {r.form for r in got} == {"psm", "spm"}
    assert {(r.prefix_chars, r.middle_chars) for r in got} == {
        (a, b - a) for a in (0, 2, 5, 8) for b in (0, 2, 5, 8) if b >= a}


def test_other_columns_are_kept_and_an_empty_table_gives_none(rows):
    docs = rows("doc_id long, text string, source string", (1, "x", "s"))
    assert M.transform(docs, keep=["source"]).columns == ["source", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert M.transform(docs.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab\n\r é"), max_size=40), st.integers(1, 9))
def test_blocks_end_where_units_end(text, block):
    ends = [m.end() for m in re.finditer(M.LINE, text)]
    assert M.unit_ends(UNITS, text, block) == ends == M.unit_ends(UNITS, text)


def test_many_units_in_one_text():
    ends = M.unit_ends(UNITS, "\n" * 5_000_000)
    assert len(ends) == 5_000_000 and ends[-1] == 5_000_000


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    res = con.execute(M.ORACLE)
    names = [d[0] for d in res.description]
    got = M.query(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(res.fetchall())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in got)
