"""Slug and type pattern against a plain-Python statement of the JavaScript rule."""

import re
import unicodedata

from pyspark.sql import functions as F

from crowdtally.functions import text as T

WS = "[" + re.escape(T.JS_WHITESPACE) + "]"


def js_slug(s):
    s = "" if s is None else s
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F)
    s = s.lower()
    s = re.sub(f"^{WS}+|{WS}+$", "", s)
    s = re.sub(f"{WS}+", "-", s)
    s = re.sub(r"[^a-z0-9_-]", "", s)
    s = re.sub(r"[0-9]+", "", s)
    s = re.sub(r"-+", "-", s)
    s = re.sub(r"^-+|-+$", "", s)
    return s[:30]


def _slugs(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return {r.i: r.out for r in df.select("i", T.slug("s").alias("out")).collect()}


def test_slug_examples(spark):
    cases = [" Temáticas 2024 !", "Sentimento", None, "", "ÇÃO  x", "a b", "--a--b--", "İstanbul",
             "éte", "ﬁx", "Ａ", "x" * 50, "12 34", "a_b-c", " lead", "KK"]
    got = _slugs(spark, cases)
    for i, v in enumerate(cases):
        assert got[i] == js_slug(v), (v, got[i], js_slug(v))
    assert got[0] == "tematicas"


def test_slug_every_bmp_char_in_context(spark):
    chars = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    values = [f" A{c}b {c}" for c in chars[::3]] + [f"{c}z" for c in chars[1::3]] + [f"q{c}" for c in chars[2::3]]
    got = _slugs(spark, values)
    bad = [(v, got[i], js_slug(v)) for i, v in enumerate(values) if got[i] != js_slug(v)]
    assert not bad, bad[:5]


def test_slug_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.select("text", T.slug("text").alias("out")).collect()
    assert rows
    for r in rows:
        assert r.out == js_slug(r.text)


def test_type_pattern(spark):
    df = spark.createDataFrame([("ab",), ("a",), ("tematicas",), ("a1",), ("_ab",), ("a" * 31,), (None,)], "s string")
    got = [r.v for r in df.select(T.type_valid("s").alias("v")).collect()]
    assert got == [True, False, True, False, False, False, False]
    assert F is not None
