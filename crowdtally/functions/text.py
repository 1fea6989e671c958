"""Text helpers as native Spark expressions (no Python UDF).

``slug`` restates the reference's category-type normaliser: Unicode NFD,
combining accents U+0300-U+036F removed, lower case, trimmed, whitespace runs
to '-', only ``[a-z0-9_-]`` kept, digits removed, '-' runs collapsed and
trimmed, first 30 characters.

Spark has no NFD, so the accent step is a ``translate`` table built here from
Python's ``unicodedata`` (a rule, not a list): every BMP code point whose
decomposition, without U+0300-U+036F and lower-cased, keeps exactly one
character of ``[a-z0-9_-]`` maps to that character.  Everything else that is
not whitespace is removed by the later character filter, as in the original.
No code point above the BMP decomposes to a slug character (checked over all
of them), so the table covers every input.
Whitespace is the JavaScript ``\\s`` set, spelled out because Java's ``\\s`` is
ASCII only.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JavaScript whitespace set and the slug's limits.
JS_WHITESPACE = ("\t\n\u000b\u000c\r\u0020\u00a0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000\ufeff")
SLUG_MAX = 30
TYPE_PATTERN = "^[a-z][a-z_-]{1,29}$"

_ALLOWED = set("abcdefghijklmnopqrstuvwxyz0123456789_-")


def _build_translate() -> tuple[str, str]:
    src, dst = [], []
    for cp in range(0x10000):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or ch in JS_WHITESPACE:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) <= 0x36F).lower()
        kept = [c for c in base if c in _ALLOWED]
        if len(kept) == 1 and kept[0] != ch:
            src.append(ch)
            dst.append(kept[0])
    return "".join(src), "".join(dst)


TRANSLATE_FROM, TRANSLATE_TO = _build_translate()


def slug(col: Column | str) -> Column:
    """The category-type slug of ``col`` (null -> '').

    Same result as the eight-step original with fewer passes: one
    ``translate`` maps accented letters to their base and every whitespace
    character to '-'; one regex drops everything outside ``[a-z_-]`` (the
    original drops ``[^a-z0-9_-]`` and then digits); '-' runs are collapsed and
    trimmed.  Trimming whitespace first is subsumed by trimming '-' last."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    s = F.translate(c, TRANSLATE_FROM + JS_WHITESPACE, TRANSLATE_TO + "-" * len(JS_WHITESPACE))
    s = F.regexp_replace(s, "[^a-z_-]+", "")
    s = F.regexp_replace(s, "-{2,}", "-")
    s = F.btrim(s, F.lit("-"))
    return F.substring(s, 1, SLUG_MAX)


def type_valid(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(TYPE_PATTERN), F.lit(False))


def normalized_key(col: Column | str) -> Column:
    """``LOWER(TRIM(x))`` as in the question duplicate test."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.trim(c))
