"""Fill-in-middle transformation by repeated-capture matching.

A text is cut into units (lines by default).  One ``fullmatch`` of ``(unit)*`` keeps
every repetition of its group, so the group's ends are the ends of all units: their
number is ``n``, and a cut after unit k lies at the k-th end.  No unit is looked at by
Python code.

A document's draws are the first four 8-digit groups of the SHA-256 of
``<seed>:<key>``, so they depend on the key alone and are the same wherever and how
often a task runs.  The smaller of the first two draws (modulo n + 1) ends the prefix,
the larger one the middle.  The third decides whether the text is transformed at all
(``fim_percent``), the fourth between the forms ``spm`` (``spm_percent``) and ``psm``.

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* plain: the text as it is; always for an empty text and for one that contains a
  sentinel, so that ``restore`` gives back each text exactly.

Very long texts: the matcher keeps some 100 bytes a unit, so a text of more than
``BLOCK`` characters is matched in blocks of about that many, each of which ends at
the end of a unit (after ``ENDS_UNIT``); results are the same.

Defined cases: a null text is an empty one (plain, n = 0); a null key counts as empty
text in the draws; rows with equal keys have equal draws; an empty table gives no rows;
other columns are kept if asked for, those named like outputs are replaced.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, per_task, read

#: Fixed values of the format: the sentinels, and what a unit is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINE = r"[^\n]*\n|[^\n]+"
ENDS_UNIT = "\n"           # a unit never goes on after it
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
BLOCK = 1_000_000

FIELDS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
          T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
          T.StructField("output", T.StringType())]


def unit_ends(units, text: str, block: int = BLOCK) -> list[int]:
    """Where the text's units end.  ``units``: the compiled ``(unit)*``."""
    if len(text) <= block:
        return units.fullmatch(text).ends(1)
    ends, at = [], 0
    while at < len(text):
        stop = text.find(ENDS_UNIT, at + block) + 1 or len(text)
        ends += units.fullmatch(text, at, stop).ends(1)
        at = stop
    return ends


def rearrange(text: str, ends: list[int], draws: tuple[int, int, int, int],
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """n, form, prefix length, middle length (null if plain), output."""
    n = len(ends)
    if (not text or draws[2] % 100 >= fim_percent
            or PREFIX in text or SUFFIX in text or MIDDLE in text):
        return n, "plain", None, None, text
    k, m = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0), (ends[m - 1] if m else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = LINE,
              seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
              keep: list[str] | None = None) -> DataFrame:
    """Append n, form, prefix_chars, middle_chars and output to the ``keep`` columns.
    ``unit`` must match every text when repeated, and end at each ``ENDS_UNIT``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = {f"h{i + 1}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
             for i in range(4)}

    @per_task
    def start():
        units = regex.compile(f"({unit})*")

        def run(texts, *draws):
            rows = []
            for t, *h in zip(texts, *draws):
                t = t or ""
                rows.append(rearrange(t, unit_ends(units, t), h, fim_percent, spm_percent))
            return list(zip(*rows)) or [()] * len(FIELDS)

        return run

    return map_columns(docs, {"text": F.col(text)} | draws, start, FIELDS, keep)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.  A sentinel occurs once in it: no text
    with one is transformed, and none overlaps another's end or beginning."""
    def between(left: str, right: str | None) -> Column:
        after = F.split_part(output, F.lit(left), F.lit(2))
        return F.split_part(after, F.lit(right), F.lit(1)) if right else after

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output"), 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS pieces,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(pieces) - (pieces[-1] = '')::BIGINT AS n,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM given),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS k, greatest(h1 % (n + 1), h2 % (n + 1)) AS m,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
placed AS (
  SELECT *, CASE k WHEN 0 THEN 0 ELSE length(array_to_string(pieces[1:k], chr(10)))
                   + (k < len(pieces))::BIGINT END AS a,
         CASE m WHEN 0 THEN 0 ELSE length(array_to_string(pieces[1:m], chr(10)))
                   + (m < len(pieces))::BIGINT END AS b
  FROM cut)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form
         WHEN 'plain' THEN text
         WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
         ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a)
       END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM placed"""
