"""Source divergence audit: how far the word use of the sources of a language lies apart.

Counting is a sort of word-start pointers.  A task joins the text buffers of its Arrow
batches to slices of about ``SLICE_BYTES``, finds every word's first byte in them at once,
and sorts these pointers by the words they point to with a multikey quicksort whose
"characters" are 8-byte pieces of a word: pointers are split by a pivot piece into smaller,
equal and larger ones; the equal ones go on with their next 8 bytes.  Parts of at most
``SMALL`` pointers are sorted directly, all parts of one depth together.  A run of equal
words in the sorted order gives the word's occurrences and, by the documents of its
pointers, its document frequency, both per (lang, source).  No word becomes a Python object
before it is a line of that bounded table.  Spark adds up the slices' tables.

For each language the terms in at least ``LEAST_DOCS`` of its documents are kept.  With
additive smoothing (``ADD``), a group's share of a term is
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in exact integers.

* part ``pair``: by (lang, source), each other source of the language, with the sum over all
  kept terms of the absolute difference of both shares;
* part ``term``: by (lang, source), the kept terms which it holds and uses more than its
  language does, with the difference; the first ``TOP_TERMS`` ranks.

Pair sums are taken over blocks: a task holds the counts of some ``BLOCK_TERMS`` terms in
two blocks of at most ``BLOCK_SOURCES`` sources as a matrix and returns one partial sum for
each pair, so a row is sent once per block of sources and never once per pair.

Memory: a slice is ``SLICE_BYTES`` plus the longest text.  Words cut at ASCII bytes are the
same in UTF-8 bytes as in characters, so whole texts of any length are one pass over bytes.

Defined cases: null text, lang or source is the empty string (a language or source like
others); each row is a document, repeated rows too; groups without a term take part, with
zero counts; a language without kept terms has pair values 0 and no ``term`` rows, one with
a single source has no ``pair`` rows; equal values rank by the item's UTF-8 bytes; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, read, ship

LEAST_DOCS = 30
ADD, SCALE = 5, 1_000_000_000
TOP_TERMS = 50
SLICE_BYTES = 1 << 23
SMALL = 4096               # pointers sorted directly
TAILS_FROM = 64            # bytes after which few words are still equal: compared as bytes
BLOCK_TERMS, BLOCK_SOURCES = 2048, 256
SALTS = 32                 # parts of a hot language or source in joins

#: Bytes of words: ASCII letters and every byte of a longer character; A-Z become a-z.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Masks for the first k bytes of a piece.
_FIRST = np.array([(1 << 64) - (1 << 8 * (8 - k)) for k in range(9)], np.uint64)


class Pointers:
    """The words of one slice: a text buffer, and where each word starts and ends in it."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """``data``: the bytes of all documents; ``ends``: where each of them ends."""
        self.ends = ends
        self.text = np.concatenate((_LOWER[data], np.zeros(8, np.uint8)))
        inside = _IN_WORD[data]
        fresh = np.zeros(len(data) + 1, bool)      # a document starts here
        fresh[ends] = fresh[0] = True
        before = np.concatenate(([False], inside[:-1])) & ~fresh[:-1]
        self.at = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:], [False])) & ~fresh[1:]
        self.stop = np.flatnonzero(inside & ~after) + 1
        # Every 8 bytes of the buffer as a big-endian number.
        self._piece = np.ndarray(len(data), ">u8", self.text, strides=(1,))

    def pieces(self, words: np.ndarray, depth: int) -> np.ndarray:
        """The words' bytes from ``depth`` to ``depth + 8`` as numbers, zero past their ends."""
        left = np.clip(self.stop[words] - self.at[words] - depth, 0, 8)
        at = np.where(left > 0, self.at[words] + depth, 0)
        return self._piece[at].astype(np.uint64) & _FIRST[left]

    def word(self, i: int) -> bytes:
        return self.text[self.at[i]:self.stop[i]].tobytes()

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """The words in ascending order of their bytes, and where runs of equal ones begin."""
        order = np.arange(len(self.at))
        first = np.zeros(len(order), bool)
        small: dict[int, list[tuple[int, int]]] = {}
        todo = [(0, len(order), 0)] if len(order) else []
        while todo or small:
            if not todo:
                depth = min(small)
                todo = self._sort_small(order, first, depth, small.pop(depth), small)
                continue
            low, high, depth = todo.pop()
            if high - low <= SMALL:
                small.setdefault(depth, []).append((low, high))
                continue
            part = order[low:high]
            piece = self.pieces(part, depth)
            some = np.sort(piece[::len(piece) // 99])
            pivot = some[len(some) // 2]
            below, above = piece < pivot, piece > pivot
            a, b = low + int(below.sum()), high - int(above.sum())
            order[low:high] = np.concatenate((part[below], part[~(below | above)], part[above]))
            todo += [x for x in ((low, a, depth), (b, high, depth)) if x[0] < x[1]]
            if int(pivot) & 0xFF:          # eight bytes: the words may go on
                todo.append((a, b, depth + 8))
            else:
                first[a] = True
        return order, first

    def _sort_small(self, order, first, depth, parts, small) -> list[tuple[int, int, int]]:
        """Sort all small parts of one depth; parts that go on are added to ``small``."""
        low, high = np.array(parts).T
        if depth >= TAILS_FROM:
            for a, b in parts:
                tails = {w: self.text[self.at[w] + depth:self.stop[w]].tobytes() for w in order[a:b].tolist()}
                ranked = sorted(tails, key=tails.get)
                order[a:b] = ranked
                first[a:b] = [i == 0 or tails[ranked[i - 1]] != tails[w] for i, w in enumerate(ranked)]
            return []
        size = high - low
        place = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        part = np.repeat(np.arange(len(parts)), size)
        words = order[place]
        piece = self.pieces(words, depth)
        by = np.lexsort((piece, part))
        order[place], piece, part = words[by], piece[by], part[by]
        starts = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (part[1:] != part[:-1]))))
        count = np.diff(np.append(starts, len(piece)))
        more = (count > 1) & (piece[starts] & np.uint64(0xFF) > 0)
        first[place[starts[~more]]] = True
        if more.any():
            begin = place[starts[more]]
            small.setdefault(depth + 8, []).extend(zip(begin.tolist(), (begin + count[more]).tolist()))
        return []

    def table(self, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, and per (word, group): word number, group, occurrences, documents.
        ``group``: the group of each document."""
        order, first = self.sort()
        if not len(order):
            return [], *(np.zeros(0, np.int64),) * 3
        run = np.cumsum(first) - 1
        doc = np.searchsorted(self.ends, self.at[order], side="right")
        pair, n = np.unique(run * len(self.ends) + doc, return_counts=True)
        groups = int(group.max()) + 1
        key = pair // len(self.ends) * groups + group[pair % len(self.ends)]
        by = np.argsort(key, kind="stable")
        key, starts, docs = np.unique(key[by], return_index=True, return_counts=True)
        n = np.add.reduceat(n[by], starts)
        return [self.word(i) for i in order[first].tolist()], key, n, docs


def slices(batches, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(bytes, ends, batches) of about ``limit`` bytes of whole documents, from the Arrow
    buffers of the first column."""
    data, ends, held, size = [], [], [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            col = b.column(0).slice(at)
            kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
            _, offsets, text = col.buffers()
            bounds = np.frombuffer(offsets, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
            take = max(1, int(np.searchsorted(bounds, bounds[0] + limit - size, side="right")) - 1)
            take = min(take, len(col))
            low, high = int(bounds[0]), int(bounds[take])
            data.append(np.frombuffer(text, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8))
            ends.append(bounds[1:take + 1] - low + size)
            held.append(b.slice(at, take))
            size += high - low
            at += take
            if size >= limit:
                yield np.concatenate(data), np.concatenate(ends), held
                data, ends, held, size = [], [], [], 0
    if held:
        yield np.concatenate(data), np.concatenate(ends), held


def word_counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(lang, source, term, n, docs) summed over all documents.  ``docs``: text, lang, source."""
    ship(docs.sparkSession)

    def count(batches):
        for data, ends, held in slices(batches, slice_bytes):
            table = pa.Table.from_batches(held)
            names = pa.table({"lang": table.column(1), "source": table.column(2)}).to_pandas()
            group = names.groupby(["lang", "source"], sort=False).ngroup().to_numpy()
            known = names.drop_duplicates()        # in the order of the groups' numbers
            words, key, n, found = Pointers(data, ends).table(group)
            groups = int(group.max()) + 1
            at = pa.array(key % groups)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known["lang"], pa.string()).take(at), pa.array(known["source"], pa.string()).take(at),
                 pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(key // groups)),
                 pa.array(n, pa.int64()), pa.array(found, pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    return (docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count, total, terms):
    """p of a count, in exact integers."""
    wide = "decimal(20,0)"
    top = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("long") + ADD).cast(wide)
    return F.lit(1) + F.call_function("div", top, (total.cast("long") + ADD * terms.cast("long")).cast(wide))


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: str) -> DataFrame:
    """Inner join whose keys may be hot in ``big``: its rows are dealt to ``SALTS`` parts by
    ``by``, and ``small`` is there once for each."""
    return (big.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
            .join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))),
                  [*on, "__salt"]).drop("__salt"))


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, value) for all ordered pairs of groups in languages with kept terms.
    ``counts``: lang, term, n, i, terms, last; ``groups``: lang, i, total, terms, last
    (``i`` numbers a language's groups, ``last`` is its last number)."""
    own = F.floor(F.col("i") / BLOCK_SOURCES)
    # A block of sources meets each block, itself included, as the first or the second.
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / BLOCK_SOURCES))).alias("b")
    sides = ["lang", "part", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    placed = counts.select("lang", "term", "i", "n", "last", own.alias("a"),
                           F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / BLOCK_TERMS)).alias("part"))
    sizes = placed.select("lang", "part", "term").distinct().groupBy("lang", "part").agg(F.count("*").alias("here"))
    counts = (placed.select("lang", "part", "a", meets, "term", "i", "n")
              .select(*sides, "term", "i", "n")
              .toDF("its_lang", "its_part", "its_a", "its_b", "term", "its_i", "n"))
    sources = (spread_join(sizes, groups, ["lang"], "part").withColumn("a", own)
               .select("lang", "part", "a", meets, "i", "total", "terms", "here")
               .select(*sides, "i", "total", "terms", "here"))

    def p(n, total, terms):
        return 1 + (SCALE * (n + ADD)) // (total + ADD * terms)

    def add(key, left, right):
        """Sums over the terms of one part, for all pairs of two blocks of sources."""
        right = right.sort_values("i").reset_index(drop=True)
        where = pd.Series(right.index, index=right["i"])
        term, names = pd.factorize(left["term"])
        n = np.zeros((len(names), len(right)), object if left["n"].max() > 1 << 32 else np.int64)
        n[term, where.loc[left["its_i"]].to_numpy()] = left["n"].to_numpy()
        total = right["total"].to_numpy().astype(n.dtype)
        many = int(right["terms"].iloc[0])
        shares = p(n, total, many).astype(np.int64)
        none = p(np.zeros_like(total), total, many).astype(np.int64)
        unseen = int(right["here"].iloc[0]) - len(names)
        block = (right["i"] // BLOCK_SOURCES).to_numpy()
        firsts = np.flatnonzero(block == key[2])
        seconds = np.flatnonzero(block == key[3])
        value = np.stack([np.abs(shares[:, [s]] - shares[:, seconds]).sum(axis=0)
                          + unseen * np.abs(none[s] - none[seconds]) for s in firsts])
        i, j = right["i"].to_numpy()[firsts], right["i"].to_numpy()[seconds]
        out = pd.DataFrame({"lang": key[0], "i": np.repeat(i, len(j)), "j": np.tile(j, len(i)),
                            "value": value.ravel()})
        return out[out["i"] < out["j"]]

    sums = (counts.groupBy("its_lang", "its_part", "its_a", "its_b").cogroup(sources.groupBy("lang", "part", "a", "b"))
            .applyInPandas(add, "lang string, i long, j long, value long")
            .groupBy("lang", "i", "j").agg(F.sum("value").alias("value")))
    return sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
          slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                         for c in ("text", "lang", "source")])
    by_term = Window.partitionBy("lang", "term")
    kept = checkpointed(
        word_counts(docs, slice_bytes).select("lang", "source", "term", "n",
                                 F.sum("n").over(by_term).alias("everywhere"),
                                 F.sum("docs").over(by_term).alias("df"))
        .where(F.col("df") >= least_docs).drop("df"))
    occurring = docs.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    # One row per group, numbered within the language, whose pairs are the result's rows.
    by_lang = Window.partitionBy("lang")
    groups = checkpointed(
        occurring.join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
        .fillna(0, ["total", "terms"])
        .withColumn("i", F.row_number().over(by_lang.orderBy("source")) - F.lit(1).cast("long"))
        .withColumn("last", F.max("i").over(by_lang)).withColumn("all_total", F.sum("total").over(by_lang)))
    counts = spread_join(kept, groups, ["lang", "source"], "term")

    used = (counts.withColumn("value", share(F.col("n"), F.col("total"), F.col("terms"))
                              - share(F.col("everywhere"), F.col("all_total"), F.col("terms")))
            .where(F.col("value") > 0).select("lang", "source", F.col("term").alias("item"), "value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    top = used.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)

    one = groups.select("lang", "source", "i")
    other = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j"))
    sums = pair_sums(counts.select("lang", "term", "n", "i", "terms", "last"),
                     groups.select("lang", "i", "total", "terms", "last"))
    pairs = (one.join(other, "lang").where("i <> j")
             .join(sums, ["lang", "i", "j"], "left")
             .select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
             .withColumn("rank", F.row_number().over(ranked)))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(*order)
            .unionAll(top.withColumn("part", F.lit("term")).select(*order)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
uses AS (
  SELECT doc, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM words),
vocabulary AS (SELECT lang, term FROM uses GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
sized AS (SELECT lang, (SELECT count(*) FROM vocabulary v WHERE v.lang = w.lang)::HUGEINT AS terms
          FROM words w GROUP BY lang),
grid AS (
  SELECT g.lang, g.source, v.term, count(u.term)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM words) g JOIN vocabulary v USING (lang)
  LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source AND u.term = v.term GROUP BY ALL),
shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * terms) AS p
  FROM grid JOIN sized USING (lang)),
common AS (
  SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * terms) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM grid GROUP BY ALL) JOIN sized USING (lang)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
lines AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM (SELECT DISTINCT lang, source FROM words) a
  JOIN (SELECT DISTINCT lang, source FROM words) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN common USING (lang, term)
  WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM lines QUALIFY part = 'pair' OR rank <= 50"""
