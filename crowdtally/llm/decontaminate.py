"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of digits, letters a-z (A-Z are lower-cased) and any characters
beyond ASCII.  All items' word sequences go into one generalised suffix automaton.
Each document's words are streamed through it while the length of the longest
suffix that occurs in some item is tracked.  Where that length reaches ``window``
words, the last ``window`` words are an occurrence of a window; an item with fewer
words is one window as a whole.  Words inside any occurrence are hit.

A document is contaminated if 20 times its hit words reach its words
(``coverage`` 1/20).  ``remove_contamination`` drops such documents and cuts the hit
spans out of the others.

Only runs of words whose neighbouring pairs occur in some item are streamed: in
other places the tracked length is below two, so nothing can match there (items of
one word turn this filter off).

Size: an automaton has at most two states per item word.  Items are taken in blocks
of at most ``BLOCK_WORDS`` words, each with an automaton of its own that is sent to
the executors; a further block is a further pass over the documents, whose hits so
far are kept in the shared folder.

Defined cases: a null or empty text has no words, no hits, and is clean; null or
wordless items have no windows; equal items are reported each under their own
item_id; an item with a null item_id hits words but is named in no list; repeated
rows and other columns are kept.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_columns, per_task, read

WINDOW = 13
COVERAGE = 20              # contaminated if hit * COVERAGE >= words
BLOCK_WORDS = 200_000
PAIR_SLOTS = 1 << 22       # bytes of the table of word pairs
#: Byte -> byte of the normalised text: a-z, 0-9 and bytes beyond ASCII stay.
NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32
               for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts: dict[tuple, set] = {}
        for item_id, words in items:
            if words:
                key = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in words)
                texts.setdefault(key, set()).add(item_id)
        for key in texts:
            last = 0
            for c in key:
                last = self._extend(last, c)
        self._windows(texts)
        self._pairs(texts)

    def _new(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of p's longest string followed by c, cut out of q if q is longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # this string is known from an earlier item
            return self._split(last, c, self.next[last][c])
        now = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = now
            p = self.link[p]
        if p >= 0:
            self.link[now] = self._split(p, c, self.next[p][c])
        return now

    def _windows(self, texts: dict[tuple, set]) -> None:
        """items_at: state that holds a string of ``window`` words -> the items with it;
        shorts_at: state -> (words, items) of whole short items that end there."""
        self.items_at: dict[int, set] = {}
        own: dict[int, list] = {}
        for key, ids in texts.items():
            if len(key) < self.window:
                s = 0
                for c in key:
                    s = self.next[s][c]
                own.setdefault(s, []).append((len(key), ids))
                continue
            s = n = 0
            for c in key:
                s, n = self._step(s, n, c)
                if n >= self.window:
                    s, n = self._shorten(s)
                    self.items_at.setdefault(s, set()).update(ids)
        self.shorts_at: dict[int, list] = {}
        for s in sorted(range(len(self.length)), key=self.length.__getitem__) if own else ():
            found = own.get(s, []) + (self.shorts_at.get(self.link[s], []) if s else [])
            if found:
                self.shorts_at[s] = found
        self.shortest = min([self.window] + [n for own in own.values() for n, _ in own])

    def _step(self, s: int, n: int, c: int) -> tuple[int, int]:
        """Longest suffix of (the current match followed by c) that occurs in an item."""
        while s and c not in self.next[s]:
            s = self.link[s]
            n = self.length[s]
        return (self.next[s][c], n + 1) if c in self.next[s] else (0, 0)

    def _shorten(self, s: int) -> tuple[int, int]:
        """The state of the match's last ``window`` words; that is all one needs to go on."""
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s, self.window

    def _pairs(self, texts) -> None:
        pairs = np.array([(a, b) for key in texts for a, b in zip(key, key[1:])] or [(0, 0)],
                         np.int64)
        self.n = len(self.vocab)
        self.pairs = np.zeros(PAIR_SLOTS, bool)
        self.pairs[self._slot(pairs[:, 0], pairs[:, 1])] = True

    @staticmethod
    def _slot(a, b):
        """A place in the table of pairs; pairs may share one (then more is streamed)."""
        return (a * 0x9E3779B1 + b * 0x85EBCA77) % PAIR_SLOTS

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs (start, end) of words outside of which no window can occur."""
        known = ids >= 0
        if self.shortest > 1:
            joined = known[:-1] & known[1:]
            at = np.nonzero(joined)[0]
            joined[at] = self.pairs[self._slot(ids[at], ids[at + 1])]
            need, extra = self.shortest - 1, 1
        else:
            joined, need, extra = known, 1, 0
        if not joined.any():
            return []
        edge = np.diff(np.concatenate(([0], joined.view(np.int8), [0])))
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        long = ends - starts >= need
        return [(int(a), int(b) + extra) for a, b in zip(starts[long], ends[long])]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (start, end in words; in order, merged) and the items hit."""
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(-1)), np.int64, len(words))
        spans: list[list[int]] = []
        items: set = set()

        def hit(start, end):
            while spans and spans[-1][1] >= start:
                start, end = min(start, spans[-1][0]), max(end, spans[-1][1])
                spans.pop()
            spans.append([start, end])

        for a, b in self.candidates(ids):
            s = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                s, n = self._step(s, n, c)
                if s in self.shorts_at:
                    for k, own in self.shorts_at[s]:
                        if k <= n:
                            hit(i + 1 - k, i + 1)
                            items |= own
                if n >= self.window:
                    s, n = self._shorten(s)
                    hit(i + 1 - n, i + 1)
                    items |= self.items_at[s]
        return [tuple(x) for x in spans], items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def item_blocks(benchmark: DataFrame, block_words: int):
    """Blocks of (item_id, words), each of at most ``block_words`` words (or one item)."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((row["item_id"], words))
        held += len(words)
    yield block


MATCH = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
         T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
         T.StructField("items", T.ArrayType(T.StringType()))]


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                    window: int = WINDOW, block_words: int = BLOCK_WORDS,
                    keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Append n_words, n_hit, hit_spans ([start, end) in words, merged) and items
    (sorted as strings) to the documents; ``prefix`` goes before these names."""
    spark, out, first = docs.sparkSession, None, True
    keep = docs.columns if keep is None else keep
    fields = [T.StructField(prefix + f.name, f.dataType) for f in MATCH]
    for block in item_blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(block)  # at most block_words words

        def start(sent=sent, name=uuid.uuid4().hex):
            automaton = _automaton(sent, name, window)

            def run(texts, spans, items):
                n, hits, all_spans, all_items = [], [], [], []
                for t, before, named in zip(texts, spans, items):
                    words = words_of(t)
                    own, ids = automaton.match(words)
                    own = merge_spans([*map(tuple, before or ()), *own])
                    n.append(len(words))
                    hits.append(sum(b - a for a, b in own))
                    all_spans.append(own)
                    all_items.append(sorted({*(named or ()),
                                             *(str(i) for i in ids if i is not None)}))
                return [n, hits, all_spans, all_items]

            return run

        if not first:  # a further block of items: a pass of its own
            out = checkpointed(out)
        src = docs if first else out
        needs = {"text": F.col(text),
                 "spans": F.lit(None).cast(MATCH[2].dataType) if first else F.col(fields[2].name),
                 "items": F.lit(None).cast(MATCH[3].dataType) if first else F.col(fields[3].name)}
        carried = dict.fromkeys([*keep, text])
        out = map_columns(src, needs, per_task(start), fields, list(carried))
        first = False
    new = [f.name for f in fields]
    return out.select(*[F.col(f"`{c}`") for c in keep if c not in new], *new)


_AUTOMATA: dict[str, Automaton] = {}


def _automaton(sent, name: str, window: int) -> Automaton:
    """The block's automaton: one at a time in a worker process."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = Automaton(sent.value, window)
    return _AUTOMATA[name]


def contaminated(coverage: int = COVERAGE, prefix: str = ""):
    hit, words = F.col(prefix + "n_hit"), F.col(prefix + "n_words")
    return (hit > 0) & (hit * coverage >= words)


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of the spans (and what stands between them)."""
    if not spans:
        return text
    raw = text.encode()
    norm = raw.translate(NORMAL)
    edges, at = [], 0
    for w in norm.split():
        at = norm.index(w, at)
        edges.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last:edges[a][0]])
        last = edges[b - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                         window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """Documents that are not contaminated, with hit spans cut out of their texts."""
    rows = match_benchmark(docs, benchmark, text, window, prefix="__match_")
    left = rows.where(~contaminated(coverage, "__match_"))

    def cut(texts, spans):
        return [[t if not s else cut_spans(t, s) for t, s in zip(texts, spans)]]

    out = map_columns(left, {"text": F.col(text), "spans": F.col("__match_hit_spans")}, cut,
                      [T.StructField(text, T.StringType())])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"),
                           keep=["doc_id"])
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"))


#: The query's rule in plain SQL: every window of every item joined to the documents' runs
#: of as many words.
ORACLE = r"""
WITH cut AS (
  SELECT kind, id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents
        UNION ALL SELECT 'item', item_id, text FROM benchmark)),
windows AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(words[k:k + n - 1], ' ') AS gram
  FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS k
        FROM (SELECT id, words, least(13, len(words)) AS n FROM cut WHERE kind = 'item' AND len(words) > 0))),
runs AS (
  SELECT id AS doc_id, n, k, array_to_string(words[k:k + n - 1], ' ') AS gram
  FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS k
        FROM cut, (SELECT DISTINCT n FROM windows) WHERE kind = 'doc' AND len(words) >= n)),
found AS (SELECT doc_id, k, n, item_id FROM runs JOIN windows USING (n, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM cut LEFT JOIN hit ON hit.doc_id = id LEFT JOIN named ON named.doc_id = id
WHERE kind = 'doc'"""
