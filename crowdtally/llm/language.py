"""Language identification by mixture inference over n-gram likelihoods.

Each language has a smoothed distribution over character n-grams (of ``GRAM``
letters, with word ends marked).  A word's likelihood in a language is the product
over its n-grams.  A document is a mixture of languages: expectation-maximisation
over its words gives the languages' proportions.  The set of languages is chosen by
penalised likelihood: the languages with the largest proportions are tried one, two,
three, ... at a time, each further one must raise the likelihood by more than the
penalty (half the logarithm of the number of words, times ``PENALTY``).  The
prediction is the language with the largest proportion in the chosen set, the score
its proportion.

Whole texts are used.  The inference runs on whole Arrow batches at once: words are
rows of a table of likelihoods, kept in a bounded cache, and documents are ranges
of rows.

Fitted on at most about ``SAMPLE_PER_LANGUAGE`` documents of each language (by a
hash of doc_id) with a known lang that aren't held out; n-grams are counted in Spark.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is
every text if no labelled document is there; a null doc_id counts as empty text in
the held-out rule; languages with equal proportions go by name; an empty table gives
no rows; other columns are kept, those named like outputs are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, held_out_remainder, map_columns, per_task, read, ship

FOLDS, HELD_OUT = 3, 1
SAMPLE_PER_LANGUAGE = 2000
GRAM = 3
SMOOTH = 0.5
PENALTY = 2.0
ROUNDS, CLOSE = 2000, 1e-5     # a document's EM ends when no proportion moves by CLOSE
RUNS = re.compile(r"[^\W\d_]+")


def letter_runs(piece: str) -> list[str]:
    """Runs of letters, as ``str.isalpha`` tells them: numerals like "\u00b2" are none."""
    out = []
    for run in RUNS.findall(piece):
        out += [run] if run.isalpha() else "".join([c if c.isalpha() else " " for c in run]).split()
    return out


def grams(piece: str, n: int = GRAM) -> list[str]:
    """The n-grams of a piece's runs of letters, with ends marked by a blank."""
    out = []
    for w in letter_runs(piece.lower()):
        w = f" {w} "
        out += [w[i:i + n] for i in range(max(1, len(w) - n + 1))]
    return out


class Model:
    """languages, and per n-gram the log likelihood in each; row 0 is an unknown n-gram."""

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        names = sorted(set().union(*counts.values())) if counts else []
        self.index = {g: i for i, g in enumerate(names, 1)}
        table = np.array([[0] + [counts[l][g] for g in names] for l in self.languages], float).T
        table = table.reshape(len(names) + 1, len(self.languages)) + SMOOTH
        self.log = np.log(table / table.sum(axis=0))


class Words:
    """Bounded cache of the likelihoods of whitespace-separated pieces."""

    def __init__(self, model: Model, limit: int = 600_000, limit_chars: int = 16_000_000):
        self.model, self.limit, self.limit_chars = model, limit, limit_chars
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(self.model.languages)), np.float32)
        self.lettered = np.zeros(1 << 12, bool)
        self.chars = 0

    def ids(self, split: list[str]) -> np.ndarray:
        if len(self.known) > self.limit or self.chars > self.limit_chars:
            self.clear()
        ids = list(map(self.known.get, split))
        if None in ids:
            new = list(dict.fromkeys([p for p, i in zip(split, ids) if i is None]))
            self._learn(new)
            ids = [self.known[p] if i is None else i for p, i in zip(split, ids)]
        return np.array(ids, np.int64)

    def _learn(self, new: list[str]) -> None:
        first = len(self.known)
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.lettered = np.concatenate([self.lettered, np.zeros_like(self.lettered)])
        get, flat, ends = self.model.index.get, [], []
        for p in new:
            flat += [get(g, 0) for g in grams(p)]
            ends.append(len(flat))
        ends = np.array(ends)
        starts = np.concatenate(([0], ends[:-1]))
        some = ends > starts
        if some.any():
            sums = np.add.reduceat(self.model.log[flat], starts[some], axis=0)
            self.rows[np.nonzero(some)[0] + first] = sums
        self.lettered[first:first + len(new)] = some
        self.known.update(zip(new, range(first, first + len(new))))
        self.chars += sum(map(len, new))


def mixtures(log: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS):
    """Proportions and log likelihood of each document.  ``log``: words by languages;
    ``sizes``: words of each document (at least 1); ``allowed``: documents by languages.
    Each document goes on until its own proportions have settled, so it gets the same
    numbers whichever documents are there with it."""
    starts = np.cumsum(sizes) - sizes
    top = log.max(axis=1, keepdims=True)
    like = np.exp(log - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    going, words, n, at = np.arange(len(sizes)), like, sizes, starts
    for _ in range(rounds):
        w = words * np.repeat(share[going], n, axis=0)
        total = np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
        new = np.add.reduceat(w / total, at, axis=0) / n[:, None]
        open_ = np.abs(new - share[going]).max(axis=1) >= CLOSE
        share[going] = new
        if not open_.any():
            break
        if not open_.all():
            words = words[np.repeat(open_, n)]
            going, n = going[open_], n[open_]
            at = np.cumsum(n) - n
    total = np.maximum((like * np.repeat(share, sizes, axis=0)).sum(axis=1), 1e-300)
    return share, np.add.reduceat(top[:, 0].astype(float), starts) + np.add.reduceat(np.log(total), starts)


def infer(log: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Chosen proportions (documents by languages; zero outside the chosen set)."""
    n_docs, k = len(sizes), log.shape[1]
    share, _ = mixtures(log, sizes, np.ones((n_docs, k)))
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best = (rank == 0).astype(float)
    starts = np.cumsum(sizes) - sizes
    single = np.add.reduceat(log.astype(float), starts, axis=0)
    best_value = single[np.arange(n_docs), order[:, 0]]
    # Documents that are all one language need no further tries.
    open_docs = np.nonzero(share.max(axis=1) < 1 - 1e-6)[0]
    for m in range(2, k + 1):
        if not len(open_docs):
            break
        part = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in open_docs])
        own, value = mixtures(log[part], sizes[open_docs], (rank[open_docs] < m).astype(float))
        value = value - (m - 1) * penalty * 0.5 * np.log(sizes[open_docs] + 1)
        better = value > best_value[open_docs]
        open_docs = open_docs[better]
        best[open_docs] = own[better]
        best_value[open_docs] = value[better]
    return best


def classify(texts: list[str | None], words: Words, slice_chars: int = 1_000_000):
    """(language, proportion) of each text, a slice of bounded size at a time (a longer
    text is a slice of its own)."""
    names, out, at = words.model.languages, [], 0
    while at < len(texts):
        flat, sizes, size = [], [], 0
        first = at
        while at < len(texts) and (size == 0 or size + len(texts[at] or "") <= slice_chars):
            own = (texts[at] or "").split()
            flat += own
            sizes.append(len(own))
            size += len(texts[at] or "") + 1
            at += 1
        found = [("und", 0.0)] * (at - first)
        if names and flat:
            ids = words.ids(flat)
            good = words.lettered[ids]
            doc = np.repeat(np.arange(at - first), sizes)[good]
            if len(doc):
                docs, n = np.unique(doc, return_counts=True)
                share = infer(words.rows[ids[good]], n)
                for d, pick, s in zip(docs.tolist(), share.argmax(axis=1).tolist(),
                                      share.max(axis=1).tolist()):
                    found[d] = names[pick], min(1.0, s)
        out += found
    return out


def train(docs: DataFrame, bound: int = SAMPLE_PER_LANGUAGE) -> Model:
    """``docs``: doc_id, text, lang."""
    ship(docs.sparkSession)
    known = (docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & (held_out_remainder(FOLDS) != HELD_OUT)))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):
        cut = int(min(1.0, bound / n) * (1 << 30))
        chosen = chosen | ((F.col("lang") == lang) & (place < cut))
    rows = checkpointed(known.where(chosen).select("lang", "text").distinct())

    def count(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = seen.setdefault(lang, Counter())
                for piece, n in Counter(text.split()).items():
                    for g in grams(piece):
                        own[g] += n
        flat = [(l, g, n) for l, own in seen.items() for g, n in own.items()]
        parts = list(zip(*flat)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts[0], pa.string()), pa.array(parts[1], pa.string()),
             pa.array(parts[2], pa.int64())], names=["lang", "gram", "n"])

    table = (rows.mapInArrow(count, "lang string, gram string, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counts: dict[str, Counter] = {l: Counter() for l in sizes}
    for r in table.collect():  # the n-grams of a bounded sample
        counts[r["lang"]][r["gram"]] = r["n"]
    return Model(counts)


def predict(docs: DataFrame, model: Model, text: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @per_task
    def start():
        words = Words(sent.value)

        def run(texts):
            got = classify(texts, words)
            return [[g[0] for g in got], [float(g[1]) for g in got]]

        return run

    return map_columns(docs, {"text": F.col(text)}, start,
                       [T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType())], keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", "text",
                       (held_out_remainder(FOLDS) == HELD_OUT).alias("held_out"))
    return predict(rows, model, keep=["doc_id", "held_out"])
