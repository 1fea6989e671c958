"""Toxicity by a weighted finite-state pattern grammar.

Words are first read as symbols: insult, threat, target, negation, reporting verb,
clause end, or other.  Four transducers rewrite the symbols of a clause: negation
("not an idiot"), reported speech ("she said he is an idiot"), target ("you idiot",
"idiot, you") and the weigher, which names what is left as matched patterns
(insult, aimed insult, negated insult, ... threat, aimed threat, ...).  They are
composed into one machine; each clause with an insult or threat is run through it,
and a document's score is the logistic of the weighted matches.  A word outside
such a clause counts nothing.

The lexicon starts from the fixed words below.  Further insult stems are learned
from labelled documents: word beginnings that stand in many different contexts
(previous and next word) of toxic documents and in hardly any of clean ones.
Contexts, not documents, are counted, for every word beginning and each context once,
so copies of one toxic text teach no more than the text itself.  The pattern weights are a logistic regression on the
same documents.  Both are fitted on at most ``SAMPLE_DOCS`` labelled documents with
held_out false (a bounded sample by hash of doc_id); everything else reads all rows.

Scoring finds lexicon hits by one Aho-Corasick pass over the lower-cased text; only
clauses around hits are cut into words, so long texts cost one scan.

Defined cases: a null or empty text matches nothing and gets the score of no match;
a null doc_id counts as the empty text in the held-out rule; repeated labels of a
document count as toxic if one of them does, null labels are no labels; without
labelled documents of both kinds the default weights hold; an empty table gives no
rows; input columns named like outputs are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (bounded_sample, checkpointed, held_out_remainder, map_columns, per_task,
                     read, ship)

FOLDS = 5
SAMPLE_DOCS = 12_000       # labelled documents for fitting, at most about
STEM_LETTERS = range(4, 9)
LEAST_CONTEXTS = 8         # different toxic contexts of a learned stem
LEAST_SHARE = 0.9          # toxic share of a learned stem's contexts
HELD_CONTEXTS = 100_000    # in a task's memory at a time
NEARLY_ALL = 0.9           # of a stem's contexts, for a longer stem to stand for it

# Seed words by symbol, in English, German, French and Spanish.
WORDS = {
    "insult": """idiot idiots clown clowns worthless moron morons pathetic disgusting trash scum
        loser losers stupid dumb imbecile dumbass
        dummkopf abschaum trottel versager widerlich wertlos
        imbécile crétin ordure minable abruti
        idiota imbécil basura patético asqueroso""".split(),
    "threat": """kill hurt destroy murder strangle
        töten umbringen verletzen tuer frapper matar golpear""".split(),
    "target": """you your yours you're youre yourself yourselves
        du dich dir dein ihr euch tu toi te vous usted tú ti ustedes""".split(),
    "negation": """not no never isn't aren't wasn't don't nicht kein keine nie niemals
        ne pas jamais nunca jamás""".split(),
    "report": """said says say called claims claimed wrote reported quote quoted
        sagte sagt schrieb behauptet dit disait écrit dijo dice escribió""".split(),
}
SYMBOLS = ["other", "insult", "threat", "target", "negation", "report"]
REACH = 4                  # words over which negation and target reach


class Transducer:
    """Deterministic transducer as a table (state, symbol) -> (state, output)."""

    def __init__(self, start, step, symbols: list[str]):
        numbers, todo, self.table = {start: 0}, [start], {}
        while todo:
            state = todo.pop()
            for symbol in symbols:
                to, out = step(state, symbol)
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                self.table[numbers[state], symbol] = numbers[to], out
        self.symbols, self.outputs = symbols, sorted({o for _, o in self.table.values()})

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: the other machine reads this one's output."""
        def step(state, symbol):
            a, out = self.table[state[0], symbol]
            b, out = other.table[state[1], out]
            return (a, b), out
        return Transducer((0, 0), step, self.symbols)

    def run(self, symbols) -> list[str]:
        state, out = 0, []
        for s in symbols:
            state, o = self.table[state, s]
            out.append(o)
        return out


def negation() -> Transducer:
    def step(left, s):
        if s == "negation":
            return REACH, "other"
        hit = s in ("insult", "threat") and left
        return max(0, left - 1), "negated " + s if hit else s
    return Transducer(0, step, SYMBOLS)


def reported(symbols: list[str]) -> Transducer:
    def step(inside, s):
        if s == "report":
            return 1, "other"
        return inside, "reported " + s if inside and s in ("insult", "threat") else s
    return Transducer(0, step, symbols)


def target(symbols: list[str]) -> Transducer:
    """State: words for which a target, or an insult or threat, is still near."""
    def step(state, s):
        aim, hit, kind = state
        if s == "target":
            return (REACH, 0, ""), ("aimed " + kind if hit else "other")
        if s.endswith(("insult", "threat")):
            return ((max(0, aim - 1), 0, ""), "aimed " + s) if aim else ((0, REACH, s), s)
        left = max(0, hit - 1)
        return (max(0, aim - 1), left, kind if left else ""), s
    return Transducer((0, 0, ""), step, symbols)


def weigher(symbols: list[str]) -> Transducer:
    return Transducer(0, lambda q, s: (0, "" if s in SYMBOLS[3:] or s == "other" else s), symbols)


def grammar() -> Transducer:
    machine = negation()
    for make in (reported, target, weigher):
        machine = machine.then(make(machine.outputs))
    return machine


GRAMMAR = grammar()
PATTERNS = [o for o in GRAMMAR.outputs if o]
#: Weights without training: by pattern, and the last for no match at all.
DEFAULT = np.array([0.5 if "negated" in p or "reported" in p else 2.5 if "aimed" in p else 2.0
                    for p in PATTERNS] + [-2.5])
#: A run of marks ends a clause if it holds a newline or white space follows.
MARKS = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


class Lexicon:
    """Seed words and learned stems, with one automaton that finds both in a text."""

    def __init__(self, stems: list[str] = ()):
        import ahocorasick
        self.symbol = {w: s for s, words in WORDS.items() for w in words}
        self.stems = frozenset(stems)
        self.lengths = sorted({len(w) for w in self.stems})
        self.finder = ahocorasick.Automaton()
        for w in [w for s in ("insult", "threat") for w in WORDS[s]]:
            self.finder.add_word(w, len(w))
        for w in self.stems:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def of(self, word: str) -> str:
        got = self.symbol.get(word)
        return got or ("insult" if any(word[:k] in self.stems for k in self.lengths) else "other")

    def clauses(self, text: str | None) -> list[str]:
        """The clauses (lower-cased) with a hit."""
        low, out, done = (text or "").lower(), [], 0
        for last, n in self.finder.iter(low):
            start = last - n + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            # Bounds are looked for from the hit on, each character once.
            a = start
            while a > done and not (low[a - 1] in ".!?;:\n" and (low[a - 1] == "\n" or low[a].isspace())):
                a -= 1
            done = next((m.start() for m in MARKS.finditer(low, last + 1)
                         if m.end() == len(low) or low[m.end()].isspace() or "\n" in m[0]), len(low))
            out.append(low[a:done])
        return out

    def features(self, text: str | None) -> np.ndarray:
        """log(1 + matches) by pattern, and 1."""
        seen: Counter = Counter()
        for clause in self.clauses(text):
            seen.update(GRAMMAR.run(map(self.of, WORD.findall(clause))))
        return np.array([np.log1p(seen[p]) for p in PATTERNS] + [1.0])


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's steps, pulled towards the default weights."""
    if not len(y) or y.min() == y.max():
        return DEFAULT
    w = DEFAULT.copy()
    keep = np.full(len(w), pull)
    keep[-1] = 0.01
    for _ in range(rounds):
        p = logistic(x, w)
        grad = x.T @ (p - y) + keep * (w - DEFAULT)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled documents that aren't held out."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .where(held_out_remainder(FOLDS) != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    some = bounded_sample(known, "doc_id", bound)  # at most about ``bound`` rows
    # Of several texts of one id the first by hash, so that every run learns the same.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    return checkpointed(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
                        .groupBy("doc_id", "toxic").agg(one.alias("text")).select("text", "toxic"))


def learn_stems(rows: DataFrame, least: int = LEAST_CONTEXTS, share: float = LEAST_SHARE) -> list[str]:
    """Word beginnings whose contexts are nearly all toxic, none of which begins another."""
    ship(rows.sparkSession)
    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic"))
    shortest, longest = STEM_LETTERS[0], STEM_LETTERS[-1]

    def listed(seen):
        parts = list(zip(*seen)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(parts[0], pa.string()), pa.array(parts[1], pa.int32()),
             pa.array(parts[2], pa.int64())], names=["start", "toxic", "context"])

    def contexts(batches):
        seen = set()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, bad = ["", *WORD.findall((text or "").lower()), ""], int(toxic > 0)
                seen.update((w[:longest], bad, xxhash.xxh64_intdigest(f"{before} {after}") >> 1)
                            for before, w, after in zip(words, words[1:], words[2:])
                            if len(w) >= shortest)
                if len(seen) > HELD_CONTEXTS:  # Spark drops what the parts share
                    yield listed(seen)
                    seen = set()
        yield listed(seen)

    starts = rows.mapInArrow(contexts, "start string, toxic int, context long").distinct()
    stems = F.transform(F.sequence(F.lit(shortest), F.length("start")),
                        lambda k: F.substring("start", 1, k))
    good = (starts.select(F.explode(stems).alias("stem"), "toxic", "context")
            .distinct().groupBy("stem").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
            .where((F.col("bad") >= least) & (F.col("bad") >= share * F.col("n"))))
    found = {r["stem"]: r["bad"] for r in good.collect()}  # of a bounded sample
    begun = {}  # by found stem that none begins: the found stems it begins
    for stem in found:
        begun.setdefault(next(stem[:k] for k in STEM_LETTERS if stem[:k] in found), []).append(stem)
    # As many letters as nearly all of its uses share.
    out = {max((x for x in longer if found[x] >= NEARLY_ALL * found[stem]),
               key=lambda x: (len(x), x)) for stem, longer in begun.items()}
    return sorted(out)


class Model:
    """What scoring needs: learned stems and pattern weights."""

    def __init__(self, stems: list[str], weights: np.ndarray):
        self.stems, self.weights = stems, weights


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCS) -> Model:
    rows = training_rows(docs, labels, bound)
    stems = learn_stems(rows)

    @per_task
    def start():
        lexicon = Lexicon(stems)
        return lambda texts: [[lexicon.features(t).tolist() for t in texts]]

    got = map_columns(rows, {"text": F.col("text")}, start,
                      [T.StructField("x", T.ArrayType(T.DoubleType()))], keep=["toxic"])
    # One line per pattern vector: few, as most documents match nothing.
    table = got.groupBy("x", "toxic").agg(F.count("*").alias("n")).collect()
    x = np.array([r["x"] for r in table] or np.zeros((0, len(DEFAULT))))
    y = np.array([float(r["toxic"] > 0) for r in table])
    n = np.array([r["n"] for r in table], int)
    return Model(stems, fit_weights(np.repeat(x, n, axis=0), np.repeat(y, n)))


def score(docs: DataFrame, model: Model, text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` and ``predicted`` (1 from one half on) to the documents."""
    stems, weights = model.stems, model.weights

    @per_task
    def start():
        lexicon = Lexicon(stems)
        plain = float(logistic(lexicon.features("")[None, :], weights)[0])

        def run(texts):
            scores = []
            for t in texts:
                x = lexicon.features(t)
                scores.append(plain if not x[:-1].any() else float(logistic(x[None, :], weights)[0]))
            return [scores, [int(s >= 0.5) for s in scores]]

        return run

    return map_columns(docs, {"text": F.col(text)}, start,
                       [T.StructField("score", T.DoubleType()),
                        T.StructField("predicted", T.IntegerType())], keep)


def remove_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, all columns as they are."""
    model = train(docs.withColumnRenamed(text, "text") if text != "text" else docs, labels)
    flagged = score(docs.withColumn("__text", F.col(text)).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "__text"),
        model, "__text", keep=["__row"])
    return flagged.where("predicted = 0").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    rows = score(docs.select("doc_id", "text", (held_out_remainder(FOLDS) == 0).alias("held_out")),
                 model, keep=["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", "score", "predicted")
