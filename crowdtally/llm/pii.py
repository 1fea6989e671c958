"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (e-mail, IP address, card and phone numbers) follow fixed patterns and
always stay.  Beyond them, candidate spans are looser forms (an e-mail written with
"[at]", letters beyond ASCII in an address, numbers in groups without a plus sign,
credentials after a cue).  Six labelers vote on each candidate, for, against or
abstaining:

* pattern: whether a base span (or a strict key format) covers it;
* check: its digits (Luhn, parts at most 255, length) or its host name;
* gazetteer: top-level domains, calling codes, card prefixes, key prefixes;
* cue: words before it that announce such data;
* counter-cue: words or signs around it that speak against (prices, versions, ...);
* shape: whether it stands alone or is glued to other characters.

All documents' candidates are counted by kind, votes and two surface features; that
table is small whatever the corpus.  Expectation-maximisation (Dawid and Skene's
model, with a smoothing prior) estimates each labeler's reliability and the
probability of each row of the table; a logistic classifier is trained on those
probabilities and decides the candidates.  One pass reads the texts; the candidates
are kept in the shared folder between counting and deciding.

Every pattern runs in time linear in the text: long runs are entered at their start
only, and e-mail addresses are found from their "@".

Defined cases: a null or empty text has no spans; spans are in code points, end
exclusive, ordered by start, then kind; repeated rows and null ids are kept; without
any candidate nothing is added; an empty table gives no rows; other columns are kept
by ``find``, and input columns named like outputs are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_columns, per_task, read

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELERS = ["pattern", "check", "gazetteer", "cue", "counter", "shape"]
DECIDE = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

AT_SIGN = re.compile(r"@| ?[\[(]at[\])] ?", re.I)
LOOSE_HOST = re.compile(r"[^\W_][\w-]*+(?:(?:\.| ?[\[(]dot[\])] ?)[^\W_][\w-]*+)++", re.I)
RUN = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])*+")
PART = re.compile(r"[^ ]+")
GROUP = re.compile(r"[0-9]+")
SECRET = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
                    r"|\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?"
                    r"([^\s\"']{8,}+)", re.I)

# Fixed values of the gazetteers.
TOP_LEVEL = set("com org net edu gov info io de fr es uk eu it nl ch at be us ca example".split())
CALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44",
           "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64",
           "65", "66", "81", "82", "84", "86", "90", "91", "92", "98"}
CARD_PREFIX = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35")
KEY_PREFIX = ("AKIA", "ASIA", "ghp_", "sk_", "xox", "eyJ")
CUES = {
    "email": "mail email e-mail contact write kontakt correo courriel",
    "ip": "ip address host server adresse",
    "card": "card visa mastercard credit karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon téléphone teléfono",
    "secret": "password passwd pwd token secret key api",
}
CUES = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v.split())) + r")\b", re.I)
        for k, v in CUES.items()}
COUNTER = re.compile(r"(?:[$€£§#]|\b(?:version|isbn|issn|doi|page|no|nr|section|usd|eur|license|cc))\W{0,3}$",
                     re.I)


# --- base spans -------------------------------------------------------------

def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if small_parts(m[0])]


def small_parts(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(found: str) -> str:
    return "".join([c for c in found if "0" <= c <= "9"])


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end), in order."""
    if not text:
        return []
    return sorted((a, k, b) for k, find in enumerate((emails, ips, cards, phones))
                  for a, b in find(text))


# --- candidates and votes ---------------------------------------------------

def candidates(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and looser ones, as (start, kind number, end)."""
    if not text:
        return []
    out = set(base)
    for m in AT_SIGN.finditer(text):
        a = m.start()
        while a and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        host = LOOSE_HOST.match(text, m.end())
        if a < m.start() and host:
            out.add((a, 0, host.end()))
    out.update(numbers(text))
    for m in SECRET.finditer(text):
        out.add((*m.span(1)[:1], 4, m.end(1)) if m[1] else (m.start(), 4, m.end()))
    return sorted(out)


def numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """Runs of digits with separators, as what they could be: of each run, and of its parts
    between blanks that are grouped in themselves and have 9 digits or more, phone numbers
    of 7 to 15 digits and cards of 12 to 19, both where a length allows both.  A run with
    such parts is no phone number as a whole.  Groups that touch other characters of a word
    are not part of a run."""
    for m in RUN.finditer(text):
        a, b = m.span()
        if b - a < 7:
            continue
        if a and (text[a - 1].isalnum() or text[a - 1] in "_+."):
            a = next((g.start() for g in GROUP.finditer(text, a + 1, b) if not text[g.start() - 1].isdigit()), b)
        if b < len(text) and (text[b].isalnum() or text[b] == "_"):
            while b > a and text[b - 1].isdigit():
                b -= 1
            while b > a and not text[b - 1].isdigit():
                b -= 1
        parts = [p.span() for p in PART.finditer(text, a, b)]
        grouped = [(x, y) for x, y in parts if len(parts) > 1 and 9 <= len(digits_of(text[x:y]))
                   and not text[x:y].isdigit() and not IP.fullmatch(text, x, y)]
        for x, y in {(a, b), *grouped, *((x, y) for x, y in parts if y - x >= 12)}:
            n = len(digits_of(text[x:y]))
            if 12 <= n <= 19:
                yield x, 2, y
            if 7 <= n <= 15 and not text[x:y].isdigit() and not IP.fullmatch(text, x, y) and (
                    (x, y) in grouped or not grouped):
                yield x, 3, y


def votes(text: str, a: int, kind: int, b: int, strict: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 for, -1 against, 0 abstains."""
    found, before = text[a:b], text[max(0, a - 40):a]
    name, digits = KINDS[kind], digits_of(found)
    if name == "email":
        host = re.split(r"@|[\])] ?", found)[-1]
        check = 1 if "." in host and not host.endswith((".", "-")) else -1
        gazetteer = 1 if host.rpartition(".")[2].lower() in TOP_LEVEL else -1
    elif name == "ip":
        check = 1 if small_parts(found) else -1
        gazetteer = -1 if found.startswith("0.") or all(len(p) == 1 for p in found.split(".")) else 0
    elif name == "card":
        check = 1 if 12 <= len(digits) <= 19 and luhn(digits) else -1
        gazetteer = 1 if digits.startswith(CARD_PREFIX) else -1
    elif name == "phone":
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 0 if "+" not in found else (
            1 if any(digits[:n] in CALLING for n in (1, 2)) else -1)
    else:
        check = 1 if len(set(found)) >= 6 and (digits or len(found) > 16) else -1
        gazetteer = 1 if found.startswith(KEY_PREFIX) else 0
    cue = 1 if CUES[name].search(before) else 0
    counter = -1 if COUNTER.search(before) or text[b:b + 1] in ("%", "€", "$") else 0
    glued = (a and (text[a - 1].isalnum() or text[a - 1] in "_")) or text[b:b + 1].isalnum()
    return 1 if strict else 0, check, gazetteer, cue, counter, -1 if glued else 1


def describe(text: str, span: tuple[int, int, int], base: set) -> str:
    """A candidate's row in the table: kind, votes, length class, separators."""
    a, kind, b = span
    strict = span in base or (kind == 4 and re.fullmatch(r"(?:AKIA|ASIA)[0-9A-Z]{16}", text[a:b]))
    marks = "".join("-0+"[v + 1] for v in votes(text, a, kind, b, bool(strict)))
    return f"{kind}{marks}{min(9, (b - a) // 4)}{int(any(c in ' ()-.' for c in text[a:b]))}"


# --- the model --------------------------------------------------------------

class Model:
    """Reliabilities by EM over counted patterns, then a logistic classifier."""

    def __init__(self, counts: dict[str, int], rounds: int = 100):
        self.patterns = sorted(counts)
        n = np.array([counts[p] for p in self.patterns], float)
        kind = np.array([int(p[0]) for p in self.patterns], int)
        vote = np.array([["-0+".index(c) for c in p[1:1 + len(LABELERS)]] for p in self.patterns],
                        int).reshape(-1, len(LABELERS))
        # Start: the share of votes for among those given.
        given = (vote != 1).sum(axis=1)
        q = (1 + 2 * (vote == 2).sum(axis=1)) / (2 + 2 * given)
        onehot = np.eye(3)[vote]
        # Prior counts: a labeler that votes is right four times of five.
        prior = np.array([[1.6, 2.0, 0.4], [0.4, 2.0, 1.6]]) * 10
        for _ in range(rounds):
            w = np.stack([n * (1 - q), n * q])
            tables = np.einsum("cn,nlv->clv", w, onehot) + prior[:, None, :]
            tables /= tables.sum(axis=2, keepdims=True)
            share = np.array([(5 + (n * q)[kind == k].sum()) / (10 + n[kind == k].sum())
                              for k in range(len(KINDS))])
            log = np.log(tables)[:, np.arange(len(LABELERS)), vote].sum(axis=2)
            odds = log[1] - log[0] + np.log(share / (1 - share))[kind]
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            moved = np.abs(new - q).max() if len(q) else 0
            q = new
            if moved < 1e-9:
                break
        #: Probability of a vote (against, none, for) by truth and labeler.
        self.reliability = dict(zip(LABELERS, tables.transpose(1, 0, 2).tolist())) if len(n) else {}
        self.posterior = dict(zip(self.patterns, q.tolist()))
        self.weights = self._fit(np.array([self.features(p) for p in self.patterns]), q, n) \
            if self.patterns else None

    @staticmethod
    def features(p: str) -> list[float]:
        x = [0.0] * (len(KINDS) + 2 * len(LABELERS) + 11)
        x[int(p[0])] = 1
        for i, c in enumerate(p[1:1 + len(LABELERS)]):
            if c != "0":
                x[len(KINDS) + 2 * i + (c == "+")] = 1
        x[len(KINDS) + 2 * len(LABELERS) + int(p[-2])] = 1
        x[-1] = float(p[-1])
        return x

    @staticmethod
    def _fit(x, y, n, pull: float = 1.0):
        w = np.zeros(x.shape[1])
        n = n * min(1.0, 1e6 / n.sum())  # the pull weighs alike for any corpus
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (p - y)) + pull * w
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)),
                                   grad)
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        return w

    def accepted(self) -> list[str]:
        """The table's rows that the classifier takes for personal data."""
        if not self.patterns:
            return []
        x = np.array([self.features(p) for p in self.patterns])
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
        return [name for name, s in zip(self.patterns, p) if s >= DECIDE]


def span_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def chosen(base: list, others: list, accepted: set) -> list[tuple[int, int, int]]:
    """Base spans and accepted candidates that touch neither them nor each other; of a
    credential that holds base spans, the parts around them."""
    out = list(base)
    extra = sorted(((a, k, b) for a, k, b, p in others if p in accepted),
                   key=lambda s: (s[0], -s[2], s[1]))
    taken, i, done = sorted((a, b) for a, _, b in base), 0, 0
    for a, k, b in extra:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= done and (i == len(taken) or taken[i][0] >= b):
            out.append((a, k, b))
            done = b
        elif a >= done and KINDS[k] == "secret":
            while i < len(taken) and taken[i][0] < b:
                if a < taken[i][0]:
                    out.append((a, k, taken[i][0]))
                a, i = max(a, taken[i][1]), i + 1
            done = max(b, a)
            if a < b:
                out.append((a, k, b))
    return sorted(out)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                 T.StructField("kind", T.IntegerType()),
                                 T.StructField("end", T.LongType()),
                                 T.StructField("pattern", T.StringType())]))


def _candidates(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def run(texts):
        bases, loose = [], []
        for t in texts:
            base = base_spans(t)
            own = set(base)
            bases.append([(a, k, b, "") for a, k, b in base])
            loose.append([(a, k, b, describe(t, (a, k, b), own))
                          for a, k, b in candidates(t, base)])
        names = ("start", "kind", "end", "pattern")
        return [[[dict(zip(names, s)) for s in row] for row in col] for col in (bases, loose)]

    return map_columns(docs, {"text": F.col(text)}, run,
                       [T.StructField("__base", SPAN), T.StructField("__loose", SPAN)], keep)


def _model(rows: DataFrame) -> Model:
    counts = (rows.select(F.explode("__loose.pattern").alias("pattern"))
              .groupBy("pattern").agg(F.count("*").alias("n")).collect())  # few patterns
    return Model({r["pattern"]: r["n"] for r in counts})


def _as_tuples(spans):
    return [(s["start"], s["kind"], s["end"], s["pattern"]) for s in spans or ()]


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    keep = docs.columns if keep is None else keep
    new = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = checkpointed(_candidates(docs, text, [c for c in keep if c.lower() not in new]))
    accepted = set(_model(rows).accepted())

    def run(bases, others):
        out = [[] for _ in new]
        for b, o in zip(bases, others):
            base = [s[:3] for s in _as_tuples(b)]
            kinds = [k for _, k, _ in base]
            digest = hashlib.sha256(span_text(base).encode()).hexdigest()
            whole = span_text(chosen(base, _as_tuples(o), accepted))
            for col, x in zip(out, [*map(kinds.count, range(4)), digest, whole]):
                col.append(x)
        return out

    fields = [T.StructField(n, T.LongType() if n[:2] == "n_" else T.StringType()) for n in new]
    return map_columns(rows, {"base": F.col("__base"), "loose": F.col("__loose")}, run, fields,
                       [c for c in rows.columns if c[:2] != "__"])


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping ones, by the first's."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data replaced by ``<KIND>``, other columns as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    # The model needs all candidates first; they are counted in a pass of its own.
    counted = checkpointed(_candidates(docs, text, []).select("__loose"))
    accepted = set(_model(counted).accepted())

    @per_task
    def start():
        def run(texts):
            out = []
            for t in texts:
                base = base_spans(t)
                own = set(base)
                loose = [(*s, describe(t, s, own)) for s in candidates(t, base)]
                spans = chosen(base, loose, accepted)
                out.append(redact_text(t, spans) if spans else t)
            return [out]
        return run

    rows = map_columns(docs.select(whole, F.col(text).alias("__text")), {"text": F.col("__text")},
                       start, [T.StructField("__new", T.StringType())], ["__row"])
    return rows.select(*[F.col("__new").alias(c) if c == text else F.col("__row")[c].alias(c)
                         for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), keep=["doc_id"])
