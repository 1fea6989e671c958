"""Token counts by a unigram model over a trie of pre-tokens.

Pre-tokens are runs of non-space characters with the piece model's word mark before
them.  A pre-token's segmentation is the one with the best sum of piece scores; of
equal ones, that with fewer tokens.  Forward scores are computed along a trie of the
distinct pre-tokens, walked depth first: the best score and token count of a prefix
belong to its trie node and are computed once for all pre-tokens that share it; a
pre-token's result is its terminal node's.  Texts then only look their pre-tokens' terminal values up.

Piece scores come from the public piece model: the logarithm of Zipf's law over the
rank its pieces have there (no tokenizer is trained).  A character that begins no
known piece at its place costs one token for each of its UTF-8 bytes, at the lowest
piece score less ``UNKNOWN`` each.

Tries are walked per slice of a batch for the pre-tokens not known yet; results are kept in a bounded cache per worker process.

Defined cases: a null or empty text, or one of spaces only, has no tokens and score
zero; texts of any length are counted whole; rows are independent, so repeated rows
and null ids are kept; other columns are kept by ``count_tokens``, and those named
like outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, per_task, read

MARK = "▁"
UNKNOWN = 10.0
NO_ENDING = object()
_COUNTERS: dict[str, "Counter"] = {}


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str) -> dict[str, float]:
    """Ordinary pieces with the logarithm of Zipf's law over their rank."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / r for r in range(1, len(names) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(names, 1)}


class Counter:
    def __init__(self, scores: dict[str, float], limit: int = 1_200_000):
        self.scores, self.limit = scores, limit
        #: Every ending of a piece, with the score if it is a piece itself (else None).
        self.endings: dict[str, float | None] = {p[k:]: None for p in scores for k in range(len(p))}
        self.endings.update(scores)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.counts = np.zeros(1 << 12, np.int64)
        self.values = np.zeros(1 << 12)

    def insert(self, words: list[str]) -> list[tuple[float, int]]:
        """Terminal (score, tokens) of each word, over one trie.

        Words are inserted in sorted order, which walks the trie depth first: the path
        to the current node is kept, a word goes back to the node of the prefix that it
        shares with the last one, and only its further characters make new nodes.  A
        node looks back along the path for its best last piece, as far as some piece
        ends with the characters passed."""
        get, scores = self.endings.get, self.scores
        best, count, last = [0.0], [0], ""  # of the nodes on the path; the root first
        out: list[tuple[float, int]] = [(0.0, 0)] * len(words)
        for k in sorted(range(len(words)), key=words.__getitem__):
            word, shared = words[k], 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], count[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, tokens = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    s = get(word[start:end], NO_ENDING)
                    if s is NO_ENDING:
                        break
                    if s is not None:
                        total = best[start] + s
                        if total > top or (total == top and count[start] + 1 < tokens):
                            top, tokens = total, count[start] + 1
                c = word[end - 1]
                if c not in scores:  # else the character is itself a piece
                    size = len(c.encode("utf-8", "surrogatepass"))
                    total = best[-1] + size * self.unknown
                    if total > top:
                        top, tokens = total, count[-1] + size
                best.append(top)
                count.append(tokens)
            out[k] = best[-1], count[-1]
            last = word
        return out

    def ids(self, words: list[str]) -> np.ndarray:
        """Places of the words' results."""
        if len(self.known) > self.limit:
            self.clear()
        ids = list(map(self.known.get, words))
        if None in ids:
            new = list(dict.fromkeys([w for w, i in zip(words, ids) if i is None]))
            first = len(self.known)
            while first + len(new) > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            found = self.insert([MARK + w for w in new])
            self.values[first:first + len(new)] = [f[0] for f in found]
            self.counts[first:first + len(new)] = [f[1] for f in found]
            self.known.update(zip(new, range(first, first + len(new))))
            ids = [self.known[w] if i is None else i for w, i in zip(words, ids)]
        return np.array(ids, np.int64)

    def count(self, texts: list[str | None], slice_chars: int = 2_000_000):
        """(pre-tokens, tokens, score) of each text."""
        out, at = [], 0
        while at < len(texts):
            flat, sizes, size = [], [], 0
            while at < len(texts) and (size == 0 or size + len(texts[at] or "") <= slice_chars):
                own = (texts[at] or "").split()
                flat += own
                sizes.append(len(own))
                size += len(texts[at] or "") + 1
                at += 1
            ids = self.ids(flat)
            ends = np.cumsum(sizes)
            for n, b in zip(sizes, ends.tolist()):
                own = ids[b - n:b]
                out.append((n, int(self.counts[own].sum()), math.fsum(self.values[own])))
        return out


def count_tokens(docs: DataFrame, text: str = "text", model: str | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """Append n_pretokens, n_tokens and score (sum of the best log scores)."""
    path = model or default_model()

    @per_task
    def start():
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(piece_scores(path))
        counter = _COUNTERS[path]
        return lambda texts: list(zip(*counter.count(texts))) or [[], [], []]

    return map_columns(docs, {"text": F.col(text)}, start,
                       [T.StructField("n_pretokens", T.LongType()),
                        T.StructField("n_tokens", T.LongType()),
                        T.StructField("score", T.DoubleType())], keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), keep=["doc_id"])
