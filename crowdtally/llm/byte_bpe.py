"""Byte-level BPE through a sentencepiece model serialised from a rank file.

The rank file's tokens become the pieces of a sentencepiece BPE model: every byte
is mapped to one printable character, a piece's score is its negative rank, and
the normaliser is the identity.  sentencepiece then merges the best-scored (so
lowest-ranked) adjacent pair first, leftmost on ties, as byte-level BPE does.  No
tokenizer is trained; the model's protocol-buffer message is written here field by
field.  A pre-token that is itself a token is that token, without merging.

Pre-tokens are encoded separately and kept in a bounded cache per worker process,
so each distinct one costs one encoding; ids are decoded by the inverse of the
byte mapping.

Defined cases: a null text is an empty one (no ids); texts of any length are
encoded whole; rows are independent, so repeated rows, null ids and other columns
are kept as they are; an input column named like an output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PieceCache, map_columns, per_task, read

# The bytes that the usual byte mapping leaves as they are; the others
# follow from 256 on, in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CODECS: dict[tuple, "ByteBpe"] = {}


def byte_characters() -> list[str]:
    """The character of each byte value."""
    rest = itertools.count(256)
    return [chr(b) if b in PRINTABLE else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order (the file's ranks must be 0, 1, 2, ...)."""
    out = []
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            if int(rank) != len(out):
                raise ValueError("ranks must be consecutive")
            out.append(base64.b64decode(token))
    return out


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: int (varint), float (32 bits), bytes (length-delimited)."""
    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 0x7F:
            out.append(x & 0x7F | 0x80)
            x >>= 7
        return bytes(out) + bytes([x])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(int(value))


def bpe_model(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model; piece 0 is the unknown piece, piece r + 1 has rank r."""
    chars = byte_characters()
    unknown, normal, bpe = 2, 1, 2
    parts = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        parts.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece
        chars = byte_characters()
        self.to_char = {b: c for b, c in enumerate(chars)}
        self.whole = {t: struct.pack("<I", r) for r, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=bpe_model(tokens))
        back = {c: b for b, c in enumerate(chars)}
        bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i))
                    for i in range(1, self.model.get_piece_size())]
        self.all_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.n_bytes = np.array([len(b) for b in bytes_of], np.int64)
        self.starts = np.cumsum(self.n_bytes) - self.n_bytes
        self.cache = PieceCache(regex.compile(pattern).findall, self._encode)

    def _encode(self, pretokens: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pretokens]
        hard = [i for i, r in enumerate(raw) if r not in self.whole]
        out = [self.whole.get(r) for r in raw]
        mapped = [raw[i].decode("latin-1").translate(self.to_char) for i in hard]
        for i, ids in zip(hard, self.model.encode(mapped, out_type=int, num_threads=1)):
            out[i] = struct.pack(f"<{len(ids)}I", *[x - 1 for x in ids])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian u32 bytes."""
        return self.cache.look_up(texts)

    def decode(self, ids: bytes, part: int = 1 << 18) -> bytes:
        """The bytes of the ids, gathered from the pieces' bytes a bounded part at a time."""
        out, all_ids = [], np.frombuffer(ids, "<u4")
        for at in range(0, len(all_ids), part):
            own = all_ids[at:at + part]
            n = self.n_bytes[own]
            shift = self.starts[own] - (np.cumsum(n) - n)
            out.append(self.all_bytes[np.repeat(shift, n) + np.arange(n.sum())].tobytes())
        return b"".join(out)


def codec(path: str, pattern: str) -> ByteBpe:
    """One per worker process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers as P
    return path or P.path("byte_bpe_multi_50k.tiktoken"), pattern or P.PATTERN


def encode(docs: DataFrame, text: str = "text", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """Append ``ids`` (array<int>) to every row."""
    path, pattern = _defaults(path, pattern)

    @per_task
    def start():
        bpe = codec(path, pattern)
        return lambda texts: [[np.frombuffer(b, "<u4").astype("i4")
                               for b in bpe.encode([t or "" for t in texts])]]

    return map_columns(docs, {"text": F.col(text)}, start,
                       [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """Append ``decoded`` (binary): the bytes of an id array; null ids give null."""
    path, pattern = _defaults(path, pattern)

    @per_task
    def start():
        bpe = codec(path, pattern)
        return lambda many: [[None if x is None else bpe.decode(np.array(x, "<u4").tobytes())
                              for x in many]]

    return map_columns(rows, {"ids": F.col(ids)}, start,
                       [T.StructField("decoded", T.BinaryType())])


def digests(docs: DataFrame, text: str = "text", path: str | None = None,
            pattern: str | None = None) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = _defaults(path, pattern)

    @per_task
    def start():
        bpe = codec(path, pattern)

        def run(texts):
            n, a, b = [], [], []
            for ids in bpe.encode([t or "" for t in texts]):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [n, a, b]

        run.done = bpe.cache.drop  # a worker process goes on to other stages
        return run

    return map_columns(docs, {"text": F.col(text)}, start,
                       [T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())], keep=["doc_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
