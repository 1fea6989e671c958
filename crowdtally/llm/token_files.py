"""Token-ID files: independent zstandard frames with a trailing seek table.

File layout (all integers little-endian):

* data frames, one after another.  Each is a complete zstandard frame that
  carries its content checksum, and holds up to ``FRAME_TOKENS`` ids (at least
  one document): ``n`` as u32, ``n`` document ids as i64, ``n`` flags as u8 (1:
  the id is null), ``n`` id counts as u32, then all ids as u32;
* one skippable frame (magic 0x184D2A5E) with the seek table: per data frame its
  compressed size u32, decompressed size u32, xxh64 (low 32 bits) of the
  decompressed bytes u32, number of documents u32, its first and last document id
  i64; then the footer: number of frames u32, format flag u8, magic u32.

The seek table is at the file's end and its length follows from the footer, so a
reader fetches the tail, picks the frames that can hold the ids it wants, and
decompresses only those.  Plain zstandard tools read the same file, as they pass
over skippable frames.

Files are named by their place in doc_id order (``tokens-00000007.zst``).  A task
writes under an attempt's own name and renames at the end; the content depends on
the rows alone, so a repeated attempt replaces a file by the same bytes.

Defined cases: the string of an added token (``<|endoftext|>``) gives that token's id,
as the library does by itself; a null text is an empty one (just the end id); a null doc_id sorts
first; rows with equal doc_id are ordered by their ids; an empty table gives no
files and no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_characters
from .common import PieceCache, checkpointed, map_columns, per_task, read, shared_folder

#: Fixed value: how the tokenizer's byte-level pre-tokenizer cuts texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 1_700_000         # pieces and pre-tokens kept by a worker process
FRAME_TOKENS = 1 << 18
DOCS_PER_FILE = 4096       # at least, while that gives no more than MANY_FILES files
MANY_FILES = 2000
MOST_DOCS = 1_000_000      # per file, beyond
END_ID = 2
TABLE_MAGIC, SKIP_MAGIC = 0x8F92EAB2, 0x184D2A5E
ENTRY = struct.Struct("<IIIIqq")
FOOTER = struct.Struct("<IBI")
_CACHES: dict[tuple, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# --- encoding ---------------------------------------------------------------

def id_width(path: str) -> int:
    """Bytes that hold any id on the way to the files: 2 or 4."""
    from tokenizers import Tokenizer
    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


class Encoder:
    """Texts -> joined ids, as the library gives them: the vocabulary's added tokens are
    found in a text first, and what lies between them is encoded part by part."""

    def __init__(self, cache: PieceCache, added: dict[str, bytes]):
        self.cache, self.added = cache, added
        longest_first = sorted(added, key=lambda a: (-len(a), a))
        self.split = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split

    def look_up(self, texts: list[str]) -> list[bytes]:
        if not any(a in t for a in self.added for t in texts):
            return self.cache.look_up(texts)
        parts = [self.split(t) if any(a in t for a in self.added) else [t] for t in texts]
        plain = iter(self.cache.look_up([p for own in parts for p in own[::2]]))
        return [b"".join([self.added[p] if i % 2 else next(plain) for i, p in enumerate(own)])
                for own in parts]


def ids_cache(path: str, width: int = 4) -> Encoder:
    """Per worker process: the tokenizer behind a bounded cache of pieces."""
    if (path, width) not in _CACHES:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        kind = {2: "H", 4: "I"}[width]

        packers = [struct.Struct(f"<{n}{kind}").pack for n in range(64)]
        merge, chars = tok.model.tokenize, dict(enumerate(byte_characters()))
        space = chars[32]

        def pack(ids: list[int]) -> bytes:
            n = len(ids)
            return packers[n](*ids) if n < 64 else struct.pack(f"<{n}{kind}", *ids)

        def encode(pretokens: list[str]) -> list[bytes]:
            out = []
            for p in pretokens:  # mapped byte by byte; plain ASCII stays but for the space
                mapped = (p.replace(" ", space) if p.isascii() and p.isprintable()
                          else p.encode().decode("latin-1").translate(chars))
                out.append(pack([t.id for t in merge(mapped)]))
            return out

        def encode_whole(texts: list[str]) -> list[bytes]:
            return [pack(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]

        # Pieces are cut by the byte-level pre-tokenizer's pattern, mapped as it does and
        # given to the tokenizer's model.  Where Unicode tables could differ, the whole
        # tokenizer gets the piece uncut.
        rare = re.compile("[\u0250-\U0010ffff]").search
        pieces = PieceCache(regex.compile(PATTERN).findall, encode, rare, encode_whole,
                            limit=CACHED, limit_chars=16 * CACHED)
        added = {a.content: pack([i]) for i, a in tok.get_added_tokens_decoder().items()}
        _CACHES[path, width] = Encoder(pieces, added)
    return _CACHES[path, width]


# --- one file ---------------------------------------------------------------

class FrameWriter:
    """Writes documents to an open binary file as frames, then the seek table."""

    def __init__(self, out, frame_tokens: int = FRAME_TOKENS):
        self.out, self.limit = out, frame_tokens
        self.zip = zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.entries: list[bytes] = []
        self.ids: list[int | None] = []
        self.parts: list[bytes] = []
        self.held = self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.parts.append(ids)
        self.held += len(ids) // 4
        self.n_docs += 1
        self.n_tokens += len(ids) // 4
        if self.held >= self.limit:
            self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        n = len(self.ids)
        plain = [x or 0 for x in self.ids]
        body = (struct.pack("<I", n) + np.array(plain, "<i8").tobytes()
                + bytes(x is None for x in self.ids)
                + np.array([len(p) // 4 for p in self.parts], "<u4").tobytes()
                + b"".join(self.parts))
        packed = self.zip.compress(body)
        self.out.write(packed)
        real = [x for x in self.ids if x is not None]
        low, high = (min(real), max(real)) if real else (0, -1)
        self.entries.append(ENTRY.pack(len(packed), len(body),
                                       xxhash.xxh64_intdigest(body) & 0xFFFFFFFF, n, low, high))
        self.ids, self.parts, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(self.entries) + FOOTER.pack(len(self.entries), 1, TABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIP_MAGIC, len(table)) + table)


def read_seek_table(f) -> list[tuple]:
    """(offset, compressed, decompressed, checksum, documents, first id, last id) per frame."""
    size = f.size()
    f.seek(size - FOOTER.size)
    n, _, magic = FOOTER.unpack(f.read(FOOTER.size))
    if magic != TABLE_MAGIC:
        raise ValueError("not a token file: bad footer")
    f.seek(size - FOOTER.size - n * ENTRY.size)
    raw, at, out = f.read(n * ENTRY.size), 0, []
    for e in ENTRY.iter_unpack(raw):
        out.append((at, *e))
        at += e[0]
    return out


def read_frame(f, entry: tuple) -> Iterator[tuple[int | None, bytes]]:
    """The documents of one frame: (doc_id, ids); raises if a checksum doesn't hold."""
    at, packed, plain, check, n_docs, _, _ = entry
    f.seek(at)
    body = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
    if len(body) != plain or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check:
        raise ValueError(f"frame at {at}: checksum does not hold")
    n, = struct.unpack_from("<I", body)
    if n != n_docs:
        raise ValueError(f"frame at {at}: document count does not hold")
    ids = np.frombuffer(body, "<i8", n, 4)
    nulls = body[4 + 8 * n:4 + 9 * n]
    lens = np.frombuffer(body, "<u4", n, 4 + 9 * n)
    pos = 4 + 13 * n
    for i, is_null, k in zip(ids.tolist(), nulls, lens.tolist()):
        yield (None if is_null else i), body[pos:pos + 4 * k]
        pos += 4 * k


def read_documents(uri: str, wanted: set[int]) -> dict[int, list[bytes]]:
    """Ids of the wanted documents of one file; other frames are never decompressed."""
    fs, path = pafs.FileSystem.from_uri(uri)
    out: dict[int, list[bytes]] = {}
    with fs.open_input_file(path) as f:
        for e in read_seek_table(f):
            if any(e[5] <= w <= e[6] for w in wanted):
                for i, ids in read_frame(f, e):
                    if i in wanted:
                        out.setdefault(i, []).append(ids)
    return out


# --- the corpus -------------------------------------------------------------

def file_bounds(docs: DataFrame, docs_per_file: int) -> list[int]:
    """Upper doc_id bounds of all files but the last (quantiles of the ids alone)."""
    n = docs.count()
    files = max(1, min(math.ceil(n / docs_per_file), max(MANY_FILES, math.ceil(n / MOST_DOCS))))
    if files == 1:
        return []
    at = [i / files for i in range(1, files)]
    found = docs.where(F.col("doc_id").isNotNull()).select(
        F.percentile_approx(F.col("doc_id").cast("long"), F.array(*[F.lit(x) for x in at]),
                            F.lit(max(10_000, 20 * files)))).first()[0]
    return sorted(set(found or []))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID,
                      docs_per_file: int = DOCS_PER_FILE,
                      frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Write all documents, ordered by doc_id over the files; a row per file
    (file, uri, n_docs, n_tokens, n_frames).  Ids, not texts, are shuffled; each
    task streams the sorted rows of its files, so no file is ever held in memory."""
    spark = docs.sparkSession
    bounds = np.array(file_bounds(docs.select("doc_id"), docs_per_file), dtype=np.int64)
    at = spark.sparkContext.broadcast(bounds)  # one id per file
    width = id_width(vocabulary)

    tail = end_id.to_bytes(width, "little")

    @per_task
    def encode():
        cache = ids_cache(vocabulary, width)

        def run(ids, texts):
            files = [0 if x is None else int(np.searchsorted(at.value, x, side="left"))
                     for x in ids]
            return [[b + tail for b in cache.look_up([t or "" for t in texts])], files]

        return run

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = map_columns(slim, {"doc_id": F.col("doc_id"), "text": F.col("text")}, encode,
                         [T.StructField("ids", T.BinaryType()), T.StructField("file", T.LongType())],
                         ["doc_id"])
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        now, writer, out, tmp = None, None, None, None

        def end():
            writer.close()
            out.close()
            name = f"{root}/tokens-{now:08d}.zst"
            fs.move(tmp, name)
            return (now, f"{folder}/tokens-{now:08d}.zst", writer.n_docs, writer.n_tokens,
                    len(writer.entries))

        def table(rows):
            return pa.RecordBatch.from_pylist(
                [dict(zip(("file", "uri", "n_docs", "n_tokens", "n_frames"), r)) for r in rows],
                schema=pa.schema([("file", pa.int64()), ("uri", pa.string()),
                                  ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                                  ("n_frames", pa.int64())]))

        for b in batches:
            done = []
            for doc_id, ids, file in zip(b.column(0).to_pylist(), b.column(1),
                                         b.column(2).to_pylist()):
                if file != now:
                    if writer:
                        done.append(end())
                    now, tmp = file, f"{root}/.part-{file:08d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp)
                    writer = FrameWriter(out, frame_tokens)
                writer.add(doc_id, np.frombuffer(ids.as_py(), f"<u{width}").astype("<u4").tobytes())
            if done:
                yield table(done)
        if writer:
            yield table([end()])

    tasks = max(1, min(len(bounds) + 1,
                       int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    return (placed.repartition(tasks, "file").sortWithinPartitions("file", "doc_id", "ids")
            .mapInArrow(write, "file long, uri string, n_docs long, n_tokens long, n_frames long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """Read whole files back, a frame at a time: file, pos (order in the file), doc_id,
    start_in_file, n_tokens, ids_crc32.  ``files`` has ``file`` and ``uri``."""
    kinds = [("file", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.int64()),
             ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def load(batches):
        for b in batches:
            for file, uri in zip(b.column("file").to_pylist(), b.column("uri").to_pylist()):
                fs, path = pafs.FileSystem.from_uri(uri)
                pos = start = 0
                with fs.open_input_file(path) as f:
                    for e in read_seek_table(f):
                        rows = []
                        for doc_id, ids in read_frame(f, e):
                            rows.append((file, pos, doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                            pos += 1
                            start += len(ids) // 4
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, type=k) for c, (_, k) in zip(zip(*rows), kinds)],
                            names=[n for n, _ in kinds])

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return files.select("file", "uri").repartition(n, "file").mapInArrow(
        load, "file long, pos long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long")


def token_positions(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None,
                    docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Write the corpus to token files, read them back, and place every document:
    doc_id, start, n_tokens, ids_crc32, file, pos."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    files = checkpointed(write_token_files(docs, folder, vocabulary or default_vocabulary(),
                                           docs_per_file=docs_per_file))
    back = read_token_files(files)
    # One row per file; file numbers follow doc_id order.
    first = _running_total(files.select("file", "n_tokens"))
    return (back.join(first, "file")
            .select("doc_id", (F.col("first_token") + F.col("start_in_file")).alias("start"),
                    "n_tokens", "ids_crc32", "file", "pos"))


def _running_total(files: DataFrame, block: int = 1024) -> DataFrame:
    """Tokens before each file, by blocks of files, so that no task orders all of them."""
    from pyspark.sql import Window as W
    f = files.withColumn("blk", F.floor(F.col("file") / block))
    inner = F.sum("n_tokens").over(W.partitionBy("blk").orderBy("file")) - F.col("n_tokens")
    blocks = f.groupBy("blk").agg(F.sum("n_tokens").alias("all_tokens"))
    before = blocks.select(
        "blk", (F.sum("all_tokens").over(W.orderBy("blk")) - F.col("all_tokens")).alias("base"))
    return (f.withColumn("inner", inner).join(before, "blk")
            .select("file", (F.col("base") + F.col("inner")).alias("first_token")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_positions(read(spark, sf_dir, "documents"))
