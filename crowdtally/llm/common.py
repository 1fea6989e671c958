"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ensure_checkpoint_dir

__all__ = ["read", "ship", "checkpointed", "shared_folder", "map_columns", "held_out_remainder",
           "bounded_sample", "pieces", "PieceCache"]

_SHIPPED = "_crowdtally_shipped"
#: Rows of an Arrow batch: texts and id lists are long, so fewer than Spark's default.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors this package (once per context), so tasks import it as a module,
    and lower the Arrow batch size if it has its default."""
    sc, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if getattr(sc, _SHIPPED, False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="crowdtally-"), "crowdtally.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("crowdtally", os.path.relpath(full, top)))
    sc.addPyFile(out)
    setattr(sc, _SHIPPED, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives lost executors)."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder URI below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def map_columns(df: DataFrame, needs: dict[str, Column], fn, fields: list[T.StructField],
                keep: list[str] | None = None) -> DataFrame:
    """Append ``fields`` to the ``keep`` columns of ``df``, computed per Arrow batch.

    ``needs`` maps argument names to column expressions; ``fn`` gets one Python
    list per entry, in that order, and returns one list per field.  A column of
    ``df`` with the name of a new field is replaced.  ``fn`` may be a factory
    (attribute ``per_task``): it is then called once per task and returns the
    function to use, whose attribute ``done`` is called after the last batch.
    """
    ship(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    tmp = {k: f"__need_{i}" for i, k in enumerate(needs)}
    # Plain names on the way, as Spark's call does not quote the names it is given.
    src = df.select(*[F.col(f"`{c}`").alias(f"__kept_{i}") for i, c in enumerate(kept)],
                    *[c.alias(tmp[k]) for k, c in needs.items()])
    out = [T.StructField(f"__new_{i}", f.dataType) for i, f in enumerate(fields)]
    schema = T.StructType([src.schema[f"__kept_{i}"] for i in range(len(kept))] + out)
    n_kept, names = len(kept), [f.name for f in schema.fields]
    factory = getattr(fn, "per_task", False)
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        f = fn() if factory else fn
        for b in batches:
            outs = f(*[b.column(n_kept + i).to_pylist() for i in range(b.num_columns - n_kept)])
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(n_kept)]
                + [pa.array(o, type=t) for o, t in zip(outs, types)], names=names)
        if hasattr(f, "done"):  # what a task leaves in its worker process is small
            f.done()

    return src.mapInArrow(run, schema).toDF(*kept, *[f.name for f in fields])


def per_task(fn):
    fn.per_task = True
    return fn


def held_out_remainder(modulus: int, col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % modulus


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most about ``bound`` rows, chosen by a hash of ``key`` (all of them if fewer)."""
    n = df.count()
    if n <= bound:
        return df
    cut = int(bound / n * 2**31)
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(2**31)) < cut)


_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the plain space: of ASCII, and all of it.
_ASCII_SPACES = [chr(c) for c in range(128) if c != 32 and chr(c).isspace()]
_SPACES = [chr(c) for c in range(0x3001) if c != 32 and chr(c).isspace()]


def pieces(text: str) -> list[str]:
    """Cut a text at the single spaces between non-space characters.

    The usual byte-level pre-token patterns give the same pre-tokens for the
    whole text as for its first piece followed by each later piece with one
    space before it.
    """
    if "  " in text or any(c in text and (c + " " in text or " " + c in text)
                           for c in (_ASCII_SPACES if text.isascii() else _SPACES)):
        return _SAFE.split(text)
    return text.split(" ")


class PieceCache:
    """Texts -> joined ids (bytes), through bounded caches.

    ``split`` cuts a string into pre-tokens, ``encode`` turns a list of pre-tokens
    into their ids; pieces that ``whole`` tells go to ``encode_whole`` uncut.
    """

    #: Marks that end a word's pre-token and are one of their own at a piece's end.
    marks = frozenset(".,;:!?")

    def __init__(self, split, encode, whole=None, encode_whole=None, limit: int = 300_000,
                 limit_chars: int = 16_000_000, slice_chars: int = 1_000_000):
        self.split, self.encode = split, encode
        self.whole, self.encode_whole = whole, encode_whole
        self.limit, self.limit_chars, self.slice_chars = limit, limit_chars, slice_chars
        self.later: dict = {None: b""}  # by piece: its ids where a space comes before
        self.inner: dict = {}           # by pre-token: its ids
        self.chars = 0

    def drop(self) -> None:
        self.later, self.inner, self.chars = {None: b""}, {}, 0

    def _drop_if_full(self) -> None:
        if len(self.later) + len(self.inner) > self.limit or self.chars > self.limit_chars:
            self.drop()

    def _fill(self, missing: list) -> None:
        """Ids of different pieces that follow a space."""
        later, inner, split = self.later, self.inner, self.split
        if self.whole:
            uncut = [p for p in missing if not p.isascii() and self.whole(p)]
            if uncut:
                later.update(zip(uncut, self.encode_whole([" " + p for p in uncut])))
                missing = [p for p in missing if p not in later]
        words, cut = [], []
        for p in missing:
            if p.isalpha():
                words.append(p)
            elif p[-1:] in self.marks and p[:-1].isalpha():
                cut.append((p, p[:-1], [p[-1]]))
            else:
                parts = split(" " + p)
                cut.append((p, parts[0][1:], parts[1:]))
        later.update(zip(words, self.encode([" " + p for p in words])))
        if cut:
            firsts = [p for p in dict.fromkeys([x[1] for x in cut]) if p not in later]
            later.update(zip(firsts, self.encode([" " + p for p in firsts])))
            self._learn_inner([x[2] for x in cut])
            for p, first, rest in cut:
                later[p] = (later[first] + inner[rest[0]] if len(rest) == 1
                            else later[first] + b"".join([inner[y] for y in rest]))
        self.chars += sum(map(len, missing))

    def _learn_inner(self, many: list[list[str]]) -> None:
        new = [x for x in {x for parts in many for x in parts} if x not in self.inner]
        self.inner.update(zip(new, self.encode(new)))
        self.chars += sum(map(len, new))

    def _heads(self, heads: list[str]) -> list[bytes]:
        """Ids of pieces at a text's start."""
        done, rest = {}, set(heads)
        if self.whole:
            uncut = [h for h in rest if self.whole(h)]
            done = dict(zip(uncut, self.encode_whole(uncut)))
            rest.difference_update(uncut)
        cut = {h: self.split(h) for h in rest}
        self._learn_inner(list(cut.values()))
        done.update((h, b"".join([self.inner[x] for x in parts])) for h, parts in cut.items())
        return [done[h] for h in heads]

    def look_up(self, texts: list[str]) -> list[bytes]:
        """The joined ids of each text, worked through in slices of bounded size."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= self.slice_chars):
                size += len(texts[end]) + 1
                end += 1
            self._drop_if_full()
            flat, heads, ends = [], [], [0]
            for t in texts[at:end]:
                p = pieces(t)
                heads.append(p[0])
                p[0] = None  # stands for no ids
                flat += p
                ends.append(len(flat))
            ids = list(map(self.later.get, flat))
            holes, hole = [], -1
            for _ in range(ids.count(None)):
                hole = ids.index(None, hole + 1)
                holes.append(hole)
            if holes:
                self._fill(list(dict.fromkeys([flat[i] for i in holes])))
                for i in holes:
                    ids[i] = self.later[flat[i]]
            for head, a, b in zip(self._heads(heads), ends, ends[1:]):
                ids[a] = head
                out.append(b"".join(ids[a:b]))
            at = end
        return out
