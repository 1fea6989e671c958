"""Bounded-space online packing of token sequences.

Each partition of the documents keeps at most ``OPEN`` open windows of ``SIZE`` tokens.
What a document has beyond whole windows goes to the open window that it leaves with the
least free space (best fit).  Where none fits, a new window is opened while there are
fewer than ``OPEN``; then the fullest is emitted, filled up by the head of the document.
So an emitted window is full, and a document is cut only at whole windows and where
nothing fits.  With ``shortest_cut`` above 1, a gap of fewer tokens is left as padding
instead of cutting so short a piece off.

The windows still open at a partition's end are leftovers, merged by rounds: the pieces
left by ``FAN`` partitions are packed once more, longest first, in one task (at most
``FAN`` times ``OPEN`` windows, whatever the input), and leave at most ``OPEN`` windows
again.  The last task fills its windows up from the emptiest and cuts the rest at the
binary digits of its length, as a sequence whose length is a power of two is not padded.

The pieces are written to a table in the shared folder, once by each round, and everything
else reads that table; the ids of emitted and of left pieces are two columns, so that a
reader of one never loads the other.  A sequence's number tells the partition (or merge
group) and round that emitted it; numbers are unique, not gapless.  Which documents share
a sequence depends on how the documents are partitioned.

Defined cases: a null text is an empty one (just the end id); null and repeated doc_ids are
documents like others; the string of an added token gives that token's id; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_folder, ship
from .token_files import default_vocabulary, id_width, ids_cache

SIZE = 2048
OPEN = 64
FAN = 16
END_ID = 1
#: A sequence's number: round, then partition or group, then a running number.
ROUND_STEP, TASK_STEP = 1 << 58, 1 << 32

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("ids", pa.binary()), ("left_ids", pa.binary())])
DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
       "offset long, ids binary, left_ids binary")


class Windows:
    """The open windows of one task.  A piece is (doc_id, start, ids, doc_tokens), its ids
    ``width`` bytes each; ``place`` and ``close`` yield finished windows: lists of pieces."""

    def __init__(self, width: int, size: int = SIZE, most: int = OPEN, shortest_cut: int = 1):
        self.width, self.size, self.most, self.shortest_cut = width, size, most, shortest_cut
        self.free: list[tuple[int, int]] = []     # (free tokens, window), ascending
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        doc_id, start, ids, total = piece
        w, n = self.width, len(ids) // self.width
        at = 0
        while n - at >= self.size:
            yield [(doc_id, start + at, ids[w * at:w * (at + self.size)], total)]
            at += self.size
        while at < n:
            i = bisect_left(self.free, (n - at, -1))
            if i == len(self.free) and i < self.most:  # none fits
                self.held[self.opened] = []
                self.free.append((self.size, self.opened))
                self.opened += 1
            elif i == len(self.free):
                i = 0                                  # the fullest, to be emitted
            space, window = self.free.pop(i)
            take = min(space, n - at)
            if take == n - at or take >= self.shortest_cut:
                self.held[window].append((doc_id, start + at, ids[w * at:w * (at + take)], total))
                at += take
                space -= take
                if space and at == n:
                    insort(self.free, (space, window))
                    continue
            yield self.held.pop(window)

    def close(self) -> Iterator[list[tuple]]:
        """Empty all windows: fill the fullest from the emptiest, cut the rest into
        powers of two."""
        w = self.width
        order = [self.held.pop(window) for _, window in self.free]
        self.free = []
        used = [sum(len(p[2]) for p in own) // w for own in order]
        while order:
            own, n = order.pop(0), used.pop(0)
            while n < self.size and order:
                doc_id, start, ids, total = order[-1].pop()
                have = len(ids) // w
                take = min(have, self.size - n)
                # The piece's tail goes over, so that what stays begins where it did.
                own.append((doc_id, start + have - take, ids[w * (have - take):], total))
                if take < have:
                    order[-1].append((doc_id, start, ids[:w * (have - take)], total))
                n += take
                used[-1] -= take
                if not order[-1]:
                    order.pop()
                    used.pop()
            yield from [own] if n == self.size else self._powers(own, n)

    def _powers(self, own: list[tuple], n: int) -> Iterator[list[tuple]]:
        w, rest = self.width, list(own)
        for bit in reversed(range(n.bit_length())):
            if not n >> bit & 1:
                continue
            out, need = [], 1 << bit
            while need:
                doc_id, start, ids, total = rest.pop(0)
                take = min(need, len(ids) // w)
                out.append((doc_id, start, ids[:w * take], total))
                if w * take < len(ids):
                    rest.insert(0, (doc_id, start + take, ids[w * take:], total))
                need -= take
            yield out


class Rows:
    """Collects pieces as rows and hands them out as Arrow batches of a bounded size."""

    def __init__(self, width: int, base: int, held_bytes: int = 1 << 24):
        self.width, self.number, self.held_bytes = width, base, held_bytes
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, window: list[tuple], left: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in window:
            n = len(ids) // self.width
            check = None if left else zlib.crc32(
                np.frombuffer(ids, f"<u{self.width}").astype("<u4").tobytes())
            self.rows.append((doc_id, start, n, check, total, self.number, at,
                              *((None, ids) if left else (ids, None))))
            at += n
            self.size += len(ids)
        self.number += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(PIECES)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

    def full(self) -> bool:
        return self.size > self.held_bytes


def _first_round(docs: DataFrame, vocabulary: str, width: int, end_id: int, limits: tuple) -> DataFrame:
    tail = end_id.to_bytes(width, "little")

    def pack(batches):
        encoder, windows = ids_cache(vocabulary, width), Windows(width, *limits)
        rows = Rows(width, TaskContext.get().partitionId() * TASK_STEP)
        for b in batches:
            ids = encoder.look_up([t or "" for t in b.column(1).to_pylist()])
            for doc_id, own in zip(b.column(0).to_pylist(), ids):
                for done in windows.place((doc_id, 0, own + tail, len(own) // width + 1)):
                    rows.add(done)
                if rows.full():
                    yield rows.batch()
        for _, window in windows.free:
            rows.add(windows.held[window], left=True)
        yield rows.batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(pack, DDL)


def _merge_round(left: DataFrame, number: int, width: int, limits: tuple, last: bool) -> DataFrame:
    """Pack the pieces that ``FAN`` tasks of the round before have left."""

    def pack(key, table):
        windows = Windows(width, *limits)
        rows = Rows(width, number * ROUND_STEP + key[0].as_py() * TASK_STEP)
        found = zip(*[table.column(c).to_pylist() for c in
                      ("length", "sequence_id", "offset", "doc_id", "start", "left_ids", "doc_tokens")])
        for _, _, _, *piece in sorted(found, key=lambda r: (-r[0], r[1], r[2])):
            for done in windows.place(tuple(piece)):
                rows.add(done)
        if last:
            for done in windows.close():
                rows.add(done)
        else:
            for _, window in windows.free:
                rows.add(windows.held[window], left=True)
        return pa.Table.from_batches([rows.batch()])

    group = F.floor((F.col("sequence_id") % F.lit(ROUND_STEP)) / F.lit(TASK_STEP * FAN)).cast("long")
    return left.withColumn("__group", group).groupBy("__group").applyInArrow(pack, DDL)


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, most_open: int = OPEN,
         shortest_cut: int = 1, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and ids (little-endian, ``id_width`` bytes each)."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = vocabulary or default_vocabulary()
    folder = folder or shared_folder(spark, "packing")
    width, limits = id_width(vocabulary), (size, most_open, shortest_cut)
    done, number = [], 0
    step = _first_round(docs, vocabulary, width, end_id, limits)
    while True:
        step.write.parquet(f"{folder}/round={number}")
        written = spark.read.schema(DDL).parquet(f"{folder}/round={number}")
        done.append(written.where("ids IS NOT NULL").drop("left_ids"))
        left = written.where("left_ids IS NOT NULL").drop("ids")
        tasks = left.select(F.max(F.floor((F.col("sequence_id") % F.lit(ROUND_STEP)) / F.lit(TASK_STEP)))).first()[0]
        if tasks is None:  # nothing left: an empty table, or the last round
            break
        number += 1
        step = _merge_round(left, number, width, limits, last=tasks < FAN)
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def sequences(pieces: DataFrame, width: int) -> DataFrame:
    """One row per sequence: sequence_id, length, ids (array).  At most ``SIZE`` pieces each."""
    def join(batches):
        for b in batches:
            found = [[p["ids"] for p in sorted(own, key=lambda p: p["offset"])]
                     for own in b.column(1).to_pylist()]
            ids = [np.frombuffer(b"".join(x), f"<u{width}").astype("<i4") for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "length", "ids"])

    return (pieces.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")))
            .mapInArrow(join, "sequence_id long, length long, ids array<int>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("ids")
