"""Minimax contiguous partition of documents into shards of near-equal bytes.

Documents with equal texts form an atomic group.  Groups have a fixed order: large
groups by falling size, then the others by the MD5 of their text.  The smallest
capacity with which a greedy walk over that order needs no more than the given
number of shards is found by binary search; the greedy cuts at that capacity are
the shards' bounds.

The walk needs exact group sizes only near the cuts.  So the driver first gets the
sizes of 4096 blocks of the order (a prefix of the MD5 each).  Taking blocks as
freely divisible gives a lower bound for the capacity and the latest places of each
cut; taking them as atomic gives an upper bound and the earliest places.  Blocks
between those places are cut into 16 parts, and so on, until only single groups
lie there and both bounds agree.  At no time does the driver hold more than a few
thousand block sizes, whatever the input.

A group that is larger than a fair share of what is left gets a shard of its own
first, as no partition can do better for it.

Slots number a shard's rows without gaps.  They are counted within ``SALTS`` parts
of each shard, dealt by a hash of the row, so a hot group spreads over all parts.

DataFrame functions only.  Defined cases: a null text has size 8, crc32 0, and all
null texts are one group (not that of the empty text); null and repeated doc_ids
are rows like others; an empty table gives no rows; with fewer groups than shards
some shards are empty; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, read

SHARDS = 24
LARGE_PER_SHARD = 16       # a group above total / (shards * this) counts as large
FIRST_DIGITS = 3           # MD5 digits of the first blocks
SALTS = 256
NULL_KEY = "~null"


class Block:
    """Consecutive groups: ``key`` is an MD5 prefix, or a whole MD5 for a large group."""
    __slots__ = ("key", "bytes", "groups", "large")

    def __init__(self, key, size, groups, large=False):
        self.key, self.bytes, self.groups, self.large = key, size, groups, large

    @property
    def atomic(self) -> bool:
        return self.groups == 1


def greedy(blocks: list[Block], capacity: int, divisible: bool) -> list[int]:
    """Places (bytes before them) of the cuts of a greedy walk; blocks of several
    groups are cut anywhere if ``divisible``."""
    cuts, load, at = [], 0, 0
    for b in blocks:
        left = b.bytes
        if load + left > capacity:
            if divisible and not b.atomic:
                while load + left > capacity:
                    left -= capacity - load
                    cuts.append(at + b.bytes - left)
                    load = 0
            elif load:
                cuts.append(at)
                load = 0
        load += left
        at += b.bytes
    return cuts


def smallest_capacity(blocks: list[Block], shards: int, least: int, divisible: bool) -> int:
    """Binary search for the smallest capacity (at least ``least``) that is enough."""
    total = sum(b.bytes for b in blocks)
    low, high = max(least, -(-total // shards)), max(least, total)
    while low < high:
        mid = (low + high) // 2
        ok = all(b.bytes <= mid for b in blocks if b.atomic or not divisible)
        if ok and len(greedy(blocks, mid, divisible)) < shards:
            high = mid
        else:
            low = mid + 1
    return low


def open_blocks(blocks: list[Block], shards: int, largest: int) -> tuple[int, list[Block]]:
    """(Lower bound of the capacity, blocks of several groups that a cut may touch)."""
    low = smallest_capacity(blocks, shards, largest, True)
    high = smallest_capacity(blocks, shards, largest, False)
    total = sum(b.bytes for b in blocks)

    def padded(cuts):
        return (cuts + [total] * shards)[:shards]

    early, late = padded(greedy(blocks, low, False)), padded(greedy(blocks, high, True))
    out, at = [], 0
    for b in blocks:
        if not b.atomic and (b.bytes > low or any(
                at < z and at + b.bytes > a for a, z in zip(early, late))):
            out.append(b)
        at += b.bytes
    return low, out


def _sizes(groups: DataFrame, digits: int) -> list[Block]:
    rows = (groups.groupBy(F.substring("key", 1, digits).alias("p"))
            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect())
    return sorted((Block(r["p"], r["bytes"], r["n"]) for r in rows), key=lambda b: b.key)


def plan(groups: DataFrame, shards: int = SHARDS) -> tuple[int, dict[str, int], list[str], int]:
    """(capacity, large group -> shard, first keys of the shards that share the rest, their
    first shard).  ``groups``: key, bytes."""
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    if not total:
        return 0, {}, [], 0
    # Fewer than shards * LARGE_PER_SHARD groups can be this large.
    large = sorted(((r["bytes"], r["key"]) for r in groups.where(
        F.col("bytes") > total // (shards * LARGE_PER_SHARD) + 1).collect()),
        key=lambda x: (-x[0], x[1]))
    alone: dict[str, int] = {}
    rest, left = total, shards
    for size, key in large:
        if left == 1 or size * left < rest:
            break
        alone[key] = len(alone)
        rest, left = rest - size, left - 1
    head = [Block(k, s, 1, True) for s, k in large if k not in alone]
    small = groups.where(~F.col("key").isin([k for _, k in large])) if large else groups
    digits, body = FIRST_DIGITS, _sizes(small, FIRST_DIGITS)
    largest = max([b.bytes for b in head]
                  + [small.agg(F.max("bytes")).first()[0] or 0])
    while True:
        capacity, todo = open_blocks(head + body, left, largest)
        if not todo:
            break
        digits += 1
        finer = _sizes(small.where(F.substring("key", 1, digits - 1).isin([b.key for b in todo])),
                       digits)
        again = {b.key for b in todo}
        body = sorted([b for b in body if b.key not in again] + finer, key=lambda b: b.key)
    placed, firsts, shard, load = dict(alone), [], len(alone), 0
    for b in head + body:
        if load and load + b.bytes > capacity:
            shard, load = shard + 1, 0
            firsts += [] if b.large else [b.key]
        elif not b.large and not firsts:
            firsts.append(b.key)  # the shard in which the small groups begin
        load += b.bytes
        if b.large:
            placed[b.key] = shard
    return max([capacity, *(s for s, k in large if k in alone)]), placed, firsts, \
        shard + 1 - len(firsts)


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key per row."""
    spark = docs.sparkSession
    raw = F.col(text).cast("binary")
    slim = checkpointed(docs.select(
        "doc_id", (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(raw), F.lit(NULL_KEY)).alias("key")))
    groups = checkpointed(slim.groupBy("key").agg(F.sum("size").alias("bytes")))
    _, placed, firsts, base = plan(groups, shards)

    shard = F.lit(base)
    for key in firsts[1:]:
        shard = shard + (F.col("key") >= key).cast("int")
    if placed:  # large groups only: fewer than shards * LARGE_PER_SHARD
        values = ", ".join(f"('{k}', {s})" for k, s in placed.items())
        table = spark.sql(f"SELECT * FROM VALUES {values} AS t(key, own)")
        slim = slim.join(F.broadcast(table), "key", "left")
        shard = F.coalesce("own", shard)
    dealt = slim.select("doc_id", "size", "text_crc32", "key", shard.cast("int").alias("shard"),
                        F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).alias("salt"))
    counts = dealt.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = counts.select("shard", "salt", (F.sum("n").over(
        W.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("shard", "salt").orderBy("doc_id", "key"))
    return (dealt.withColumn("own", own)
            .join(F.broadcast(before), ["shard", "salt"])  # shards * SALTS rows
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("own") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), F.col("key").alias("group_key")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
