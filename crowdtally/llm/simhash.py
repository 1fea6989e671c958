"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints: words are runs of non-space bytes of the text with A-Z lower-cased;
every run of ``shingle`` words (repeats included) is hashed by XXH64 with seed 42;
a fingerprint bit is set if it is set in over half of the hashes.

Linking: distinct fingerprints are split by a vantage-point tree.  A node has a
vantage point and a threshold t; points at distance <= t go inside, points at
distance > t - radius go outside, so the inner points within ``radius`` of the
boundary go to both.  By the triangle inequality the
distances of two linked points to any vantage point differ by ``radius`` at most;
so each linked pair meets in some shard, and no pair is lost.  Inside a shard the
same split goes on in memory down to small leaves, which are compared exactly.

A shard reports, for each of its points that has a link, the smallest point of
its component there, not the pairs: the number of rows is at most the number of
points.  These edges are joined to components over all shards.

Bounds: trees are fitted on at most about ``SAMPLE_BOUND`` fingerprints per round
(the driver sees no others), and shards above ``SHARD_LIMIT`` points are split
again with a sample of their own.  Distances in a dense shard (very many fingerprints
a few bits apart) may be too alike for any vantage point to split it.  Its points are
linked through the fingerprints that lie between them: two points within ``radius``
have a common one within half of it, and no more than a ball of points share one, so
this too is exact, and no task grows with the shard (65 rows a point are shuffled for
a radius of 2, and a point has at most as many edges).  Exact copies share a fingerprint
and count once.

Defined cases: a null or empty text has fingerprint zero, and such documents are
linked like any other; a text of any length is hashed whole, in slices of bounded
size; rows with a null doc_id get a component, whose id is the smallest doc_id that
is not null (null if there is none); repeated rows are kept; an empty table gives no
rows.  Other columns of the documents take no part in the search, whatever their names,
and ``deduplicate`` returns them as they are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_columns, read
from .components import components

SHINGLE, RADIUS = 3, 2
SAMPLE_BOUND = 1 << 16
SHARD_POINTS = 1 << 15     # aimed at: a task goes on splitting in memory, without copies
MOST_SHARDS = 4096         # per round
SHARD_LIMIT = 200_000      # split again beyond
LEAF = 512
FLIPS = [0, *(1 << b for b in range(63)), -1 << 63]  # each bit of a signed long, and none
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# --- fingerprints -----------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = itertools.chain([0], (e + 1 for e in ends))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1:])]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at:at + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE,
                     keep: list[str] | None = None) -> DataFrame:
    """Append ``fp``: the fingerprint as a signed 64-bit integer."""
    def run(texts):
        prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        return [prints.view(np.int64)]

    return map_columns(docs, {"text": F.col(text)}, run, [T.StructField("fp", T.LongType())], keep)


# --- vantage-point trees ----------------------------------------------------

def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def best_split(points: np.ndarray, radius: int, rng: np.random.Generator):
    """(vantage, threshold) with the fewest points on both sides among a few
    candidates, or None if no split makes both sides clearly smaller."""
    n, best = len(points), None
    seen = points if n <= 4096 else points[rng.choice(n, 4096, replace=False)]
    for v in points[rng.choice(n, min(n, 6), replace=False)]:
        hist = np.bincount(distances(seen, v), minlength=65 + radius)
        inside = np.cumsum(hist)
        for t in range(64):
            left = inside[t]
            right = len(seen) - (inside[t - radius] if t >= radius else 0)
            most = max(left, right)
            if most <= 0.75 * len(seen) and (best is None or left + right + most < best[0]):
                best = (left + right + most, v, t)
    return best and best[1:]


def sides(points: np.ndarray, vantage, t: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks: inside, and outside with the inner points within the radius of the boundary."""
    d = distances(points, vantage)
    return d <= t, d > t - radius


class Tree:
    """Top tree: inner nodes (vantage, threshold, left, right), leaves are shard numbers."""

    def __init__(self, sample: np.ndarray, leaf_points: int, radius: int, first: int):
        self.radius, self.next, rng = radius, first, np.random.default_rng(5)
        self.root = self._grow(sample, leaf_points, rng)

    def _grow(self, points, leaf_points, rng):
        cut = best_split(points, self.radius, rng) if len(points) > leaf_points else None
        if cut is None:
            self.next += 1
            return self.next - 1
        left, right = sides(points, *cut, self.radius)
        return (*cut, self._grow(points[left], leaf_points, rng),
                self._grow(points[right], leaf_points, rng))

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, shard), several shards for points near boundaries."""
        at, shards = [], []
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, idx = stack.pop()
            if not len(idx):
                continue
            if isinstance(node, tuple):
                v, t, low, high = node
                left, right = sides(points[idx], v, t, self.radius)
                stack += [(low, idx[left]), (high, idx[right])]
            else:
                at.append(idx)
                shards.append(np.full(len(idx), node, np.int64))
        return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(
            shards or [np.zeros(0, np.int64)])


def local_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (point, smaller point) that connect each component of the distinct ``points``."""
    edges, rng = [], np.random.default_rng(3)
    stack = [points]
    while stack:
        part = stack.pop()
        cut = best_split(part, radius, rng) if len(part) > LEAF else None
        if cut is not None:
            left, right = sides(part, *cut, radius)
            stack += [part[left], part[right]]
            continue
        if len(part) <= LEAF:  # keep only points that have a link at all
            near = np.bitwise_count(part[:, None] ^ part[None, :]) <= radius
            part = part[near.sum(axis=1) > 1]
        while len(part):  # one component after another; each point is expanded once
            root, part, frontier = part[0], part[1:], [part[0]]
            while frontier and len(part):
                near = distances(part, frontier.pop()) <= radius
                if near.any():
                    found = part[near]
                    part = part[~near]
                    frontier += list(found)
                    edges += [(int(x), int(root)) for x in found]
    return edges


# --- the corpus -------------------------------------------------------------

def _split_shards(points: DataFrame, radius: int) -> tuple[DataFrame, list[int]]:
    """(shard, fp) of distinct fingerprints, each in every shard it may have links in;
    and the shards above ``SHARD_LIMIT`` that no vantage point splits."""
    spark = points.sparkSession
    now = points.select(F.lit(0).cast("long").alias("shard"), "fp")
    n = now.count()
    large, next_shard, limit, settled = {0: n} if n > SHARD_POINTS else {}, 1, SHARD_POINTS, set()
    while large:
        total = sum(large.values())
        wanted = now.where(F.col("shard").isin(list(large))) if large.keys() != {0} else now
        share = min(0.25, SAMPLE_BOUND / total)
        got = wanted.where(F.pmod(F.xxhash64("fp", F.lit(next_shard)), F.lit(1 << 30))
                           < int(share * (1 << 30))).toPandas()
        aim = max(limit, total // MOST_SHARDS)
        trees = {}
        for shard, part in got.groupby("shard"):
            tree = Tree(part["fp"].to_numpy(np.int64).view(np.uint64),
                        max(8, int(aim * share)), radius, next_shard)
            if isinstance(tree.root, tuple):
                trees[int(shard)] = tree
                next_shard = tree.next
        settled |= large.keys() - trees.keys()
        if not trees:
            break
        sent = spark.sparkContext.broadcast(trees)  # at most 2 * SAMPLE_BOUND / 8 nodes

        def route(batches):
            for b in batches:
                shard = b.column(0).to_numpy(zero_copy_only=False)
                fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                outs = [(shard, fp)]
                moved = np.isin(shard, list(sent.value))
                if moved.any():
                    outs = [(shard[~moved], fp[~moved])]
                    for s in np.unique(shard[moved]):
                        own = fp[shard == s]
                        at, to = sent.value[int(s)].route(own)
                        outs.append((to, own[at]))
                for to, own in outs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to, pa.int64()), pa.array(own.view(np.int64), pa.int64())],
                        names=["shard", "fp"])

        now = checkpointed(now.mapInArrow(route, "shard long, fp long"))
        limit = SHARD_LIMIT
        large = {r["shard"]: r["count"] for r in
                 now.groupBy("shard").count().where(F.col("count") > limit).toLocalIterator()
                 if r["shard"] not in settled}
    if n <= SHARD_LIMIT or not settled:
        return now, []
    left = now.where(F.col("shard").isin(list(settled))).groupBy("shard").count()
    return now, [r["shard"] for r in left.where(F.col("count") > SHARD_LIMIT).collect()]


def _dense_edges(points: DataFrame, radius: int) -> DataFrame:
    """(a, b) edges between the distinct ``points`` through fingerprints between them."""
    near = points.select("fp", F.col("fp").alias("between"))
    for _ in range((radius + 1) // 2):
        flipped = [F.col("between").bitwiseXOR(F.lit(m)) for m in FLIPS]
        near = near.select("fp", F.explode(F.array(*flipped)).alias("between"))
    # At most as many points as the ball around a fingerprint has.
    met = near.groupBy("between").agg(F.sort_array(F.collect_set("fp")).alias("own")).where(
        F.size("own") > 1)
    if radius % 2 == 0:  # all that meet are linked
        return met.select(F.explode(F.slice("own", 2, F.size("own"))).alias("a"),
                          F.col("own")[0].alias("b")).distinct()
    pairs = met.select(F.explode("own").alias("a"), "own").select(
        "a", F.explode(F.filter("own", lambda b: b < F.col("a"))).alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def link_edges(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column ``fp``) that keep every component."""
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(part["fp"].to_numpy(np.int64)).view(np.uint64)
        edges = np.array(local_links(own, radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    shards, dense = _split_shards(points, radius)
    if not dense:
        return shards.groupBy("shard").applyInPandas(solve, "a long, b long")
    among = F.col("shard").isin(dense)
    return shards.where(~among).groupBy("shard").applyInPandas(solve, "a long, b long").union(
        _dense_edges(shards.where(among).select("fp").distinct(), radius))


def fingerprint_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, group) for every distinct fingerprint; linked ones share the group."""
    points = checkpointed(prints.select("fp").distinct())
    linked = checkpointed(components(link_edges(points, radius)))
    return points.join(linked, points.fp == linked.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("group"))


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, text_hash, fingerprint, component_id, keep.

    ``keep`` marks one document of each component: the smallest doc_id (nulls
    last), then text hash; rows equal in both are all marked."""
    prints = checkpointed(with_fingerprint(
        docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")),
        "text", shingle, keep=["doc_id", "text_hash"]))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(order).alias("best"))
    # The frame of distinct fingerprints: one row each, with its group.
    groups = firsts.join(fingerprint_groups(prints, radius), "fp")
    whole = groups.groupBy("group").agg(F.min("low").alias("component_id"),
                                        F.min("best").alias("chosen"))
    by_print = groups.select("fp", "group").join(whole, "group").drop("group")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(by_print, "fp").select(
        "doc_id", "text_hash", hexed.alias("fingerprint"), "component_id",
        (order == F.col("chosen")).alias("keep"))


def deduplicate(docs: DataFrame, text: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """The documents with one row of each component, all columns as they are."""
    kept = near_duplicates(docs, text, shingle, radius).where("keep").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__text_hash", F.xxhash64(text))
    one = W.partitionBy("doc_id", "__text_hash").orderBy(
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = rows.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["__id"])
                     & (rows["__text_hash"] == kept["__hash"]), "left_semi").select(
        *[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")
