"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square test.

Largest inner product becomes smallest Euclidean distance by one more coordinate:
with R the largest norm, x gets sqrt(R^2 - |x|^2) and a query gets 0; then
|x' - q'|^2 = R^2 + |q|^2 - 2 x.q.  Vectors are projected to ``PROJECTED`` dimensions
by a Gaussian (2-stable) matrix.  The squared projected distance over the squared
true one follows a chi-square law with that many degrees of freedom.

Points are visited in the order of their projected distance (by boxes of a kd-tree)
and verified by their exact inner product.  A query stops when the projected
distance r of what is left satisfies r^2 >= t * d^2, d being the true distance of its
k-th best so far and t the ``CERTAINTY`` quantile of the chi-square law: a point that
is nearer than d would then be among those already seen with that probability.

On Spark: the top levels of the kd-tree are fitted on at most about ``SAMPLE_BOUND``
vectors; every vector goes to the cell it falls in.  Each query first searches its
own cell, which gives it a distance bound; then it goes to just those other cells
whose boxes the chi-square test does not rule out.  Only the (query, cell) pairs are
counted first: a cell that more than ``QUERY_BLOCK`` queries visit gets them in blocks
of that size (on average), its points being sent to each block, so points are copied
where queries meet, not by the number of all queries.  A cell of more than
``CHUNK_VALUES`` vector components is cut by hash into chunks, which its queries search
one by one, so that a task's size does not follow the table's.  Equal vectors are one point that carries its smallest k + 1 ids, which is all
a result can use; so copies cost nothing and lose nothing.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part (no result as queries either); so do vectors of another
length than the most frequent one (the longer, if equally many) and rows with a null
id; repeated ids with different vectors are points of their own, and a query leaves
out all points with its id; fewer candidates than k are all returned; ties go to the
smaller id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, read, ship

K, QUERY_STEP = 20, 20
PROJECTED = 10
CERTAINTY = 0.97
SAMPLE_BOUND = 32_768
CELL_POINTS, MOST_CELLS = 2048, 8192
QUERY_BLOCK = 16_384
CHUNK_VALUES = 1 << 22
LEAF = 128
SEED = 7


def chi_square_cdf(x: float, m: int) -> float:
    """The regularised lower incomplete gamma function at (m / 2, x / 2), by its series."""
    a, z = m / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def projection(dim: int, m: int = PROJECTED) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, m))


def project(vectors: np.ndarray, norm: float | None, matrix: np.ndarray) -> np.ndarray:
    """Points (with the largest norm given) or queries (None) in the projected space."""
    extra = np.zeros(len(vectors)) if norm is None else np.sqrt(
        np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
    return vectors @ matrix[:-1] + extra[:, None] * matrix[-1]


# --- kd-trees ---------------------------------------------------------------

def kd_order(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves of a kd-tree (median splits of the widest dimension) as index arrays."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        idx = stack.pop()
        own = points[idx]
        wide = np.ptp(own, axis=0) if len(idx) else np.zeros(points.shape[1])
        if len(idx) <= leaf or wide.max() == 0:
            out.append(idx)
            continue
        half = len(idx) // 2
        order = np.argpartition(own[:, wide.argmax()], half)
        stack += [idx[order[half:]], idx[order[:half]]]
    return out


class Cells:
    """Top kd-tree fitted on a sample: places points, and bounds distances to cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.low, self.high = [], []
        m = sample.shape[1]
        self.root = self._grow(sample, cells, np.full(m, -np.inf), np.full(m, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points, cells, low, high):
        wide = np.ptp(points, axis=0) if len(points) else np.zeros(points.shape[1])
        if cells <= 1 or len(points) < 2 or wide.max() == 0:
            self.low.append(low)
            self.high.append(high)
            return len(self.low) - 1
        d = int(wide.argmax())
        at = float(np.median(points[:, d]))
        left = points[:, d] <= at
        if left.all():
            at = float(points[:, d][points[:, d] < at].max())
            left = points[:, d] <= at
        upper, lower = high.copy(), low.copy()
        upper[d] = lower[d] = at
        return (d, at, self._grow(points[left], cells // 2, low, upper),
                self._grow(points[~left], cells - cells // 2, lower, high))

    def place(self, points: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while stack:
            node, idx = stack.pop()
            if not isinstance(node, tuple):
                out[idx] = node
            elif len(idx):
                left = points[idx, node[0]] <= node[1]
                stack += [(node[2], idx[left]), (node[3], idx[~left])]
        return out


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d:d + 1]
        gap = np.maximum(np.maximum(low[None, :, d] - p, p - high[None, :, d]), 0)
        out += gap * gap
    return out


def search(points: np.ndarray, lows: np.ndarray, flat: np.ndarray, queries: np.ndarray,
           flat_queries: np.ndarray, least: np.ndarray, norm: float, k: int, limit: float):
    """The best k of ``points`` for each query, ties to the smaller ``lows``: (scores,
    places of the points, -1 where there are fewer).

    ``flat``: projected; ``least``: a score that a result must reach to be of use
    (-inf if none); ``limit``: the chi-square quantile."""
    n = len(queries)
    best = np.full((n, k), -np.inf)
    best_at = np.full((n, k), -1, np.int64)
    leaves = kd_order(flat, LEAF)
    low = np.array([flat[i].min(axis=0) for i in leaves])
    high = np.array([flat[i].max(axis=0) for i in leaves])
    gap = box_distances(flat_queries, low, high)
    order = np.argsort(gap, axis=1, kind="stable")
    size = (queries * queries).sum(axis=1)
    active = np.arange(n)
    for turn in range(len(leaves)):
        leaf = order[active, turn]
        bound = np.maximum(best[active, -1], least[active])
        far = np.maximum(norm * norm + size[active] - 2 * bound, 0)
        # -inf as bound leaves the distance infinite: nothing can be ruled out yet.
        go = ~(gap[active, leaf] >= limit * far) | np.isneginf(bound)
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        for part in np.split(by, np.nonzero(np.diff(leaf[by]))[0] + 1):
            q, idx = active[part], leaves[leaf[part[0]]]
            scores = queries[q] @ points[idx].T
            scores = np.concatenate([best[q], scores], axis=1)
            at = np.concatenate([best_at[q], np.broadcast_to(idx, (len(q), len(idx)))], axis=1)
            take = np.lexsort((lows[at], -scores), axis=1)[:, :k]
            best[q] = np.take_along_axis(scores, take, axis=1)
            best_at[q] = np.take_along_axis(at, take, axis=1)
    return best, best_at


# --- the table --------------------------------------------------------------

def layout(index: DataFrame, asks: DataFrame, dim: int) -> DataFrame:
    """(cell, blocks, chunks) for each cell that is asked: at most ``MOST_CELLS`` rows."""
    points = index.groupBy("cell").agg(F.ceil(F.count("*") * F.lit(dim) / F.lit(CHUNK_VALUES)).alias("chunks"))
    blocks = asks.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).alias("blocks"))
    return points.join(blocks, "cell")


def _upto(n: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def spread(index: DataFrame, plan: DataFrame) -> DataFrame:
    """The points of the asked cells, each in its chunk, once for each block of queries."""
    return index.join(F.broadcast(plan), "cell").select(
        "cell", F.pmod(F.xxhash64("key", F.lit(11)), F.col("chunks")).alias("chunk"), _upto("blocks").alias("block"),
        "key", "vec", "low")


def asked_of(asks: DataFrame, plan: DataFrame) -> DataFrame:
    """The queries (key, vec, cell, least) in their block, once for each chunk of the cell."""
    return asks.join(F.broadcast(plan), "cell").select(
        "cell", _upto("chunks").alias("chunk"), F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).alias("block"),
        "key", "vec", "least")


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of rows that take part, vec as doubles."""
    rows = vectors.select(F.col(key).cast("long").alias("id"),
                          F.col(vector).cast("array<double>").alias("vec"))
    fine = (F.col("id").isNotNull() & F.col("vec").isNotNull()
            & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vec", lambda x: x != 0))
    rows = rows.where(fine)
    common = (rows.groupBy(F.size("vec").alias("n")).count()
              .orderBy(F.desc("count"), F.desc("n")).limit(1).collect())
    return rows.where(F.size("vec") == (common[0]["n"] if common else 0))


def nearest(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, key: str = "vec_id",
            vector: str = "embedding", certainty: float = CERTAINTY) -> DataFrame:
    """query_id, rank, vec_id, score for every query (id divisible by ``query_step``)."""
    spark, more = vectors.sparkSession, k + 1
    ship(spark)
    rows = checkpointed(usable(vectors, key, vector))
    # One point per different vector, named by its smallest id, with its k + 1 smallest ids.
    firsts = (rows.distinct()
              .withColumn("n", F.row_number().over(W.partitionBy("vec").orderBy("id")))
              .where(F.col("n") <= more)
              .groupBy("vec").agg(F.min("id").alias("low"),
                                  F.sort_array(F.collect_list("id")).alias("ids")))
    # Equal smallest ids (a repeated id with different vectors) are told apart by a number.
    points = checkpointed(firsts.select(
        F.xxhash64("vec", "low").alias("key"), "low", "ids", "vec"))
    info = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"),
                      F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("r")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not info["n"]:
        return spark.createDataFrame([], schema)
    norm, matrix = math.sqrt(info["r"]), projection(info["dim"])
    share = min(1.0, SAMPLE_BOUND / info["n"])
    sample = np.array([r["vec"] for r in points.where(
        F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
        .select("vec").toLocalIterator()]).reshape(-1, info["dim"])
    cells = Cells(project(sample, norm, matrix),
                  max(1, min(MOST_CELLS, math.ceil(info["n"] / CELL_POINTS))))
    limit = chi_square_quantile(certainty, PROJECTED)
    sent = spark.sparkContext.broadcast((cells, matrix))

    def matrix_of(column) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)

    def place(batches):
        cells, matrix = sent.value
        for b in batches:
            own = cells.place(project(matrix_of(b.column("vec")), norm, matrix)) \
                if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)],
                                             names=[*b.schema.names, "cell"])

    index = checkpointed(points.mapInArrow(place, 
                              "key long, low long, ids array<long>, vec array<double>, cell long"))
    asked = rows.where(F.col("id") % query_step == 0)
    owners = checkpointed(asked.select(F.col("id").alias("query_id"), "vec")
                          .join(points.select("vec", "key"), "vec").select("query_id", "key"))
    queries = index.join(owners.select("key").distinct(), "key", "left_semi")
    def visit(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"key": np.zeros(0, np.int64), **{
                c: pd.Series([], dtype=object) for c in ("names", "lows", "scores")}})
        _, matrix = sent.value
        x, q = np.stack(points["vec"].to_numpy()), np.stack(queries["vec"].to_numpy())
        keys, lows = points["key"].to_numpy(), points["low"].to_numpy()
        scores, at = search(x, lows, project(x, norm, matrix), q, project(q, None, matrix),
                            queries["least"].to_numpy(float), norm, more, limit)
        # What doesn't reach the home cell's k-th best can't be in the result.
        found = [a[(a >= 0) & (s >= low)] for a, s, low in zip(at, scores, queries["least"])]
        return pd.DataFrame({"key": queries["key"].to_numpy(),
                             "names": [keys[a].tolist() for a in found],
                             "lows": [lows[a].tolist() for a in found],
                             "scores": [s[:len(a)].tolist() for s, a in zip(scores, found)]})

    found_schema = "key long, names array<long>, lows array<long>, scores array<double>"

    def through(asks: DataFrame, asking: DataFrame) -> DataFrame:
        plan = checkpointed(layout(index, asks, info["dim"]))
        by = ("cell", "chunk", "block")
        return checkpointed(spread(index, plan).groupBy(*by).cogroup(
            asked_of(asking, plan).groupBy(*by)).applyInPandas(visit, found_schema))

    # First each query's own place in the tree (as a query, not as a point) ...
    def ask(batches):
        cells, matrix = sent.value
        for b in batches:
            own = cells.place(project(matrix_of(b.column("vec")), None, matrix)) \
                if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("vec"), pa.array(own)],
                                             names=["key", "vec", "home"])

    homes = queries.select("key", "vec").mapInArrow(ask, "key long, vec array<double>, home long")
    homes = checkpointed(homes)
    own = homes.select("key", "vec", F.col("home").alias("cell"), F.lit(float("-inf")).alias("least"))
    near = through(own, own)
    first = near.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("scores")), asc=False).alias("s"))
    bound = first.select("key", F.when(F.size("s") >= more, F.element_at("s", more))
                         .otherwise(F.lit(float("-inf"))).alias("least"))

    # ... then the other cells that the test does not rule out.
    def further(batches):
        cells, matrix = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix_of(b.column("vec"))
            least = b.column("least").to_numpy(zero_copy_only=False)
            gap = box_distances(project(q, None, matrix), cells.low, cells.high)
            far = np.maximum(norm * norm + (q * q).sum(axis=1) - 2 * least, 0)
            go = ~(gap >= limit * far[:, None]) | np.isneginf(least)[:, None]
            go[np.arange(len(q)), b.column("home").to_numpy()] = False
            who, cell = np.nonzero(go)
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(at) for c in ("key", "least")]
                + [pa.array(cell.astype(np.int64))], names=["key", "least", "cell"])

    rest = checkpointed(homes.join(bound, "key").select("key", "vec", "least", "home")
                        .mapInArrow(further, "key long, least double, cell long"))
    # One short list per query and chunk; each query's lists are merged as arrays.
    both = near.unionByName(through(rest, rest.join(homes.select("key", "vec"), "key"))).withColumn("p", F.transform(
        F.arrays_zip("scores", "lows", "names"),
        lambda x: F.struct((-x["scores"]).alias("far"), x["lows"].alias("low"), x["names"].alias("name"))))
    best = both.groupBy("key").agg(F.flatten(F.collect_list("p")).alias("p")).select(
        "key", F.explode(F.slice(F.array_sort("p"), 1, more)).alias("p")).select(
        "key", (-F.col("p.far")).alias("score"), F.col("p.name").alias("name"))
    # Points back to ids; equal vectors have equal scores.
    named = (best.join(index.select(F.col("key").alias("name"), "ids"), "name")
             .groupBy("key").agg(F.collect_list(F.struct("score", "ids")).alias("found")))
    hits = owners.join(named, "key").select("query_id", F.explode("found").alias("f")).select(
        "query_id", F.col("f.score").alias("score"), F.explode("f.ids").alias("vec_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (hits.where("vec_id <> query_id").groupBy("query_id", "vec_id")
            .agg(F.max("score").alias("score"))
            .withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
