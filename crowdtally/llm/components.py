"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple:
    # Wrapping 64-bit sum: equal for equal sets of edges whatever their order.
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _smallest(edges: DataFrame) -> DataFrame:
    """u -> smallest of its neighbours and itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_smallest(both), "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(low)
    return (low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u <> v"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    ``edges`` has two columns of one ordered type.  Each round replaces edges by
    stars around smaller nodes; the table never gets longer than twice its start,
    and rounds stop when a round changes nothing (logarithmically many).  Joins are
    by node, with one side unique, so a hub's rows can be split.  An empty table
    gives an empty result."""
    a, b = edges.columns
    now = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                       .where("u <> v").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        now = checkpointed(_small_star(_large_star(now).distinct()).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
