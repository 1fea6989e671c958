"""Global ranking without a single-partition window.

``F.dense_rank().over(Window.orderBy(key))`` moves every row into one task.
Here rows are range-partitioned and sorted on the ordering columns; each row
then knows its partition and its index inside it from
``monotonically_increasing_id`` (partition id in the upper 31 bits, row index
in the lower 33).  A table with one row per partition holds the prefix sums of
the partition sizes and is the only thing that is broadcast; its size is
bounded by the partition count.  The sorted frame is checkpointed so that the
counting pass and the numbering pass see the same partition bounds even if an
executor is lost in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def global_position(df: DataFrame, order: list[Column | str], out: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out`` = 0-based position of the row in ascending ``order``.
    The order must be total (end it with a unique column)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    ordered = (df.repartitionByRange(n, *order)
               .sortWithinPartitions(*order)
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = cut_lineage(ordered)
    with_pid = ordered.withColumn("_pid", F.shiftright("_mid", 33))
    sizes = with_pid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a window over it is a window over <= n rows.
    offsets = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    ranked = with_pid.join(F.broadcast(offsets), "_pid")
    return ranked.select(*cols, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))).alias(out))


def dense_rank_global(df: DataFrame, key: str, out: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Rows of ``df`` made distinct on ``key`` (other columns from any row) with
    ``out`` = dense rank of ``key`` ascending, from 1.  Null keys are dropped."""
    keyed = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    pos = global_position(keyed, [key], "_pos0", num_partitions)
    return pos.select(*df.columns, (F.col("_pos0") + 1).alias(out))


def position_in_group(df: DataFrame, group: str, order: list[Column | str], out: str = "pos") -> DataFrame:
    """0-based position of each row inside its ``group`` along ``order``, plus the
    group size ``<out>_n``.  A hot group is spread over many tasks (the sort is
    global); only one row per group is aggregated for the group offsets."""
    g = global_position(df, [F.col(group)] + list(order), "_g")
    starts = g.groupBy(group).agg(F.min("_g").alias("_start"), F.count(F.lit(1)).alias(f"{out}_n"))
    # One row per group joins the rows: Spark broadcasts it below its size limit; beyond,
    # it is a sort-merge join whose hot groups AQE splits.
    return g.join(starts, group).select(*df.columns, (F.col("_g") - F.col("_start")).alias(out), f"{out}_n")
