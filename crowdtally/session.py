"""SparkSession construction and lineage-cutting helpers."""

from __future__ import annotations

import uuid
import warnings
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "crowdtally", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    ``master`` and ``shuffle_partitions`` are only set when given, so that on a
    cluster the submitting environment stays in charge of them.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints and scratch tables.

    It is what ``spark.checkpoint.dir`` names (or what the context was given); where
    neither is set, a folder below the SQL warehouse.  A cluster's executors must share
    it, so there a warning says so.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not wanted and not sc.master.startswith("local"):
            warnings.warn("spark.checkpoint.dir is not set: scratch data goes below the SQL warehouse "
                          f"({spark.conf.get('spark.sql.warehouse.dir')}), which all executors must share",
                          stacklevel=2)
        sc.setCheckpointDir(wanted or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        current = sc.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable (not local) checkpoint: materialises ``df`` into the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of a loop's rounds in the shared folder.  A table that is read back has the
    size of its files; a checkpoint keeps the estimate of its plan, which joins of a loop
    multiply beyond all bounds.  ``table`` writes one, ``only`` removes all but some."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, DataFrame] = {}
        self.names: dict[str, str] = {}

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths[path] = back = self.spark.read.schema(df.schema).parquet(path)
        return back

    def dealt(self, df: DataFrame, buckets: int, column: str) -> DataFrame:
        """A table dealt to ``buckets`` by ``column``.  Joins and aggregates of such tables by
        keys with this column need no exchange (joins: within ``joins_as_dealt``), and a
        result dealt that way is written as it lies."""
        path, name = f"{self.root}/{uuid.uuid4().hex}", f"scratch_{uuid.uuid4().hex}"
        (df.repartition(buckets, column).write.format("parquet").option("path", path)
         .bucketBy(buckets, column).sortBy(column).saveAsTable(name))
        self.paths[path] = back = self.spark.table(name)
        self.names[path] = name
        return back

    def only(self, *kept: DataFrame) -> None:
        for path, df in list(self.paths.items()):
            if not any(df is k for k in kept):
                if path in self.names:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(path)}")
                remove(self.spark, path)
                del self.paths[path]


@contextmanager
def joins_as_dealt(spark: SparkSession):
    """Joins leave rows where they are if both sides are dealt alike by some of the join's keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
