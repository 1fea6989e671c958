"""Relational source and sink for the study tables.

``load_tables`` reads one folder (or table per sub-folder) with explicit
schemas; ``write_tables`` is the sink for every table.  ``post`` and
``classification`` are partitioned by ``studyId`` so that per-study work
prunes whole directories.  ``write_changes`` applies a batch of changes to a stored
table and rewrites the touched partitions only.  ``write_bucketed`` stores answers and
posts as tables dealt and sorted by post, so that consensus and progress need no exchange
of answers.  A JDBC source has the same call shape
(``spark.read.jdbc``) but is not exercised here: no database server runs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .. import schemas
from ..session import Scratch, remove

PARTITION_COLUMNS = {"post": ["studyId"], "classification": ["studyId"]}

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_tables(spark: SparkSession, base: str, fmt: str = "parquet",
                names: list[str] | None = None) -> dict[str, DataFrame]:
    """Study tables stored as ``<base>/<table>/`` with the schemas of ``schemas``."""
    out = {}
    for name in names or list(schemas.TABLES):
        schema = StructType(list(schemas.TABLES[name].fields))  # copy: add() mutates
        for part in PARTITION_COLUMNS.get(name, []):
            if part not in schema.fieldNames():
                schema = schema.add(part, LongType(), True)
        out[name] = spark.read.format(fmt).schema(schema).load(os.path.join(base, name))
    return out


def load_jdbc_tables(spark: SparkSession, url: str, properties: dict, names: list[str] | None = None,
                     partitioning: dict | None = None) -> dict[str, DataFrame]:
    """The same tables from a relational database.  ``partitioning`` maps a table
    to (column, lower, upper, numPartitions) so big tables are read by many
    tasks.  Columns are cast to the schemas of ``schemas`` (the password column
    of ``user`` is never selected).  Not exercised in tests: no server runs."""
    out = {}
    for name in names or list(schemas.TABLES):
        r = spark.read
        if partitioning and name in partitioning:
            col, lo, hi, n = partitioning[name]
            df = r.jdbc(url, f"`{name}`", column=col, lowerBound=lo, upperBound=hi, numPartitions=n,
                        properties=properties)
        else:
            df = r.jdbc(url, f"`{name}`", properties=properties)
        fields = [f for f in schemas.TABLES[name].fields if f.name in df.columns]
        out[name] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    return out


def classification_with_study(classification: DataFrame, question: DataFrame) -> DataFrame:
    """studyId of each answer, taken from its question (a dimension table)."""
    return classification.join(question.select(F.col("id").alias("questionId"), "studyId"), "questionId")


def write_tables(tables: dict[str, DataFrame], base: str, mode: str = "overwrite",
                 question: DataFrame | None = None) -> list[str]:
    """Sink for every table; returns the written paths.

    ``classification`` has no studyId of its own; it is taken from ``question``
    when given so the table can be partitioned by study.
    """
    written = []
    for name, df in tables.items():
        if name == "classification" and question is not None and "studyId" not in df.columns:
            df = classification_with_study(df, question)
        parts = [c for c in PARTITION_COLUMNS.get(name, []) if c in df.columns]
        path = os.path.join(base, name)
        w = df.write.mode(mode)
        if parts:
            # Rebalanced by the partition column: large studies are split over tasks and
            # small ones share them, so the number of files follows the data.
            w = df.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts)
        w.parquet(path)
        written.append(path)
    return written


def rows_of_touched(old: DataFrame, touched: DataFrame, part: str) -> DataFrame:
    """The rows of the partitions with n > 0 in ``touched`` (a comparison is what makes Spark
    prune the scan of ``old`` by the other side's values)."""
    return old.join(touched.where("n > 0").select(part), part, "left_semi")


def write_changes(spark: SparkSession, base: str, name: str, changes: DataFrame, key: str = "id") -> DataFrame:
    """Apply a batch of changes (see ``apply_changes``) to the stored table ``name`` and
    rewrite only the partitions with a changed row; returns the status of each change.

    The partitions are found from the key and partition columns alone; their old rows are
    then read with dynamic pruning.  The new rows are complete in the shared folder before
    the table is touched, and Spark swaps whole partitions at the end of the write, so a
    write that fails leaves the old rows readable.  Partitions that lost their last row are
    removed.  Changes without a partition value keep the row where it is."""
    from ..operators.validate import apply_changes

    part, = PARTITION_COLUMNS[name]
    old = load_tables(spark, base, names=[name])[name]
    scratch = Scratch(spark, "changes")
    asked = scratch.table(changes)
    keys = asked.select(key).distinct()
    there = old.select(key, part).join(keys, key, "left_semi").select(part)
    if part in changes.columns:
        there = there.unionAll(asked.select(F.col(part).cast(old.schema[part].dataType)))
    touched = scratch.table(there.where(F.col(part).isNotNull()).groupBy(part).agg(F.count("*").alias("n")))
    snapshot, status = apply_changes(rows_of_touched(old, touched, part), asked, key)
    now, status = scratch.table(snapshot), scratch.table(status)
    path = os.path.join(base, name)
    (now.select(*old.columns).hint("rebalance", part).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path))
    empty = touched.join(now.select(part).distinct(), part, "left_anti")
    for r in empty.toLocalIterator():
        remove(spark, os.path.join(path, f"{part}={r[part]}"))
    spark.catalog.refreshByPath(path)
    scratch.only(status)
    return status


def write_bucketed(spark: SparkSession, classification: DataFrame, post: DataFrame, buckets: int,
                   prefix: str) -> dict[str, DataFrame]:
    """Answers and posts as catalog tables ``<prefix>_classification`` and ``<prefix>_post``,
    dealt to the same number of buckets by post and sorted in them.  Choose ``buckets`` so
    that a bucket of answers is a few hundred megabytes."""
    for name, df, col in (("classification", classification, "postId"), ("post", post, "id")):
        (df.repartition(buckets, col).write.mode("overwrite").format("parquet")
         .bucketBy(buckets, col).sortBy(col).saveAsTable(f"{prefix}_{name}"))
    return {n: spark.table(f"{prefix}_{n}") for n in ("classification", "post")}
