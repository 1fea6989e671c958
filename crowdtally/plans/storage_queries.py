"""Registered queries over stored forms of the tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import consensus as C
from ..operators import progress as P
from ..session import ensure_checkpoint_dir
from ..sources.tables import load_tables, write_bucketed, write_changes, write_tables
from .registry import ORACLES, register
from .validate_queries import CHANGES_SQL, post_changes


def _stored_posts(t, spark):
    base = os.path.join(ensure_checkpoint_dir(spark), f"stored-{uuid.uuid4().hex}")
    write_tables({"post": t["post"]}, base)
    return base


def _changes(spark, sf):
    """The batch of post changes; an insert names the study, other changes don't."""
    c = post_changes(spark, sf)
    return c.withColumn("studyId", F.when(F.col("op") == "insert", F.col("id") % 5))


@register("write_changes", CHANGES_SQL.strip() + """
SELECT id, id % 5 AS studyId, pageName, details, likesCount FROM Steps
WHERE there AND (id, n) IN (SELECT id, max(n) FROM Steps GROUP BY id)""")
def _q_write_changes(t, spark, sf):
    """The stored posts after a batch of changes was written to the touched studies."""
    base = _stored_posts(t, spark)
    write_changes(spark, base, "post", _changes(spark, sf))
    return load_tables(spark, base, names=["post"])["post"].select("id", "studyId", "pageName", "details", "likesCount")


@register("write_changes_status", CHANGES_SQL.strip() + """
SELECT batchOrder, op, id, status FROM Steps WHERE n > 0""")
def _q_write_changes_status(t, spark, sf):
    return write_changes(spark, _stored_posts(t, spark), "post", _changes(spark, sf))


def _bucketed(t, spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return t | write_bucketed(spark, t["classification"], t["post"], n, f"bucketed_{uuid.uuid4().hex}")


@register("validated_labels_bucketed")
def _q_validated_labels_bucketed(t, spark, sf):
    """Labels over the bucketed tables: the answers are read and counted without an exchange."""
    b = _bucketed(t, spark)
    return C.validated_labels(b["classification"], b["post"], b["study"])


@register("post_rater_counts_bucketed")
def _q_post_rater_counts_bucketed(t, spark, sf):
    return P.post_rater_counts(_bucketed(t, spark)["classification"])


ORACLES["validated_labels_bucketed"] = ORACLES["validated_labels"]
ORACLES["post_rater_counts_bucketed"] = ORACLES["post_rater_counts"]
