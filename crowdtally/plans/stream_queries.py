"""Registered Structured Streaming jobs.

Each query runs its stream to completion (``availableNow``) over files derived
from the driver tables, then returns what the sink holds; the result must
equal the batch form of the same rule.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.mapping import submission_bodies
from ..sources.tables import read_table
from ..sources.tweets import tweets_from_documents, ID_BASE
from ..streaming import jobs as J
from .ingest_queries import TWEETS_CTE
from .registry import ORACLES, register


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register("stream_classifications")
def _q_stream_classifications(t, spark, sf):
    root = _scratch(spark, "stream-cls")
    src, state, ckpt = (os.path.join(root, x) for x in ("source", "state", "checkpoint"))
    bodies = submission_bodies(t["submission"], t["categories"])
    # As many files as the session shuffles to, a quarter of them in each micro-batch:
    # the merge across versions is exercised.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bodies.repartition(parts, "submissionId").write.parquet(src)
    q = J.classification_stream(spark, src, state, ckpt, max_files=max(1, parts // 4))
    q.awaitTermination()
    return J.current_state(spark, state).select(*J.STATE_COLUMNS)


ORACLES["stream_classifications"] = ORACLES["current_classifications"]


@register("stream_timeline", """
SELECT user_id AS userId, CAST(ts::DATE AS VARCHAR) AS date, count(*) AS count FROM events GROUP BY ALL""")
def _q_stream_timeline(t, spark, sf):
    root = _scratch(spark, "stream-timeline")
    events = read_table(spark, sf, "events")
    src = os.path.join(root, "source")
    events.write.parquet(src)
    q = J.timeline_stream(spark, src, os.path.join(root, "sink"), os.path.join(root, "checkpoint"),
                          events.schema, watermark="1 hour")
    q.awaitTermination()
    return J.current_timeline(spark, os.path.join(root, "sink"))


@register("stream_posts", "WITH " + TWEETS_CTE.strip() + """
SELECT localId AS id, username AS pageName, userUrl AS pageLink, url AS postLink, id AS postId,
       text AS details, likes AS likesCount, replies AS commentsCount, retweets AS sharesCount,
       0 AS isRetweet, 'Twitter' AS socialName, studyId
FROM Imported""")
def _q_stream_posts(t, spark, sf):
    root = _scratch(spark, "stream-posts")
    tw = tweets_from_documents(read_table(spark, sf, "documents"))
    tw = tw.withColumn("studyId", (F.col("id").cast("bigint") - F.lit(ID_BASE)) % 5)
    src = os.path.join(root, "source")
    tw.write.json(src)
    q = J.post_stream(spark, src, os.path.join(root, "out"), os.path.join(root, "checkpoint"))
    q.awaitTermination()
    return J.read_epochs(spark, os.path.join(root, "out", "posts")).select(
        "id", "pageName", "pageLink", "postLink", "postId", "details", "likesCount", "commentsCount",
        "sharesCount", "isRetweet", "socialName", "studyId")
