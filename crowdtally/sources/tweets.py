"""Scraped post JSON: reading with an explicit schema, and a derived test feed.

``read_posts_json`` reads arrays of tweet objects (``multiLine``) or JSON
lines with the same schema.  It parses an array file in one task; large ones are for
``tweet_arrays.read_posts_array``, many files or JSON lines for this call.  Malformed records are kept in ``_corrupt_record``
instead of failing the job.

``tweets_from_documents`` turns the driver's ``documents`` table into tweet
objects (fixed rule, ours): id = doc_id + 1880000000000000000 as a 19-digit
string, page = source, whole text, counters from n_chars, doc_id % 4 image
URLs (key absent when none), user.url absent when doc_id % 5 = 0, username
absent when doc_id % 50 = 7, retweet when doc_id % 7 = 0, reply when
doc_id % 11 = 0, timestamp 2025-01-01 + doc_id % 90 days + doc_id % 24 hours.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import ensure_checkpoint_dir

ID_BASE = 1880000000000000000


def read_posts_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw tweet rows with the ``schemas.TWEET`` schema (no inference)."""
    return (spark.read.schema(schemas.TWEET)
            .option("multiLine", multi_line)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path))


def tweets_from_documents(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    tid = (d + F.lit(ID_BASE)).cast("string")
    ts = (F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
          + F.make_dt_interval(days=(d % 90).cast("int"), hours=(d % 24).cast("int")))
    n_img = (d % 4).cast("int")
    images = F.when(n_img > 0, F.transform(
        F.sequence(F.lit(0), n_img - 1),
        lambda i: F.concat(F.lit("https://img.test/"), d.cast("string"), F.lit("/"), i.cast("string"),
                           F.lit(".jpg"))))
    user = F.struct(
        F.lit(None).cast("string").alias("avatar"), F.col("source").alias("username"),
        F.concat(F.lit("Page "), F.col("source")).alias("userFullName"),
        F.lit(None).cast("string").alias("description"), F.col("lang").alias("location"),
        F.lit(None).cast("string").alias("website"), F.lit("2020-01-01").alias("joinDate"),
        F.lit(False).alias("verified"), F.col("n_chars").alias("totalLikes"), F.lit(0).cast("bigint").alias("totalTweets"),
        F.lit(0).cast("bigint").alias("totalFollowing"), F.lit(0).cast("bigint").alias("totalFollowers"),
        F.when(d % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://x.com/"), F.col("source"))).alias("url"),
        F.col("source").alias("userId"))
    return documents.select(
        tid.alias("id"),
        F.concat(F.lit("https://x.com/"), F.col("source"), F.lit("/status/"), tid).alias("url"),
        F.when(d % 50 == 7, F.lit(None).cast("string")).otherwise(F.col("source")).alias("username"),
        F.concat(F.lit("Page "), F.col("source")).alias("fullname"),
        F.lit(False).alias("verified"), F.lit(False).alias("isPinned"), F.lit(False).alias("isQuote"),
        (d % 7 == 0).alias("isRetweet"), (d % 11 == 0).alias("isReply"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.000'Z'").alias("timestamp"),
        F.col("text"), F.array().cast("array<string>").alias("links"), images.alias("images"),
        F.when(d % 11 == 0, F.array(F.concat(F.lit("@"), F.col("source")))).alias("replyingTo"),
        (F.col("n_chars") % 1000).alias("likes"), (F.col("n_chars") % 97).alias("replies"),
        (F.col("n_chars") % 13).alias("retweets"), (F.col("n_chars") % 5).alias("quotes"),
        user.alias("user"), (d % 4).alias("totalMediaCount"),
    )


def write_json_lines(df: DataFrame, base: str | None = None) -> str:
    """Write ``df`` as JSON lines into a fresh folder (under the checkpoint folder
    by default, which is shared on a cluster); returns the path."""
    root = base or ensure_checkpoint_dir(df.sparkSession)
    path = os.path.join(root, f"tweets-{uuid.uuid4().hex}")
    df.write.mode("error").json(path)
    return path


def tweet_feed(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Tweets derived from ``documents`` as they come back from JSON files, with the
    study each batch is imported into (doc_id % 5)."""
    path = write_json_lines(tweets_from_documents(documents))
    raw = read_posts_json(spark, path, multi_line=False)
    return raw.withColumn("studyId", (F.col("id").cast("bigint") - F.lit(ID_BASE)) % 5)
