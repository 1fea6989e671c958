"""Post import from scraped tweets (import route and scripts).

Field mapping (fixed): url -> postLink, user.url -> pageLink (null-safe),
username -> pageName, id -> postId, text -> details, likes / replies /
retweets -> likes / comments / sharesCount, socialName 'Twitter'.  The API
import stores isRetweet = 0; the script import takes the tweet's flag.  A
tweet fails when its JSON is malformed or id, url or username is missing; the
batch outcome is an error only when every tweet failed; failed tweets are rows of
``import_rejects`` with their reason.  A post's local id is a 60-bit hash of
(studyId, postId, postLink): the same in any batch or stream, and no row has to
move for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOCIAL_NAME = "Twitter"
CREATED, ERROR = "created", "error"


def reject_reason() -> F.Column:
    """Why a tweet cannot be imported; null if it can."""
    return (F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed"))
            .when(F.col("id").isNull(), F.lit("missing_id"))
            .when(F.col("url").isNull(), F.lit("missing_url"))
            .when(F.col("username").isNull(), F.lit("missing_username")))


def tweet_valid(raw: DataFrame) -> F.Column:
    return reject_reason().isNull()


def import_rejects(raw: DataFrame) -> DataFrame:
    """Tweets that are not imported, with the reason and the malformed record."""
    return raw.withColumn("reason", reject_reason()).filter(F.col("reason").isNotNull()).select(
        F.col("id").alias("postId"), F.col("url").alias("postLink"), F.col("username").alias("pageName"),
        "studyId", "reason", F.col("_corrupt_record").alias("record"))


def local_id(study: F.Column, post: F.Column, link: F.Column) -> F.Column:
    digest = F.md5(F.concat_ws(":", study.cast("string"), post, link))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def import_rows(raw: DataFrame, study_id: int | None = None, keep_retweet_flag: bool = False) -> DataFrame:
    """Valid tweets as post rows without the local id.  ``study_id`` overrides a
    ``studyId`` column of ``raw``."""
    study = F.lit(study_id).cast("bigint") if study_id is not None else F.col("studyId")
    retweet = F.coalesce(F.col("isRetweet").cast("int"), F.lit(0)) if keep_retweet_flag else F.lit(0)
    return raw.filter(tweet_valid(raw)).select(
        F.col("username").alias("pageName"), F.col("user.url").alias("pageLink"), F.col("url").alias("postLink"),
        F.col("id").alias("postId"), F.col("text").alias("details"), F.col("likes").alias("likesCount"),
        F.col("replies").alias("commentsCount"), F.col("retweets").alias("sharesCount"),
        retweet.alias("isRetweet"), F.lit(SOCIAL_NAME).alias("socialName"), study.alias("studyId"),
        F.col("images"))


def import_posts(raw: DataFrame, study_id: int | None = None, keep_retweet_flag: bool = False) -> DataFrame:
    """Post rows with local ids (images kept for ``post_images``)."""
    rows = import_rows(raw, study_id, keep_retweet_flag)
    return rows.select(local_id(F.col("studyId"), F.col("postId"), F.col("postLink")).alias("id"), *rows.columns)


def post_images(posts: DataFrame) -> DataFrame:
    """Image manifest: one row per image URL, the first one is the front page."""
    x = posts.select(F.col("id").alias("postId"), F.posexplode("images").alias("pos", "url"))
    return x.select("postId", "pos", "url", (F.col("pos") == 0).cast("int").alias("isFrontPage"))


def import_summary(raw: DataFrame, study_col: str = "studyId") -> DataFrame:
    """Per batch: inserted and failed counts, outcome and message."""
    ok = tweet_valid(raw)
    s = raw.groupBy(study_col).agg(F.count_if(ok).alias("inserted"), F.count_if(~ok).alias("failed"))
    outcome = F.when((F.col("failed") > 0) & (F.col("inserted") == 0), F.lit(ERROR)).otherwise(F.lit(CREATED))
    # Fixed value: the reference's success message, with the count.
    msg = F.when(outcome == CREATED, F.concat(F.lit("Importação concluída. "), F.col("inserted").cast("string"),
                                              F.lit(" publicações inseridas.")))
    return s.select(study_col, "inserted", "failed", outcome.alias("outcome"), msg.alias("message"))


def match_images_by_link(raw: DataFrame, posts: DataFrame) -> DataFrame:
    """Per tweet: the existing post with the same link (smallest id when several)
    and a status 'not_found', 'no_images' or 'matched'."""
    first = posts.groupBy("postLink").agg(F.min("id").alias("postId"))
    j = raw.select(F.col("url").alias("postLink"), "images").join(first, "postLink", "left")
    n = F.coalesce(F.size("images"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    status = (F.when(F.col("postId").isNull(), F.lit("not_found"))
              .when(n == 0, F.lit("no_images")).otherwise(F.lit("matched")))
    return j.select("postLink", "postId", status.alias("status"), n.cast("bigint").alias("nImages"))


def matched_image_rows(raw: DataFrame, posts: DataFrame) -> DataFrame:
    """Image rows (postId, pos, url, isFrontPage) for tweets whose link matched."""
    first = posts.groupBy("postLink").agg(F.min("id").alias("postId"))
    j = raw.select(F.col("url").alias("postLink"), "images").join(first, "postLink")
    x = j.select("postId", F.posexplode("images").alias("pos", "url"))
    return x.select("postId", "pos", "url", (F.col("pos") == 0).cast("int").alias("isFrontPage"))


def page_post_counts(raw: DataFrame, start: str = "2025-01-15", end: str = "2025-03-10") -> DataFrame:
    """Posts per page whose (UTC) date lies in [start, end]."""
    day = F.to_date(F.substring("timestamp", 1, 10), "yyyy-MM-dd")
    return (raw.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
            .groupBy(F.col("username").alias("page")).agg(F.count(F.lit(1)).alias("posts")))
