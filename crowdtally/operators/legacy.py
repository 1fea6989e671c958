"""Legacy ("old") statistics over the single-table answer log.

The legacy log ``postsclassification(postId, studyId, post_classification,
userId)`` has no question and names raters by *username*.  Its rules differ
from the current ones:

* per-user stats: every (post, category) with at least 3 votes is valid (ties
  and several valid categories allowed); weight per *post*;
* all-user stats: valid = at least 3 votes **and** the post's maximal count
  (ties kept); names anonymised by dense rank of the username among all raters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import dense_rank_global
from .scores import ANON_PREFIX, two_places

# Fixed value: minimum votes of a valid legacy category.
LEGACY_MIN_VOTES = 3


def legacy_log(classification: DataFrame, user: DataFrame, question: DataFrame) -> DataFrame:
    """The legacy table, derived from the current one (username as userId)."""
    u = user.select(F.col("id").alias("_uid"), F.col("username").alias("userId"))
    q = question.select(F.col("id").alias("questionId"), "studyId")
    return (classification.join(q, "questionId").join(u, classification["userId"] == u["_uid"])
            .select("postId", "studyId", F.col("categoryId").alias("post_classification"), u["userId"]))


def legacy_user_study_counts(log: DataFrame, username: str | None = None) -> DataFrame:
    """Rows per (user, study)."""
    x = log if username is None else log.filter(F.col("userId") == F.lit(username))
    return x.groupBy("userId", "studyId").agg(F.count(F.lit(1)).alias("classifiedPostsCount"))


def _theme_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("postId", "post_classification").agg(F.count(F.lit(1)).alias("cnt"))


def valid_themes_user_rule(log: DataFrame) -> DataFrame:
    return _theme_counts(log).filter(F.col("cnt") >= LEGACY_MIN_VOTES).select("postId", "post_classification")


def valid_themes_all_rule(log: DataFrame) -> DataFrame:
    """>= 3 votes and equal to the post's maximal count (one window per post on
    pre-aggregated counts, instead of the tuple-IN second scan)."""
    c = _theme_counts(log).withColumn("_max", F.max("cnt").over(Window.partitionBy("postId")))
    return c.filter((F.col("cnt") >= LEGACY_MIN_VOTES) & (F.col("cnt") == F.col("_max"))).select(
        "postId", "post_classification")


def _per_post_scores(log: DataFrame, valid: DataFrame) -> DataFrame:
    """Per (user, post): total rows and rows on a valid category."""
    v = valid.withColumn("_ok", F.lit(1))
    j = log.join(v, ["postId", "post_classification"], "left")
    return j.groupBy("userId", "postId").agg(
        F.count(F.lit(1)).alias("total"), F.count("_ok").alias("correct"))


def legacy_scores(log: DataFrame, valid: DataFrame) -> DataFrame:
    """(userId, validated, not_validated) unrounded, for every rater."""
    p = _per_post_scores(log, valid)
    w = F.col("correct").cast("double") / F.col("total")
    return (p.groupBy("userId").agg(F.sum(w).alias("validated"), F.count(F.lit(1)).alias("_n"))
            .select("userId", "validated", (F.col("_n") - F.col("validated")).alias("not_validated")))


def legacy_stats_user(log: DataFrame) -> DataFrame:
    """Per-user legacy stats (>= 3 votes rule), all users at once."""
    return legacy_scores(log, valid_themes_user_rule(log))


def legacy_stats_all(log: DataFrame, viewer_username: str) -> DataFrame:
    """anonymizedUser, validated, not_validated (rounded to 2) under the max rule."""
    scores = legacy_scores(log, valid_themes_all_rule(log))
    users = dense_rank_global(log.select("userId").distinct(), "userId", "rnk")
    name = (F.when(F.col("userId") == F.lit(viewer_username), F.col("userId"))
            .otherwise(F.concat(F.lit(ANON_PREFIX), F.col("rnk").cast("string"))))
    return users.join(scores, "userId", "left").select(
        name.alias("anonymizedUser"),
        two_places(F.coalesce("validated", F.lit(0.0))).alias("validated"),
        two_places(F.coalesce("not_validated", F.lit(0.0))).alias("not_validated"))
