"""Consensus labels and rater scores, for all posts, questions and users at once.

Rules:

* A (post, question) has a *validated* label when its most-voted category is
  unique (a tie for first place never validates), the total number of answer
  rows N reaches the study's ``minClassificationsPerPost`` and the top count is
  at least ``validationAgreementPercent`` % of N.  N counts rows, so a rater
  who ticks two categories counts twice.  Null limits never validate.
* A rater's weight on a (post, question) is the share of their rows there that
  equal the validated label (0 when there is none).  ``validated`` is the sum
  of weights, ``not_validated`` the number of answered (post, question) pairs
  minus that sum.

Plan shape: answer rows are reduced to (post, question, category) counts with
map-side partial aggregation, then to one row per (post, question) holding the
ranked category counts (a list bounded by the question's categories), so the
top-and-tie test is one pass instead of the rank/self-join of the SQL form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PQ = ["postId", "questionId"]


def category_votes(classification: DataFrame) -> DataFrame:
    """Rows per (post, question, category) -> cnt."""
    return classification.groupBy("postId", "questionId", "categoryId").agg(F.count(F.lit(1)).alias("cnt"))


def vote_totals(votes: DataFrame) -> DataFrame:
    """N = answer rows per (post, question)."""
    return votes.groupBy(*PQ).agg(F.sum("cnt").alias("N"))


def vote_ranking(votes: DataFrame) -> DataFrame:
    """SQL ``RANK() OVER (PARTITION BY post, question ORDER BY cnt DESC)``."""
    w = Window.partitionBy(*PQ).orderBy(F.col("cnt").desc())
    return votes.withColumn("rnk", F.rank().over(w))


def consensus(votes: DataFrame) -> DataFrame:
    """One row per (post, question): N, top category, its count and whether
    first place is tied."""
    ranked = (votes.groupBy(*PQ)
              .agg(F.sum("cnt").alias("N"),
                   F.sort_array(F.collect_list(F.struct("cnt", "categoryId")), asc=False).alias("_r")))
    first, second = F.col("_r")[0], F.get(F.col("_r"), 1)
    return ranked.select(
        *PQ, "N",
        first["categoryId"].alias("topCategoryId"), first["cnt"].alias("topCnt"),
        F.coalesce(second["cnt"] == first["cnt"], F.lit(False)).alias("tied"),
    )


def unique_top(votes: DataFrame) -> DataFrame:
    """Top category of each (post, question) whose first place is not tied."""
    c = consensus(votes)
    return c.filter(~F.col("tied")).select(*PQ, F.col("topCategoryId").alias("categoryId"),
                                           F.col("topCnt").alias("cnt"))


def study_params(post: DataFrame, study: DataFrame) -> DataFrame:
    """postId -> the thresholds of its study (study is a dimension table)."""
    s = study.select(F.col("id").alias("studyId"), F.col("minClassificationsPerPost").alias("minCls"),
                     F.col("validationAgreementPercent").alias("agreePct"))
    return post.select(F.col("id").alias("postId"), "studyId").join(s, "studyId").select("postId", "minCls", "agreePct")


def agreement_reached(cnt: Column, n: Column, min_cls: Column, pct: Column) -> Column:
    """``N >= min AND cnt*100/N >= pct`` as an exact integer test; null limits -> null."""
    return (n >= min_cls) & (cnt * 100 >= pct * n)


def validated_labels(classification: DataFrame, post: DataFrame, study: DataFrame,
                     votes: DataFrame | None = None) -> DataFrame:
    """(postId, questionId, topCategoryId) of every validated (post, question)."""
    c = consensus(votes if votes is not None else category_votes(classification))
    sp = study_params(post, study)
    j = c.filter(~F.col("tied")).join(sp, "postId")
    return (j.filter(agreement_reached(F.col("topCnt"), F.col("N"), F.col("minCls"), F.col("agreePct")))
            .select(*PQ, "topCategoryId"))


def answer_weights(classification: DataFrame, validated: DataFrame) -> DataFrame:
    """Per (user, post, question): total rows, rows equal to the validated
    label, and weight = correct / total.

    The answer rows are first reduced per (user, post, question) - a group
    bounded by the question's categories - and only then joined on
    (post, question).  A post answered by a huge crowd is then one skewed
    join key whose big side AQE can split, because the following aggregate
    re-shuffles by user anyway.
    """
    per_answer = (classification.groupBy("userId", *PQ)
                  .agg(F.count(F.lit(1)).alias("total"), F.collect_list("categoryId").alias("_cats")))
    j = per_answer.join(validated, PQ, "left")
    correct = F.when(F.col("topCategoryId").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("_cats", lambda x: x == F.col("topCategoryId"))))
    return j.select("userId", *PQ, "total", correct.cast("bigint").alias("correct"),
                    (correct.cast("double") / F.col("total")).alias("weight"))


def user_question_totals(classification: DataFrame) -> DataFrame:
    return classification.groupBy("userId", *PQ).agg(F.count(F.lit(1)).alias("total"))


def user_question_correct(classification: DataFrame, validated: DataFrame) -> DataFrame:
    """Rows that equal the validated label, per (user, post, question) with at least one."""
    v = validated.withColumnRenamed("topCategoryId", "categoryId")
    return (classification.join(v, PQ + ["categoryId"])
            .groupBy("userId", *PQ).agg(F.count(F.lit(1)).alias("correct")))


def user_scores(weights: DataFrame) -> DataFrame:
    """validated = sum of weights, not_validated = answered pairs - validated (unrounded)."""
    return (weights.groupBy("userId")
            .agg(F.sum("weight").alias("validated"), F.count(F.lit(1)).alias("_n"))
            .select("userId", "validated", (F.col("_n") - F.col("validated")).alias("not_validated")))


def user_votes(classification: DataFrame, user: DataFrame, username: str | None = None) -> DataFrame:
    """Answer rows with the rater's username; optionally one user's rows only."""
    u = user.select(F.col("id").alias("userId"), "username")
    if username is not None:
        u = u.filter(F.col("username") == F.lit(username))
    return classification.join(u, "userId").select("username", "userId", *PQ, "categoryId")


def stats_user(classification: DataFrame, user: DataFrame, post: DataFrame, study: DataFrame,
               username: str) -> DataFrame:
    """One row (validated, not_validated) for one username; 0, 0 when it has no rows.
    Votes are counted for the (post, question) pairs of this user only."""
    mine = user_votes(classification, user, username).select("userId", *PQ, "categoryId")
    theirs = classification.join(mine.select(*PQ).distinct(), PQ, "left_semi")
    validated = validated_labels(theirs, post, study)
    validated_sum = F.coalesce(F.sum("weight"), F.lit(0.0))
    # A global aggregate always yields exactly one row, as the SQL form does.
    return answer_weights(mine, validated).agg(
        validated_sum.alias("validated"), (F.count(F.lit(1)) - validated_sum).alias("not_validated"))
