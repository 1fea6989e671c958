"""Registered queries of the consensus / score family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus as C
from ..operators import legacy as L
from ..operators import scores as S
from .registry import register

# Viewers used by the registered per-viewer queries (ids from the mapping).
VIEWER = {"id": 3, "username": "Supplier#000000003", "type": "user"}
INVESTIGATOR_VIEWER = {"id": 1, "username": "Supplier#000000001", "type": "investigator"}

# ---- oracle building blocks: one tally per (post, question), one share per answer ----
TALLY = """
tally AS (
  SELECT postId, questionId, sum(votes) AS answers, max(votes) AS best,
         arg_max(categoryId, votes) AS winner, count(*) FILTER (WHERE votes = peak) AS winners
  FROM (SELECT postId, questionId, categoryId, count(*) AS votes,
               max(count(*)) OVER (PARTITION BY postId, questionId) AS peak
        FROM ann_classification GROUP BY postId, questionId, categoryId)
  GROUP BY postId, questionId),
label AS (
  SELECT tally.postId, tally.questionId, tally.winner, ann_post.studyId
  FROM ann_post
  JOIN tally ON tally.postId = ann_post.id
  JOIN ann_study ON ann_study.id = ann_post.studyId
  WHERE winners = 1 AND answers >= minClassificationsPerPost
    AND best * 100 >= validationAgreementPercent * answers)"""

SHARE = TALLY + """,
share AS (
  SELECT a.userId, a.postId, a.questionId, count(*) AS ticks,
         count(*) FILTER (WHERE a.categoryId = label.winner) AS hits
  FROM ann_classification a LEFT JOIN label USING (postId, questionId) GROUP BY ALL),
board AS (
  SELECT userId, sum(hits * 1.0::DOUBLE / ticks) AS gained, count(*) AS answered FROM share GROUP BY userId)"""


def _seen(v: dict) -> str:
    """Raters that the viewer sees, with the name shown: numbers count the smaller ids seen."""
    if v["type"] == S.INVESTIGATOR:
        return """
seen AS (SELECT id, username AS shown FROM ann_user SEMI JOIN ann_classification a ON a.userId = ann_user.id)"""
    return f"""
circle AS (
  SELECT DISTINCT userId AS id FROM ann_user_study
  WHERE studyId IN (SELECT studyId FROM ann_user_study WHERE userId = {v["id"]})
    AND userId IN (SELECT userId FROM ann_classification)),
seen AS (
  SELECT id, CASE username WHEN '{v["username"]}' THEN username
             ELSE 'Utilizador ' || (SELECT count(*) FROM circle c WHERE c.id <= ann_user.id) END AS shown
  FROM ann_user JOIN circle USING (id))"""


def _stats_general_sql(v: dict) -> str:
    return "WITH " + SHARE.strip() + "," + _seen(v) + """
SELECT shown AS anonymizedUser, round(gained::DECIMAL(18, 6), 2)::DOUBLE AS validated,
       round((answered - gained)::DECIMAL(18, 6), 2)::DOUBLE AS not_validated
FROM seen JOIN board ON board.userId = seen.id"""


def _validated(t):
    return C.validated_labels(t["classification"], t["post"], t["study"])


# ---- registrations -------------------------------------------------------
@register("category_votes", """
SELECT postId, questionId, categoryId, COUNT(*) AS cnt
FROM ann_classification GROUP BY postId, questionId, categoryId""")
def _q_category_votes(t, spark, sf):
    return C.category_votes(t["classification"])


@register("vote_totals", """
SELECT postId, questionId, count(*) AS N FROM ann_classification GROUP BY ALL""")
def _q_vote_totals(t, spark, sf):
    return C.vote_totals(C.category_votes(t["classification"]))


@register("vote_ranking", """
SELECT a.postId, a.questionId, a.categoryId, a.cnt, 1 + count(b.cnt) AS rnk
FROM (SELECT postId, questionId, categoryId, count(*) AS cnt FROM ann_classification GROUP BY ALL) a
LEFT JOIN (SELECT postId, questionId, count(*) AS cnt FROM ann_classification
           GROUP BY postId, questionId, categoryId) b
  ON b.postId = a.postId AND b.questionId = a.questionId AND b.cnt > a.cnt
GROUP BY ALL""")
def _q_vote_ranking(t, spark, sf):
    r = C.vote_ranking(C.category_votes(t["classification"]))
    return r.withColumn("rnk", F.col("rnk").cast("bigint"))


@register("unique_top", "WITH " + TALLY.strip() + """
SELECT postId, questionId, winner AS categoryId, best AS cnt FROM tally WHERE winners = 1""")
def _q_unique_top(t, spark, sf):
    return C.unique_top(C.category_votes(t["classification"]))


@register("study_params", """
SELECT ann_post.id AS postId, minClassificationsPerPost AS minCls, validationAgreementPercent AS agreePct
FROM ann_study, ann_post WHERE ann_study.id = studyId""")
def _q_study_params(t, spark, sf):
    return C.study_params(t["post"], t["study"])


@register("validated_labels", "WITH " + TALLY.strip() + """
SELECT postId, questionId, winner AS topCategoryId FROM label""")
def _q_validated_labels(t, spark, sf):
    return _validated(t)


@register("user_votes", f"""
SELECT username, userId, postId, questionId, categoryId
FROM (SELECT id AS userId, username FROM ann_user WHERE username = '{VIEWER["username"]}')
JOIN ann_classification USING (userId)""")
def _q_user_votes(t, spark, sf):
    return C.user_votes(t["classification"], t["user"], VIEWER["username"])


@register("user_question_totals", """
SELECT userId, postId, questionId, count(*) AS total FROM ann_classification GROUP BY ALL""")
def _q_user_question_totals(t, spark, sf):
    return C.user_question_totals(t["classification"])


@register("user_question_correct", "WITH " + SHARE.strip() + """
SELECT userId, postId, questionId, hits AS correct FROM share WHERE hits > 0""")
def _q_user_question_correct(t, spark, sf):
    return C.user_question_correct(t["classification"], _validated(t))


@register("answer_weights", "WITH " + SHARE.strip() + """
SELECT userId, postId, questionId, ticks AS total, hits AS correct,
       round(hits * 1.0::DOUBLE / ticks, 6) AS weight FROM share""")
def _q_answer_weights(t, spark, sf):
    w = C.answer_weights(t["classification"], _validated(t))
    return w.withColumn("weight", F.round("weight", 6))


@register("stats_user", "WITH " + SHARE.strip() + f"""
SELECT round(coalesce(sum(gained), 0), 6) AS validated,
       round(coalesce(sum(answered - gained), 0), 6) AS not_validated
FROM board WHERE userId = (SELECT id FROM ann_user WHERE username = '{VIEWER["username"]}')""")
def _q_stats_user(t, spark, sf):
    s = C.stats_user(t["classification"], t["user"], t["post"], t["study"], VIEWER["username"])
    return s.select(F.round("validated", 6).alias("validated"), F.round("not_validated", 6).alias("not_validated"))


@register("user_scores", "WITH " + SHARE.strip() + """
SELECT userId, round(gained, 6) AS validated, round(answered - gained, 6) AS not_validated
FROM board""")
def _q_user_scores(t, spark, sf):
    s = S.all_user_scores(t)
    return s.select("userId", F.round("validated", 6).alias("validated"),
                    F.round("not_validated", 6).alias("not_validated"))


@register("visible_users", "WITH " + _seen(VIEWER).strip() + """
SELECT id, username FROM ann_user SEMI JOIN seen USING (id)""")
def _q_visible_users(t, spark, sf):
    return S.visible_users(t["user"], t["classification"], t["user_study"], VIEWER["id"], VIEWER["type"])


@register("anonymized_users", "WITH " + _seen(VIEWER).strip() + """
SELECT id AS userId, shown AS anonymizedUser FROM seen""")
def _q_anonymized_users(t, spark, sf):
    v = VIEWER
    return S.anonymized_users(t["user"], t["classification"], t["user_study"], v["id"], v["username"], v["type"])


@register("stats_general", _stats_general_sql(VIEWER))
def _q_stats_general(t, spark, sf):
    v = VIEWER
    return S.stats_general(t, v["id"], v["username"], v["type"])


@register("stats_general_investigator", _stats_general_sql(INVESTIGATOR_VIEWER))
def _q_stats_general_investigator(t, spark, sf):
    v = INVESTIGATOR_VIEWER
    return S.stats_general(t, v["id"], v["username"], v["type"])


@register("timeline", """
SELECT userId, CAST(createdAt::DATE AS VARCHAR) AS date, count(*) AS count
FROM ann_classification GROUP BY ALL""")
def _q_timeline(t, spark, sf):
    return S.timeline(t["classification"])


# ---- legacy statistics -----------------------------------------------------
LEGACY_LOG_SQL = """
old_log AS (
  SELECT username, studyId, postId, categoryId FROM ann_classification
  JOIN (SELECT id AS questionId, studyId FROM ann_question) USING (questionId)
  JOIN (SELECT id AS userId, username FROM ann_user) USING (userId))"""

#: Shares per rater and post; categories with 3 rows of a post are
#: valid, ``{rule}`` may restrict them.
LEGACY_BOARD = LEGACY_LOG_SQL + """,
old_valid AS (
  SELECT postId, categoryId, true AS good FROM old_log GROUP BY postId, categoryId
  HAVING count(*) > 2 {rule}),
old_board AS (
  SELECT username, sum(part) AS gained, count(*) AS posts
  FROM (SELECT username, postId, avg(CASE WHEN good THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS part
        FROM old_log LEFT JOIN old_valid USING (postId, categoryId) GROUP BY ALL)
  GROUP BY username)"""


def _log(t):
    return L.legacy_log(t["classification"], t["user"], t["question"])


@register("legacy_user_study_counts", "WITH " + LEGACY_LOG_SQL.strip() + """
SELECT username AS userId, studyId, count(*) AS classifiedPostsCount FROM old_log GROUP BY ALL""")
def _q_legacy_user_study_counts(t, spark, sf):
    return L.legacy_user_study_counts(_log(t))


@register("legacy_stats_user", "WITH " + LEGACY_BOARD.format(rule="").strip() + """
SELECT username AS userId, round(gained, 6) AS validated, round(posts - gained, 6) AS not_validated
FROM old_board""")
def _q_legacy_stats_user(t, spark, sf):
    s = L.legacy_stats_user(_log(t))
    return s.select("userId", F.round("validated", 6).alias("validated"),
                    F.round("not_validated", 6).alias("not_validated"))


@register("legacy_stats_all", "WITH " + LEGACY_BOARD.format(
    rule="QUALIFY count(*) = max(count(*)) OVER (PARTITION BY postId)").strip() + f"""
SELECT CASE username WHEN '{VIEWER["username"]}' THEN username
       ELSE 'Utilizador ' || (SELECT count(*) FROM old_board o WHERE o.username <= old_board.username) END
         AS anonymizedUser,
       round(gained::DECIMAL(18, 6), 2)::DOUBLE AS validated,
       round((posts - gained)::DECIMAL(18, 6), 2)::DOUBLE AS not_validated
FROM old_board""")
def _q_legacy_stats_all(t, spark, sf):
    return L.legacy_stats_all(_log(t), VIEWER["username"])


@register("timeline_events", """
SELECT user_id AS userId, CAST(ts::DATE AS VARCHAR) AS date, count(*) AS count FROM events GROUP BY ALL""")
def _q_timeline_events(t, spark, sf):
    from ..sources.tables import read_table
    return S.timeline(read_table(spark, sf, "events"), ts_col="ts", user_col="user_id")


@register("validated_per_study", "WITH " + TALLY.strip() + """
SELECT studyId, count(*) AS validatedLabels FROM label GROUP BY studyId""")
def _q_validated_per_study(t, spark, sf):
    v = _validated(t)
    p = t["post"].select(F.col("id").alias("postId"), "studyId")
    return v.join(p, "postId").groupBy("studyId").agg(F.count(F.lit(1)).alias("validatedLabels"))
