"""Registered queries of the classification-state family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import legacy as L
from ..operators import state as ST
from ..sources.mapping import legacy_bodies, submission_bodies
from .registry import register

# Bodies in SQL: every group (submissionId, userId, postId, questionId) of
# ann_submission is one request body.
BODY_CTE = """
Rows AS (
  SELECT s.*, c.categoryType,
         MAX(s.createdAt) OVER (PARTITION BY s.submissionId, s.userId, s.postId, s.questionId) AS bodyAt
  FROM ann_submission s LEFT JOIN ann_categories c ON c.id = s.categoryId),
Bodies AS (
  SELECT submissionId, userId, postId, questionId, MAX(createdAt) AS createdAt, COUNT(categoryId) AS ncat,
         CASE WHEN postId IS NULL OR postId = 0 OR questionId IS NULL OR questionId = 0
              THEN 'missing_post_or_question'
              WHEN COUNT(categoryId) = 0 THEN 'no_category' END AS reason
  FROM ann_submission GROUP BY submissionId, userId, postId, questionId),
ValidRows AS (
  SELECT r.* FROM Rows r JOIN Bodies b ON b.submissionId = r.submissionId AND b.userId = r.userId
     AND b.postId = r.postId AND b.questionId = r.questionId
  WHERE b.reason IS NULL)"""


def _bodies(t):
    return submission_bodies(t["submission"], t["categories"])


@register("submission_rejects", "WITH " + BODY_CTE.strip() + """
SELECT submissionId, userId, postId, questionId, reason FROM Bodies WHERE reason IS NOT NULL""")
def _q_submission_rejects(t, spark, sf):
    return ST.submission_rejects(_bodies(t))


@register("explode_submissions", "WITH " + BODY_CTE.strip() + """
SELECT submissionId, userId, postId, questionId, categoryId, bodyAt AS createdAt FROM ValidRows""")
def _q_explode_submissions(t, spark, sf):
    return ST.explode_submissions(_bodies(t))


@register("current_classifications", "WITH " + BODY_CTE.strip() + """,
Ranked AS (
  SELECT userId, postId, questionId, categoryId, bodyAt, submissionId,
         RANK() OVER (PARTITION BY userId, postId, questionId ORDER BY bodyAt DESC, submissionId DESC) AS rnk
  FROM ValidRows)
SELECT userId, postId, questionId, categoryId, bodyAt AS createdAt, submissionId FROM Ranked WHERE rnk = 1""")
def _q_current_classifications(t, spark, sf):
    return ST.current_classifications(_bodies(t))


@register("submission_status", "WITH " + BODY_CTE.strip() + """
SELECT submissionId, userId, postId, questionId, createdAt,
       CASE WHEN ROW_NUMBER() OVER (PARTITION BY userId, postId, questionId ORDER BY createdAt, submissionId) > 1
            THEN 'updated' ELSE 'created' END AS status
FROM Bodies WHERE reason IS NULL""")
def _q_submission_status(t, spark, sf):
    return ST.submission_status(_bodies(t))


@register("user_classifications", """
WITH R AS (
  SELECT cl.userId, cl.postId, cl.questionId, cl.categoryId, c.categoryType,
         ROW_NUMBER() OVER (PARTITION BY cl.userId, cl.postId, cl.questionId ORDER BY cl.categoryId) AS rn
  FROM ann_classification cl LEFT JOIN ann_categories c ON cl.categoryId = c.id),
S AS (
  SELECT userId, postId, questionId,
         COALESCE(MAX(CASE WHEN categoryType = 'sentimento' THEN rn END), 1) AS startRn
  FROM R GROUP BY userId, postId, questionId)
SELECT R.userId, R.postId, R.questionId, CAST(R.rn - S.startRn + 1 AS INTEGER) AS pos, R.categoryId
FROM R JOIN S ON S.userId = R.userId AND S.postId = R.postId AND S.questionId = R.questionId
WHERE R.rn >= S.startRn""")
def _q_user_classifications(t, spark, sf):
    lists = ST.user_classification_lists(t["classification"], t["categories"])
    x = lists.select("userId", "postId", "questionId", F.posexplode("categoryIds").alias("pos", "categoryId"))
    return x.select("userId", "postId", "questionId", (F.col("pos") + 1).alias("pos"), "categoryId")


@register("legacy_explode", "WITH " + BODY_CTE.strip() + """,
B AS (
  SELECT r.submissionId, r.userId AS uid, r.postId, r.questionId, q.studyId, u.username, r.categoryType, r.categoryId
  FROM Rows r LEFT JOIN ann_question q ON q.id = r.questionId LEFT JOIN ann_user u ON u.id = r.userId),
OkBodies AS (
  SELECT submissionId, uid, postId, questionId, MIN(CASE WHEN categoryType = 'sentimento' THEN categoryId END) AS firstSent
  FROM B GROUP BY submissionId, uid, postId, questionId
  HAVING SUM(CASE WHEN categoryType = 'tematicas' THEN 1 ELSE 0 END) > 0
     AND postId IS NOT NULL AND postId <> 0 AND MIN(studyId) IS NOT NULL AND MIN(studyId) <> 0
     AND MIN(username) IS NOT NULL AND MIN(username) <> '')
SELECT DISTINCT B.postId, B.studyId, B.categoryId AS post_classification, B.username AS userId
FROM B JOIN OkBodies o ON o.submissionId = B.submissionId AND o.uid = B.uid AND o.postId = B.postId
  AND o.questionId = B.questionId
WHERE B.categoryType = 'tematicas' OR B.categoryId = o.firstSent""")
def _q_legacy_explode(t, spark, sf):
    return ST.legacy_explode(legacy_bodies(_bodies(t), t["question"], t["user"]))


@register("legacy_classified_posts", """
WITH Log AS (
  SELECT c.postId, q.studyId, c.categoryId AS post_classification, u.username AS userId
  FROM ann_classification c JOIN ann_question q ON q.id = c.questionId JOIN ann_user u ON u.id = c.userId),
J AS (SELECT l.userId, l.postId, l.post_classification, c.categoryType
      FROM Log l JOIN ann_categories c ON l.post_classification = c.id),
Sent AS (SELECT userId, postId, MAX(post_classification) AS s FROM J WHERE categoryType = 'sentimento'
         GROUP BY userId, postId)
SELECT userId, postId, 'thematic' AS kind, post_classification AS categoryId FROM J WHERE categoryType = 'tematicas'
UNION ALL
SELECT userId, postId, 'sentiment' AS kind, s AS categoryId FROM Sent""")
def _q_legacy_classified_posts(t, spark, sf):
    log = L.legacy_log(t["classification"], t["user"], t["question"])
    n = ST.legacy_classified_posts(log, t["categories"])
    th = n.select("userId", "postId", F.lit("thematic").alias("kind"), F.explode("thematic").alias("categoryId"))
    se = n.select("userId", "postId", F.lit("sentiment").alias("kind"), F.explode("sentiment").alias("categoryId"))
    return th.unionByName(se)


@register("current_classifications_log", "WITH " + BODY_CTE.strip() + """,
Ranked AS (
  SELECT userId, postId, questionId, categoryId, bodyAt, submissionId,
         RANK() OVER (PARTITION BY userId, postId, questionId ORDER BY bodyAt DESC, submissionId DESC) AS rnk
  FROM ValidRows)
SELECT userId, postId, questionId, categoryId, bodyAt AS createdAt, submissionId FROM Ranked WHERE rnk = 1""")
def _q_current_classifications_log(t, spark, sf):
    """Replace semantics over the stored flat submission log."""
    return ST.current_from_log(t["submission"])
