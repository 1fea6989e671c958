"""Registered queries of the lookup family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as LK
from .registry import register

OWNER = "Supplier#000000000"
POST_ID = 7
USER_ID = 4
STUDY_ID = 1


@register("users_public", """
SELECT id, username, email, type FROM ann_user""")
def _q_users_public(t, spark, sf):
    return LK.users_public(t["user"])


@register("user_by_id", f"""
SELECT id, username, email, type FROM ann_user WHERE id = {USER_ID}""")
def _q_user_by_id(t, spark, sf):
    return LK.users_public(t["user"], USER_ID)


@register("post_by_id", f"""
SELECT * FROM ann_post WHERE id = {POST_ID}""")
def _q_post_by_id(t, spark, sf):
    return LK.post_by_id(t["post"], POST_ID)


@register("studies_by_owner", f"""
SELECT id, name, obs, addedBy, createdAt, minClassificationsPerPost, maxClassificationsPerUser,
       validationAgreementPercent
FROM ann_study WHERE addedBy = '{OWNER}' ORDER BY createdAt DESC""")
def _q_studies_by_owner(t, spark, sf):
    return LK.studies_by_owner(t["study"], OWNER)


@register("studies_all", """
SELECT id, name, obs, addedBy, createdAt, minClassificationsPerPost, maxClassificationsPerUser,
       validationAgreementPercent
FROM ann_study ORDER BY createdAt DESC""")
def _q_studies_all(t, spark, sf):
    return LK.studies_by_owner(t["study"])


@register("studies_of_user", """
SELECT us.userId, s.id, s.name, s.obs, s.createdAt
FROM ann_study s INNER JOIN ann_user_study us ON s.id = us.studyId
ORDER BY us.userId, s.createdAt DESC""")
def _q_studies_of_user(t, spark, sf):
    return LK.studies_of_user(t["user_study"], t["study"])


@register("questions_of_study", f"""
SELECT q.id, q.question, q.inputType, q.studyId, s.name AS studyName, q.createdAt
FROM ann_question q LEFT JOIN ann_study s ON s.id = q.studyId
WHERE q.studyId = {STUDY_ID}""")
def _q_questions_of_study(t, spark, sf):
    return LK.questions_of_study(t["question"].drop("j"), t["study"], STUDY_ID)


@register("questions_by_owner", f"""
SELECT q.id, q.question, q.inputType, q.studyId, s.name AS studyName, q.createdAt
FROM ann_question q JOIN ann_study s ON s.id = q.studyId
WHERE s.addedBy = '{OWNER}'""")
def _q_questions_by_owner(t, spark, sf):
    return LK.questions_by_owner(t["question"].drop("j"), t["study"], OWNER)


@register("categories_by_owner", f"""
WITH owned AS (
  SELECT id AS questionId, any_value(question) AS questionName FROM ann_question
  WHERE studyId IN (SELECT id FROM ann_study WHERE addedBy = '{OWNER}') GROUP BY id)
SELECT id, name, categoryType, questionId, questionName FROM ann_categories JOIN owned USING (questionId)""")
def _q_categories_by_owner(t, spark, sf):
    return LK.categories_by_owner(t["categories"], t["question"], t["study"], OWNER)


@register("categories_all", """
SELECT c.*, q.question AS questionName
FROM ann_categories c LEFT JOIN ann_question q ON c.questionId = q.id""")
def _q_categories_all(t, spark, sf):
    return LK.categories_by_owner(t["categories"], t["question"], t["study"])


@register("category_types", """
SELECT DISTINCT categoryType FROM ann_categories
WHERE categoryType IS NOT NULL AND categoryType <> '' ORDER BY categoryType""")
def _q_category_types(t, spark, sf):
    return LK.category_types(t["categories"])


@register("category_types_by_owner", f"""
SELECT categoryType FROM ann_categories
WHERE questionId IN (SELECT id FROM ann_question
                     WHERE studyId IN (SELECT id FROM ann_study WHERE addedBy = '{OWNER}'))
GROUP BY categoryType HAVING length(categoryType) > 0""")
def _q_category_types_by_owner(t, spark, sf):
    return LK.category_types(t["categories"], t["question"], t["study"], OWNER)


@register("posts_by_owner", f"""
WITH shown AS (
  SELECT postId, imageId, to_base64(image_data) AS image_data, isFrontPage
  FROM ann_image WHERE octet_length(image_data) IS NOT NULL)
SELECT id, pageName, CASE WHEN details IS NULL THEN '' ELSE details END AS details, likesCount, commentsCount,
       sharesCount, studyId, imageId, image_data, isFrontPage
FROM ann_post LEFT JOIN shown ON shown.postId = ann_post.id
WHERE studyId IN (SELECT id FROM ann_study WHERE addedBy = '{OWNER}')""")
def _q_posts_by_owner(t, spark, sf):
    p = LK.posts_by_owner(t["post"], t["study"], t["image"], OWNER)
    x = p.select("id", "pageName", "details", "likesCount", "commentsCount", "sharesCount", "studyId",
                 F.explode_outer("images").alias("img"))
    return x.select("id", "pageName", "details", "likesCount", "commentsCount", "sharesCount", "studyId",
                    F.col("img.imageId").alias("imageId"), F.col("img.image_data").alias("image_data"),
                    F.col("img.isFrontPage").alias("isFrontPage"))


LINKS_SQL = """
StudiesCategories AS (
  SELECT q.studyId, c.id AS categoryId FROM ann_categories c JOIN ann_question q ON q.id = c.questionId)"""


def _links(t):
    return LK.study_category_links(t["categories"], t["question"])


@register("study_categories_by_type", "WITH " + LINKS_SQL.strip() + f"""
SELECT c.id, c.name, c.categoryType FROM ann_categories c
JOIN StudiesCategories sc ON c.id = sc.categoryId
WHERE sc.studyId = {STUDY_ID} AND c.categoryType IN ('tematicas', 'sentimento')""")
def _q_study_categories_by_type(t, spark, sf):
    th = LK.study_categories_by_type(t["categories"], _links(t), STUDY_ID, "tematicas")
    se = LK.study_categories_by_type(t["categories"], _links(t), STUDY_ID, "sentimento")
    return (th.withColumn("categoryType", F.lit("tematicas"))
            .unionByName(se.withColumn("categoryType", F.lit("sentimento"))))


@register("available_categories", "WITH " + LINKS_SQL.strip() + f"""
SELECT c.* FROM ann_categories c
WHERE c.id NOT IN (SELECT categoryId FROM StudiesCategories WHERE studyId = {STUDY_ID})
ORDER BY c.categoryType, c.name""")
def _q_available_categories(t, spark, sf):
    return LK.available_categories(t["categories"], _links(t), STUDY_ID)
