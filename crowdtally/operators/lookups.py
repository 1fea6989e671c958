"""Projections, filters and lookups over the study tables (the reference's read routes).

Owner filters take the investigator's username (studies store ``addedBy`` as a
username).  Outer joins followed by a null-rejecting owner filter are written
as in the reference; Catalyst turns them into inner joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feed import images_of

USER_PUBLIC_COLUMNS = ["id", "username", "email", "type", "createdAt", "updatedAt", "createdBy", "updatedBy"]


def users_public(user: DataFrame, user_id: int | None = None) -> DataFrame:
    """Users without the password column; all or one."""
    cols = [c for c in USER_PUBLIC_COLUMNS if c in user.columns]
    u = user.select(*cols)
    return u if user_id is None else u.filter(F.col("id") == F.lit(user_id))


def post_by_id(post: DataFrame, post_id: int) -> DataFrame:
    return post.filter(F.col("id") == F.lit(post_id))


def studies_by_owner(study: DataFrame, owner: str | None = None) -> DataFrame:
    """Studies of an investigator (all studies in the legacy form), newest first."""
    s = study if owner is None else study.filter(F.col("addedBy") == F.lit(owner))
    return s.orderBy(F.col("createdAt").desc(), F.col("id"))


def studies_of_user(user_study: DataFrame, study: DataFrame, user_id: int | None = None) -> DataFrame:
    """Membership joined with the study, newest first; all users, unordered, when no id."""
    us = user_study if user_id is None else user_study.filter(F.col("userId") == F.lit(user_id))
    s = study.select(F.col("id").alias("studyId"), "name", "obs", "createdAt")
    rows = us.join(s, "studyId").select("userId", F.col("studyId").alias("id"), "name", "obs", "createdAt")
    return rows if user_id is None else rows.orderBy(F.col("createdAt").desc(), "id")


def questions_of_study(question: DataFrame, study: DataFrame, study_id: int | None = None) -> DataFrame:
    """Questions with their study name (left join), newest first."""
    q = question if study_id is None else question.filter(F.col("studyId") == F.lit(study_id))
    s = study.select(F.col("id").alias("studyId"), F.col("name").alias("studyName"))
    return _newest_questions(q.join(s, "studyId", "left"))


def _newest_questions(q: DataFrame) -> DataFrame:
    """Questions are a dimension table: a few rows per study, sorted for display."""
    return q.select("id", "question", *[c for c in ("content", "inputType") if c in q.columns], "studyId",
                    "studyName", "createdAt").orderBy(F.col("createdAt").desc(), "id")


def questions_by_owner(question: DataFrame, study: DataFrame, owner: str) -> DataFrame:
    s = study.filter(F.col("addedBy") == F.lit(owner)).select(F.col("id").alias("studyId"),
                                                              F.col("name").alias("studyName"))
    return _newest_questions(question.join(s, "studyId"))


def categories_by_owner(categories: DataFrame, question: DataFrame, study: DataFrame,
                        owner: str | None = None) -> DataFrame:
    """Categories with their question text, of one owner (all in the legacy form),
    ordered by type and name."""
    q = question.select(F.col("id").alias("questionId"), F.col("question").alias("questionName"), "studyId")
    s = study.select(F.col("id").alias("studyId"), "addedBy")
    j = categories.join(q, "questionId", "left").join(s, "studyId", "left")
    if owner is not None:
        j = j.filter(F.col("addedBy") == F.lit(owner))
    return j.select(*categories.columns, "questionName").orderBy("categoryType", "name", "id")


def category_types(categories: DataFrame, question: DataFrame | None = None, study: DataFrame | None = None,
                   owner: str | None = None) -> DataFrame:
    """Distinct non-empty category types, all or of one owner, ordered."""
    c = categories
    if owner is not None:
        q = question.select(F.col("id").alias("questionId"), "studyId")
        s = study.filter(F.col("addedBy") == F.lit(owner)).select(F.col("id").alias("studyId"))
        c = c.join(q, "questionId").join(s, "studyId")
    return (c.filter(F.col("categoryType").isNotNull() & (F.col("categoryType") != ""))
            .select("categoryType").distinct().orderBy("categoryType"))


def posts_by_owner(post: DataFrame, study: DataFrame, image: DataFrame, owner: str) -> DataFrame:
    """Posts of an owner's studies with images (base64, null images skipped) as an array
    per post.  Post ids are unique, so a semi join gives each post once; only the images
    of these posts are encoded and moved."""
    s = study.filter(F.col("addedBy") == F.lit(owner)).select(F.col("id").alias("studyId"))
    p = (post.join(s, "studyId", "left_semi")
         .select("id", "pageName", F.coalesce("details", F.lit("")).alias("details"),
                 "likesCount", "commentsCount", "sharesCount", "studyId"))
    imgs = images_of(image.filter(F.col("image_data").isNotNull()), p.select(F.col("id").alias("postId")))
    return (p.join(imgs, p["id"] == imgs["postId"], "left").drop("postId")
            .withColumn("images", F.coalesce("images", F.array())))


def study_category_links(categories: DataFrame, question: DataFrame) -> DataFrame:
    """The legacy study-category link table (studyId, categoryId)."""
    q = question.select(F.col("id").alias("questionId"), "studyId")
    return categories.join(q, "questionId").select("studyId", F.col("id").alias("categoryId"))


def study_categories_by_type(categories: DataFrame, links: DataFrame, study_id: int, category_type: str) -> DataFrame:
    """Legacy: (id, name) of a study's linked categories of one type."""
    l = links.filter(F.col("studyId") == F.lit(study_id)).select(F.col("categoryId").alias("id"))
    return (categories.filter(F.col("categoryType") == F.lit(category_type)).join(l, "id")
            .select("id", "name"))


def available_categories(categories: DataFrame, links: DataFrame, study_id: int) -> DataFrame:
    """Legacy ``NOT IN``: categories not linked to the study, ordered by type and
    name.  As in SQL, a null in the linked ids empties the result."""
    linked = links.filter(F.col("studyId") == F.lit(study_id)).select(F.col("categoryId").alias("id"))
    has_null = linked.filter(F.col("id").isNull())
    out = (categories.filter(F.col("id").isNotNull())
           .join(linked.filter(F.col("id").isNotNull()), "id", "left_anti")
           .filter(~has_null.exists()))
    return out.orderBy("categoryType", "name", "id")
