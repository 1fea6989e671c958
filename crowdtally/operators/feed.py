"""Feed assembly: request resolution, status, nested payload.

The pieces of a response are joins and bounded ``collect_list``s
(images of one post, categories of one question, questions of one study).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import progress as P

NO_STUDIES, FORBIDDEN, LIMIT_REACHED = "no_studies", "forbidden", "limit_reached"
NONE_AVAILABLE, NO_HISTORY, OK = "none_available", "no_history", "ok"


def base64_clean(col) -> F.Column:
    """base64 without the line breaks Spark inserts into long output; null stays null."""
    return F.regexp_replace(F.base64(col), "[\r\n]", "")


def post_images_base64(image: DataFrame) -> DataFrame:
    """postId -> images: array<struct<imageId, image_data (base64 or null), isFrontPage>>."""
    item = F.struct("imageId", base64_clean(F.col("image_data")).alias("image_data"), "isFrontPage")
    return image.groupBy("postId").agg(F.sort_array(F.collect_list(item)).alias("images"))


def images_of(image: DataFrame, posts: DataFrame) -> DataFrame:
    """Encoded images of the posts (``postId``) only: the cut comes before the encoding."""
    return post_images_base64(image.join(posts.select("postId").distinct(), "postId", "left_semi"))


def study_questionnaire(question: DataFrame, categories: DataFrame) -> DataFrame:
    """studyId -> questions: array<struct<id, question, inputType, categories[]>>, each
    question's categories ordered by id (empty array when it has none)."""
    cat = F.struct(F.col("c_id").alias("id"), "name", "categoryType", "questionId")
    c = categories.select(F.col("id").alias("c_id"), "name", "categoryType", "questionId")
    qc = (question.select(F.col("id").alias("questionId"), "studyId", "question", "inputType")
          .join(c, "questionId", "left")
          .groupBy("studyId", "questionId", "question", "inputType")
          .agg(F.sort_array(F.collect_list(F.when(F.col("c_id").isNotNull(), cat))).alias("categories")))
    qs = F.struct(F.col("questionId").alias("id"), "question", "inputType", "categories")
    return qc.groupBy("studyId").agg(F.sort_array(F.collect_list(qs)).alias("questions"))


def feed_status(resolved: DataFrame, quota: DataFrame, served: DataFrame, hist: DataFrame) -> DataFrame:
    """Per request: status and number of posts served.

    resolved: resolve_requests output; quota: user_quota on the targets;
    served: next_posts output; hist: history rows (userId, studyId, postId) of the
    requests in history mode at least.
    """
    n_served = served.groupBy("userId").agg(F.count(F.lit(1)).alias("_served"))
    n_hist = (hist.join(resolved.select("userId", F.col("targetStudyId").alias("studyId")), ["userId", "studyId"],
                        "left_semi").groupBy("userId").agg(F.count(F.lit(1)).alias("_hist")))
    q = quota.select("userId", F.col("studyId").alias("targetStudyId"), "limitReached")
    j = (resolved.join(q, ["userId", "targetStudyId"], "left").join(n_served, "userId", "left")
         .join(n_hist, "userId", "left"))
    hist_n, served_n = F.coalesce("_hist", F.lit(0)), F.coalesce("_served", F.lit(0))
    status = (F.when(F.col("refusal").isNotNull(), F.col("refusal"))
              .when(F.col("includeClassified"), F.when(hist_n > 0, F.lit(OK)).otherwise(F.lit(NO_HISTORY)))
              .when(F.col("limitReached"), F.lit(LIMIT_REACHED))
              .when(served_n == 0, F.lit(NONE_AVAILABLE)).otherwise(F.lit(OK)))
    n_posts = (F.when(F.col("refusal").isNotNull(), F.lit(0))
               .when(F.col("includeClassified"), hist_n).otherwise(served_n))
    return j.select("userId", "targetStudyId", status.alias("status"), n_posts.cast("bigint").alias("nPosts"))


def history_targets(resolved: DataFrame) -> DataFrame:
    """(userId, studyId) of the accepted requests in history mode."""
    return resolved.filter(F.col("refusal").isNull() & F.col("includeClassified")).select(
        "userId", F.col("targetStudyId").alias("studyId"))


def feed_targets(resolved: DataFrame, quota: DataFrame) -> DataFrame:
    """(userId, studyId, quota) for accepted, non-history requests."""
    ok = resolved.filter(F.col("refusal").isNull() & ~F.col("includeClassified"))
    return (ok.select("userId", F.col("targetStudyId").alias("studyId"))
            .join(quota.select("userId", "studyId", "quota"), ["userId", "studyId"]))


def feed_payload(served: DataFrame, post: DataFrame, study: DataFrame, image: DataFrame,
                 question: DataFrame, categories: DataFrame) -> DataFrame:
    """Served posts with the 13 fields of the response, nested images and questions."""
    p = post.select(F.col("id").alias("postId"), "pageName", "pageLink", "postLink", "details", "likesCount",
                    "commentsCount", "sharesCount", "socialName")
    s = study.select(F.col("id").alias("studyId"), F.col("name").alias("studyName"))
    imgs = images_of(image, served)
    qs = study_questionnaire(question, categories)
    j = (served.join(p, "postId").join(s, "studyId").join(imgs, "postId", "left").join(qs, "studyId", "left"))
    return j.select(
        "userId", "feedRank", F.col("postId").alias("id"), "pageName", "pageLink", "postLink", "details",
        "likesCount", "commentsCount", "sharesCount", "studyId", "studyName", "socialName",
        F.coalesce("images", F.array()).alias("images"), F.coalesce("questions", F.array()).alias("questions"))


def history_payload(resolved: DataFrame, hist: DataFrame, post: DataFrame, study: DataFrame, image: DataFrame,
                    question: DataFrame, categories: DataFrame) -> DataFrame:
    """History-mode answer: every post the user answered in the target study with
    its latest answer time (newest first is the presentation order), the same
    fields and nested images and questions as the feed."""
    targets = history_targets(resolved)
    h = hist.join(targets, ["userId", "studyId"], "left_semi").select("userId", "studyId", "postId", "createdAtMax")
    p = post.select(F.col("id").alias("postId"), "pageName", "pageLink", "postLink", "details", "likesCount",
                    "commentsCount", "sharesCount", "socialName")
    s = study.select(F.col("id").alias("studyId"), F.col("name").alias("studyName"))
    # One payload per post, then its raters: blobs are put together once per post.
    posts = (p.join(h.select("postId", "studyId").distinct(), "postId").join(s, "studyId")
             .join(images_of(image, h), "postId", "left")
             .join(study_questionnaire(question, categories), "studyId", "left"))
    j = h.select("userId", "createdAtMax", "postId").join(posts, "postId")
    return j.select(
        "userId", "createdAtMax", F.col("postId").alias("id"), "pageName", "pageLink", "postLink", "details",
        "likesCount", "commentsCount", "sharesCount", "studyId", "studyName", "socialName",
        F.coalesce("images", F.array()).alias("images"), F.coalesce("questions", F.array()).alias("questions"))


def legacy_posts_page(post: DataFrame, image: DataFrame, memberships: DataFrame, viewer: str, page: int = 1, limit: int = 10,
                      seed: str = P.DEFAULT_SEED) -> DataFrame:
    """Legacy paged listing: posts of the viewer's studies in random (hashed)
    order, ``LIMIT limit OFFSET (page-1)*limit``, with images and the total count.

    memberships: (user_name, study_id) of the legacy membership table.
    """
    mine = memberships.filter(F.col("user_name") == F.lit(viewer)).select(F.col("study_id").alias("studyId"))
    posts = post.join(mine, "studyId", "left_semi")
    # The total is a scalar subquery (one aggregate row), not a join.
    total = posts.agg(F.count(F.lit(1)).alias("total")).scalar()
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit(viewer), F.col("id").cast("string")))
    # Ten rows, used twice below: the page is made once.
    page_rows = cut_lineage(posts.select("id", "pageName", F.coalesce("details", F.lit("")).alias("details"),
                              "likesCount", "commentsCount", "sharesCount", "studyId", order.alias("_o"))
                 .orderBy("_o", "id").offset((page - 1) * limit).limit(limit))
    # The images of one page's posts: a semi join before encoding, one row per post.
    imgs = images_of(image, page_rows.select(F.col("id").alias("postId")))
    return (page_rows.join(imgs, page_rows["id"] == imgs["postId"], "left")
            .select(*[c for c in page_rows.columns if c != "_o"],
                    F.coalesce("images", F.array()).alias("images"), total.alias("total")))
