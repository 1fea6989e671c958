"""Registered queries of the progress / task-assignment family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed as FD
from ..operators import progress as P
from .consensus_queries import VIEWER
from .registry import register

SEED = P.DEFAULT_SEED

# ---- oracle building blocks: counts per post and per user, joined to memberships ----
CROWD = """
crowd AS (
  SELECT id AS postId, studyId, coalesce(people, 0) AS people
  FROM ann_post LEFT JOIN (SELECT postId, count(*) AS people
                           FROM (SELECT DISTINCT postId, userId FROM ann_classification) GROUP BY postId) n
    ON n.postId = id),
standing AS (
  SELECT s.id AS studyId, s.name AS studyName, s.minClassificationsPerPost AS floor_, s.maxClassificationsPerUser AS cap,
         count(postId) AS posts, count(*) FILTER (WHERE coalesce(people, 0) >= s.minClassificationsPerPost) AS complete,
         count(*) FILTER (WHERE coalesce(people, 0) < s.minClassificationsPerPost) AS open_
  FROM ann_study s LEFT JOIN crowd ON crowd.studyId = s.id GROUP BY ALL),
touched AS (
  SELECT userId, crowd.studyId, count(*) AS n
  FROM (SELECT DISTINCT userId, postId FROM ann_classification) JOIN crowd USING (postId)
  JOIN ann_study s ON s.id = crowd.studyId AND people < s.minClassificationsPerPost GROUP BY ALL)"""

FINISHED = """
finished AS (
  SELECT userId, studyId, count(DISTINCT postId) AS n
  FROM ann_classification JOIN (SELECT id AS questionId, studyId FROM ann_question) USING (questionId)
  GROUP BY ALL)"""

#: Columns of a progress row, ``{m}`` being a relation with userId and studyId.
PROGRESS_COLUMNS = """studyName, posts AS totalPosts, complete AS completedPosts, open_ AS remainingPosts,
       CAST(coalesce(greatest(0, least(open_ - coalesce(touched.n, 0), greatest(0, cap - coalesce(finished.n, 0)))
                              + 0 * cap), open_ - coalesce(touched.n, 0)) AS BIGINT) AS availablePostsForUser,
       coalesce(finished.n, 0) AS userDonePosts, coalesce(floor_, 0) AS minClassificationsPerPost,
       cap AS maxClassificationsPerUser,
       CAST(greatest(0, cap - coalesce(finished.n, 0)) + 0 * cap AS BIGINT) AS userRemainingLimit,
       CAST(coalesce(round(100 * complete::DOUBLE / nullif(posts, 0)), 0) AS BIGINT) AS completionPercentage"""


def progress_sql(members: str, before: str = "") -> str:
    """Progress rows of ``members``, a relation with userId and studyId."""
    return "WITH " + before + CROWD.strip() + "," + FINISHED + f""",
progress AS (
  SELECT m.userId, m.studyId, {PROGRESS_COLUMNS}
  FROM {members} m JOIN standing USING (studyId)
  LEFT JOIN touched ON touched.userId = m.userId AND touched.studyId = m.studyId
  LEFT JOIN finished ON finished.userId = m.userId AND finished.studyId = m.studyId)"""


ALLOWANCE = "greatest(0, least(10, coalesce(cap - coalesce(finished.n, 0), 10)))"

REQUESTS = FINISHED.strip() + f""",
request AS (
  SELECT r.*, mine.first_ AS defaultStudyId,
         CASE WHEN mine.first_ IS NULL THEN 'no_studies'
              WHEN NOT list_contains(mine.all_, coalesce(r.requestedStudyId, mine.first_)) THEN 'forbidden' END AS refusal
  FROM ann_feed_request r
  LEFT JOIN (SELECT userId, min(studyId) AS first_, list(studyId) AS all_ FROM ann_user_study GROUP BY userId) mine
    USING (userId)),
target AS (
  SELECT q.*, q.studyId AS targetStudyId, s.maxClassificationsPerUser AS cap,
         {ALLOWANCE.replace("cap", "s.maxClassificationsPerUser")} AS allowance
  FROM (SELECT *, CASE WHEN refusal IS NULL THEN coalesce(requestedStudyId, defaultStudyId) END AS studyId
        FROM request) q
  LEFT JOIN ann_study s ON s.id = q.studyId
  LEFT JOIN finished ON finished.userId = q.userId AND finished.studyId = q.studyId)"""

#: Brute force over users x open posts: the walk from each user's start, unanswered posts only.
SERVED = CROWD.strip() + "," + REQUESTS + f""",
ring AS (
  SELECT postId, studyId, count(*) OVER w AS size_,
         row_number() OVER (w ORDER BY md5(concat_ws(':', '{SEED}', postId)), postId) - 1 AS place
  FROM crowd JOIN ann_study s ON s.id = studyId AND people < s.minClassificationsPerPost
  WINDOW w AS (PARTITION BY studyId)),
served AS (
  SELECT t.userId, t.studyId, ring.postId,
         row_number() OVER (PARTITION BY t.userId ORDER BY (size_ + place
           - ('0x' || left(md5(concat_ws(':', '{SEED}', t.userId)), 15))::BIGINT % size_) % size_) AS feedRank
  FROM target t JOIN ring USING (studyId)
  ANTI JOIN ann_classification a ON a.userId = t.userId AND a.postId = ring.postId
  WHERE NOT t.includeClassified
  QUALIFY feedRank <= t.allowance)"""

PAST = """
past AS (
  SELECT a.userId, p.studyId, p.id AS postId, a.latest AS createdAtMax
  FROM (SELECT userId, postId, max(createdAt) AS latest FROM ann_classification GROUP BY ALL) a
  JOIN ann_post p ON p.id = a.postId SEMI JOIN ann_study s ON s.id = p.studyId)"""

#: Leaves of a payload: one row per image and one per category of a served post.
LEAVES = """
SELECT x.*, 'image' AS leaf, i.imageId AS leafId, NULL AS leafOf, base64(i.image_data) AS content,
       CAST(i.isFrontPage AS VARCHAR) AS kind
FROM served_post x JOIN ann_image i ON i.postId = x.id
UNION ALL
SELECT x.*, 'category', c.id, q.id, concat_ws('|', q.question, c.name), concat_ws('|', q.inputType, c.categoryType)
FROM served_post x JOIN ann_question q ON q.studyId = x.studyId JOIN ann_categories c ON c.questionId = q.id"""

POST_FIELDS = """p.id, p.pageName, p.pageLink, p.postLink, p.details, p.likesCount, p.commentsCount,
         p.sharesCount, p.studyId, s.name AS studyName, p.socialName"""


def leaves(payload, keys: list[str]):
    """A payload's rows with one line per image and per category."""
    flat = [*keys, "id", "pageName", "pageLink", "postLink", "details", "likesCount", "commentsCount",
            "sharesCount", "studyId", "studyName", "socialName"]
    img = payload.select(*flat, F.explode("images").alias("i")).select(
        *flat, F.lit("image").alias("leaf"), F.col("i.imageId").alias("leafId"),
        F.lit(None).cast("bigint").alias("leafOf"), F.col("i.image_data").alias("content"),
        F.col("i.isFrontPage").cast("string").alias("kind"))
    cat = payload.select(*flat, F.explode("questions").alias("q")).select(
        *flat, "q", F.explode("q.categories").alias("c")).select(
        *flat, F.lit("category"), F.col("c.id"), F.col("q.id"), F.concat_ws("|", "q.question", "c.name"),
        F.concat_ws("|", "q.inputType", "c.categoryType"))
    return img.union(cat)


# ---- Spark side helpers ---------------------------------------------------------
def _resolved(t):
    return P.resolve_requests(t["feed_request"], t["user_study"])


def _quota_for_targets(t, resolved):
    pairs = resolved.filter(F.col("targetStudyId").isNotNull()).select(
        "userId", F.col("targetStudyId").alias("studyId"))
    return P.user_quota(pairs, t["study"], t["classification"], t["question"])


def _served(t):
    resolved = _resolved(t)
    quota = _quota_for_targets(t, resolved)
    return P.next_posts(FD.feed_targets(resolved, quota), t["post"], t["study"], t["classification"], SEED)


# ---- registrations ------------------------------------------------------------------
@register("post_rater_counts", """
SELECT postId, count(*) AS raters FROM (SELECT DISTINCT postId, userId FROM ann_classification) GROUP BY ALL""")
def _q_post_rater_counts(t, spark, sf):
    return P.post_rater_counts(t["classification"])


@register("study_completion", "WITH " + CROWD.strip() + """
SELECT studyId, studyName, floor_ AS minClassificationsPerPost, cap AS maxClassificationsPerUser,
       posts AS totalPosts, complete AS completedPosts, open_ AS remainingPosts FROM standing""")
def _q_study_completion(t, spark, sf):
    return P.study_completion(t["study"], t["post"], t["classification"])


@register("user_available_posts", "WITH " + CROWD.strip() + """
SELECT m.userId, m.studyId, open_ - coalesce(n, 0) AS rawAvailablePostsForUser
FROM ann_user_study m JOIN standing USING (studyId)
LEFT JOIN touched ON touched.userId = m.userId AND touched.studyId = m.studyId""")
def _q_user_available_posts(t, spark, sf):
    return P.user_available_posts(t["user_study"], t["study"], t["post"], t["classification"])


@register("user_done_posts", "WITH " + FINISHED.strip() + """
SELECT userId, studyId, n AS userDonePosts FROM finished""")
def _q_user_done_posts(t, spark, sf):
    return P.user_done_posts(t["classification"], t["question"])


@register("study_progress", progress_sql("ann_user_study") + "SELECT * FROM progress")
def _q_study_progress(t, spark, sf):
    return P.study_progress(t["user_study"], t["study"], t["post"], t["classification"], t["question"])


@register("user_quota", "WITH " + FINISHED.strip() + f"""
SELECT m.userId, m.studyId, coalesce(finished.n, 0) AS totalPostsDone,
       CAST({ALLOWANCE} AS BIGINT) AS quota, coalesce(cap <= coalesce(finished.n, 0), false) AS limitReached
FROM ann_user_study m JOIN (SELECT id AS studyId, maxClassificationsPerUser AS cap FROM ann_study) USING (studyId)
LEFT JOIN finished ON finished.userId = m.userId AND finished.studyId = m.studyId""")
def _q_user_quota(t, spark, sf):
    return P.user_quota(t["user_study"], t["study"], t["classification"], t["question"])


@register("default_study", "WITH " + REQUESTS + """
SELECT userId, requestedStudyId, includeClassified, defaultStudyId, refusal, targetStudyId FROM target""")
def _q_default_study(t, spark, sf):
    return _resolved(t)


@register("next_posts", "WITH " + SERVED + """
SELECT userId, studyId, postId, feedRank FROM served""")
def _q_next_posts(t, spark, sf):
    return _served(t)


@register("history", "WITH " + PAST.strip() + """
SELECT userId, studyId, (SELECT name FROM ann_study s WHERE s.id = studyId) AS studyName, postId, createdAtMax
FROM past""")
def _q_history(t, spark, sf):
    return P.history(t["classification"], t["post"], t["study"])


def _asked_history(t, resolved):
    """History of the users who asked for it: other answers are not grouped."""
    return P.history(P.answers_of(t["classification"], FD.history_targets(resolved)), t["post"], t["study"])


@register("feed_status", "WITH " + SERVED + "," + PAST + """
SELECT userId, targetStudyId,
       CASE WHEN refusal IS NOT NULL THEN refusal
            WHEN includeClassified THEN if(old_ > 0, 'ok', 'no_history')
            WHEN cap IS NOT NULL AND allowance = 0 THEN 'limit_reached'
            ELSE if(new_ > 0, 'ok', 'none_available') END AS status,
       CASE WHEN refusal IS NOT NULL THEN 0 WHEN includeClassified THEN old_ ELSE new_ END AS nPosts
FROM (SELECT t.*, (SELECT count(*) FROM served v WHERE v.userId = t.userId) AS new_,
             (SELECT count(*) FROM past h WHERE h.userId = t.userId AND h.studyId = t.studyId) AS old_
      FROM target t)""")
def _q_feed_status(t, spark, sf):
    resolved = _resolved(t)
    quota = _quota_for_targets(t, resolved)
    served = P.next_posts(FD.feed_targets(resolved, quota), t["post"], t["study"], t["classification"], SEED)
    hist = _asked_history(t, resolved)
    return FD.feed_status(resolved, quota, served, hist)


@register("post_images_base64", """
SELECT postId, imageId, base64(image_data) AS image_data, isFrontPage FROM ann_image""")
def _q_post_images_base64(t, spark, sf):
    nested = FD.post_images_base64(t["image"])
    return nested.select("postId", F.inline("images"))


@register("study_questionnaire", """
SELECT q.studyId, q.id AS questionId, q.question, q.inputType,
       c.id AS categoryId, c.name, c.categoryType
FROM ann_question q LEFT JOIN ann_categories c ON c.questionId = q.id""")
def _q_study_questionnaire(t, spark, sf):
    nested = FD.study_questionnaire(t["question"], t["categories"])
    qs = nested.select("studyId", F.explode("questions").alias("q"))
    return qs.select("studyId", F.col("q.id").alias("questionId"), F.col("q.question").alias("question"),
                     F.col("q.inputType").alias("inputType"),
                     F.explode_outer("q.categories").alias("c")).select(
        "studyId", "questionId", "question", "inputType", F.col("c.id").alias("categoryId"),
        F.col("c.name").alias("name"), F.col("c.categoryType").alias("categoryType"))


@register("feed_payload", "WITH " + SERVED + f""",
served_post AS (
  SELECT v.userId, v.feedRank, {POST_FIELDS}
  FROM served v JOIN ann_post p ON p.id = v.postId JOIN ann_study s ON s.id = p.studyId)""" + LEAVES)
def _q_feed_payload(t, spark, sf):
    pay = FD.feed_payload(_served(t), t["post"], t["study"], t["image"], t["question"], t["categories"])
    return leaves(pay, ["userId", "feedRank"])


LEGACY_PAGE = {"viewer": VIEWER["username"], "page": 2, "limit": 10}


@register("legacy_posts_page", f"""
WITH pool AS (
  SELECT p.*, count(*) OVER () AS total,
         row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', '{LEGACY_PAGE["viewer"]}', p.id)), p.id) AS turn
  FROM ann_post p SEMI JOIN (ann_user_study us JOIN ann_user u ON u.id = us.userId
                             AND u.username = '{LEGACY_PAGE["viewer"]}') ON us.studyId = p.studyId)
SELECT pool.id, pageName, coalesce(details, '') AS details, likesCount, commentsCount, sharesCount, studyId, total,
       imageId, base64(image_data) AS image_data, isFrontPage
FROM pool LEFT JOIN ann_image ON ann_image.postId = pool.id
WHERE turn > {(LEGACY_PAGE["page"] - 1) * LEGACY_PAGE["limit"]} AND turn <= {LEGACY_PAGE["page"] * LEGACY_PAGE["limit"]}""")
def _q_legacy_posts_page(t, spark, sf):
    mem = (t["user_study"].join(t["user"].select(F.col("id").alias("userId"), "username"), "userId")
           .select(F.col("studyId").alias("study_id"), F.col("username").alias("user_name")))
    page = FD.legacy_posts_page(t["post"], t["image"], mem, LEGACY_PAGE["viewer"], LEGACY_PAGE["page"],
                                LEGACY_PAGE["limit"], SEED)
    rows = [c for c in page.columns if c != "images"]
    return page.select(*rows, F.explode_outer("images").alias("i")).select(
        *rows, F.col("i.imageId").alias("imageId"), F.col("i.image_data").alias("image_data"),
        F.col("i.isFrontPage").alias("isFrontPage"))


@register("study_progress_user", progress_sql(f"(FROM ann_user_study WHERE userId = {VIEWER['id']})") + "SELECT * FROM progress")
def _q_study_progress_user(t, spark, sf):
    """Progress of every study of one user (the reference's per-request shape)."""
    mine = t["user_study"].filter(F.col("userId") == F.lit(VIEWER["id"]))
    return P.study_progress(mine, t["study"], t["post"], t["classification"], t["question"], few_users=True)


@register("feed_progress", progress_sql("(SELECT userId, studyId FROM target WHERE refusal IS NULL)", REQUESTS.replace("finished", "answered") + ",\n") + "SELECT * FROM progress")
def _q_feed_progress(t, spark, sf):
    """The progress object of every accepted feed request (its target study)."""
    pairs = _resolved(t).filter(F.col("targetStudyId").isNotNull()).select(
        "userId", F.col("targetStudyId").alias("studyId"))
    return P.study_progress(pairs, t["study"], t["post"], t["classification"], t["question"])


@register("history_payload", "WITH " + REQUESTS + "," + PAST + f""",
served_post AS (
  SELECT h.userId, h.createdAtMax, {POST_FIELDS}
  FROM past h JOIN target t ON t.userId = h.userId AND t.targetStudyId = h.studyId
  JOIN ann_post p ON p.id = h.postId JOIN ann_study s ON s.id = p.studyId
  WHERE t.refusal IS NULL AND t.includeClassified)""" + LEAVES)
def _q_history_payload(t, spark, sf):
    resolved = _resolved(t)
    pay = FD.history_payload(resolved, _asked_history(t, resolved), t["post"], t["study"], t["image"], t["question"], t["categories"])
    return leaves(pay, ["userId", "createdAtMax"])


@register("progress_request", progress_sql("(SELECT userId, requestedStudyId AS studyId FROM ann_feed_request)") + """
SELECT r.userId, r.requestedStudyId,
       CASE WHEN r.requestedStudyId IS NULL THEN 'missing_study' WHEN u.userId IS NULL THEN 'forbidden' END AS refusal,
       p.* EXCLUDE (userId, studyId)
FROM ann_feed_request r
LEFT JOIN ann_user_study u ON u.userId = r.userId AND u.studyId = r.requestedStudyId
LEFT JOIN progress p ON p.userId = u.userId AND p.studyId = u.studyId""")
def _q_progress_request(t, spark, sf):
    """The progress route for every user's request (the feed request mapping)."""
    return P.progress_requests(t["feed_request"], t["user_study"], t["study"], t["post"], t["classification"],
                               t["question"])
