"""Study progress, quotas and task assignment for all users at once.

Rules:

* a post is *complete* when its number of distinct raters reaches the study's
  ``minClassificationsPerPost``, *remaining* when it is below (a post nobody
  rated has 0 raters).  A study without posts still yields one remaining,
  available row with ``totalPosts`` = 0 (kept quirk of the outer join).
* ``userDonePosts`` counts distinct posts a user answered through questions of
  the study; ``userRemainingLimit = max(0, max - done)`` (null without max);
  ``available = max(0, min(raw, limit))`` or ``raw`` without a limit, where
  raw = remaining posts the user has not answered.
* the feed serves at most 10 posts (fewer when the limit leaves fewer).

Nothing here forms users x posts: availability is ``remaining(study)`` minus
the remaining posts a user already answered (two aggregates), and the feed
walks a per-study random permutation of the remaining posts from a per-user
random start (see ``next_posts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import position_in_group
from ..session import cut_lineage

# Fixed value: posts served per feed request.
FEED_SIZE = 10
DEFAULT_SEED = "42"
CANDIDATE_CHUNK = 4096


def post_rater_counts(classification: DataFrame) -> DataFrame:
    """postId -> raters (exact distinct users; compared with a threshold)."""
    return (classification.select("postId", "userId").distinct()
            .groupBy("postId").agg(F.count(F.lit(1)).alias("raters")))


def _study_limits(study: DataFrame) -> DataFrame:
    return study.select(F.col("id").alias("studyId"), F.col("name").alias("studyName"),
                        "minClassificationsPerPost", "maxClassificationsPerUser")


def post_status(post: DataFrame, study: DataFrame, classification: DataFrame) -> DataFrame:
    """Per study and post (one null post row for a study without posts):
    raters, complete, remaining flags (0/1).

    Posts keep their partitioning by postId: the study table joins them as the
    small side (Spark broadcasts it below its size limit), and the studies without
    posts come from an anti join against the few distinct study ids."""
    limits = _study_limits(study)
    p = post.select(F.col("id").alias("postId"), "studyId")
    counted = (p.join(post_rater_counts(classification), "postId", "left")
               .join(limits, "studyId").select("studyId", "postId", "raters", "minClassificationsPerPost"))
    empty = limits.join(p.select("studyId").distinct(), "studyId", "left_anti").select(
        "studyId", F.lit(None).cast(post.schema["id"].dataType).alias("postId"),
        F.lit(None).cast("bigint").alias("raters"), "minClassificationsPerPost")
    n = F.coalesce(F.col("raters"), F.lit(0))
    m = F.col("minClassificationsPerPost")
    return counted.unionByName(empty).select(
        "studyId", "postId", n.alias("raters"), F.when(n >= m, 1).otherwise(0).alias("complete"),
        F.when(n < m, 1).otherwise(0).alias("remaining"))


def study_completion(study: DataFrame, post: DataFrame, classification: DataFrame,
                     status: DataFrame | None = None) -> DataFrame:
    """totalPosts, completedPosts, remainingPosts per study."""
    st = status if status is not None else post_status(post, study, classification)
    agg = st.groupBy("studyId").agg(F.count("postId").alias("totalPosts"),
                                    F.sum("complete").cast("bigint").alias("completedPosts"),
                                    F.sum("remaining").cast("bigint").alias("remainingPosts"))
    return _study_limits(study).join(agg, "studyId")


def user_done_posts(classification: DataFrame, question: DataFrame) -> DataFrame:
    """Distinct posts per (user, study), the study taken from the question."""
    q = question.select(F.col("id").alias("questionId"), "studyId")
    return (classification.join(q, "questionId").select("userId", "studyId", "postId").distinct()
            .groupBy("userId", "studyId").agg(F.count(F.lit(1)).alias("userDonePosts")))


def remaining_done(classification: DataFrame, status: DataFrame) -> DataFrame:
    """Remaining posts each user already answered: (userId, studyId, postId)."""
    rem = status.filter((F.col("remaining") == 1) & F.col("postId").isNotNull()).select("postId", "studyId")
    return classification.select("userId", "postId").distinct().join(rem, "postId")


def answers_of(classification: DataFrame, members: DataFrame) -> DataFrame:
    """The answers of the members (``userId``): for requests of a few users."""
    return classification.join(members.select("userId").distinct(), "userId", "left_semi")


def user_available_posts(user_study: DataFrame, study: DataFrame, post: DataFrame,
                         classification: DataFrame, status: DataFrame | None = None,
                         own: DataFrame | None = None) -> DataFrame:
    """raw available posts per membership (userId, studyId); ``own`` may hold just
    the members' answers, raters are counted over all."""
    status = status if status is not None else post_status(post, study, classification)
    remaining = status.groupBy("studyId").agg(F.sum("remaining").cast("bigint").alias("remainingPosts"))
    done_rem = (remaining_done(classification if own is None else own, status).groupBy("userId", "studyId")
                .agg(F.count(F.lit(1)).alias("_doneRem")))
    return (user_study.join(remaining, "studyId").join(done_rem, ["userId", "studyId"], "left")
            .select("userId", "studyId",
                    (F.col("remainingPosts") - F.coalesce("_doneRem", F.lit(0))).alias("rawAvailablePostsForUser")))


def remaining_limit(max_col: Column, done_col: Column) -> Column:
    """``max(0, max - done)``, null when there is no maximum (Spark's greatest
    skips nulls, so the null case is handled explicitly)."""
    return F.when(max_col.isNotNull(), F.greatest(F.lit(0), max_col - done_col))


def study_progress(user_study: DataFrame, study: DataFrame, post: DataFrame, classification: DataFrame,
                   question: DataFrame, few_users: bool = False) -> DataFrame:
    """The full progress row for every membership.

    ``few_users`` says that ``user_study`` holds the memberships of one or a few
    users: then the posts are cut to their studies, raters are counted for those
    posts, and done posts from those users' answers only (semi joins with small
    sides).  For everybody's progress these cuts would only add exchanges."""
    answers, own = classification, classification
    if few_users:
        wanted = user_study.select("studyId").distinct()
        study = study.join(wanted.withColumnRenamed("studyId", "id"), "id", "left_semi")
        post = post.join(wanted, "studyId", "left_semi")
        answers = classification.join(post.select(F.col("id").alias("postId")), "postId", "left_semi")
        own = answers_of(classification, user_study)
    status = post_status(post, study, answers)
    comp = study_completion(study, post, answers, status)
    raw = user_available_posts(user_study, study, post, answers, status, own)
    # Done posts go through the question's study (not the post's): all own answers.
    done = user_done_posts(own, question)
    j = (raw.join(comp, "studyId").join(done, ["userId", "studyId"], "left")
         .withColumn("userDonePosts", F.coalesce("userDonePosts", F.lit(0)).cast("bigint")))
    limit = remaining_limit(F.col("maxClassificationsPerUser"), F.col("userDonePosts"))
    rawc = F.col("rawAvailablePostsForUser")
    available = F.when(limit.isNotNull(), F.greatest(F.lit(0), F.least(rawc, limit))).otherwise(rawc)
    pct = F.when(F.col("totalPosts") > 0,
                 F.round(F.col("completedPosts") / F.col("totalPosts") * 100).cast("bigint")).otherwise(0)
    return j.select(
        "userId", "studyId", "studyName", "totalPosts", "completedPosts", "remainingPosts",
        available.cast("bigint").alias("availablePostsForUser"), "userDonePosts",
        F.coalesce("minClassificationsPerPost", F.lit(0)).alias("minClassificationsPerPost"),
        "maxClassificationsPerUser", limit.cast("bigint").alias("userRemainingLimit"),
        pct.cast("bigint").alias("completionPercentage"))


def quota_column(max_col: Column, done_col: Column) -> Column:
    """Posts to serve: FEED_SIZE without a maximum, 0 at the limit, else min(10, left)."""
    left = F.greatest(F.lit(0), max_col - done_col)
    return (F.when(max_col.isNull(), F.lit(FEED_SIZE))
            .when(left <= 0, F.lit(0)).otherwise(F.least(F.lit(FEED_SIZE), left)))


def user_quota(pairs: DataFrame, study: DataFrame, classification: DataFrame, question: DataFrame) -> DataFrame:
    """Per (userId, studyId) pair: done posts, quota, limitReached."""
    done = user_done_posts(classification, question)
    s = study.select(F.col("id").alias("studyId"), "maxClassificationsPerUser")
    # Left join: without a study row the reference keeps the default of 10.
    j = pairs.join(s, "studyId", "left").join(done, ["userId", "studyId"], "left")
    d = F.coalesce("userDonePosts", F.lit(0))
    mx = F.col("maxClassificationsPerUser")
    return j.select("userId", "studyId", d.cast("bigint").alias("totalPostsDone"),
                    quota_column(mx, d).cast("bigint").alias("quota"),
                    (mx.isNotNull() & (mx - d <= 0)).alias("limitReached"))


def default_study(user_study: DataFrame) -> DataFrame:
    """First study of each user (smallest id)."""
    return user_study.groupBy("userId").agg(F.min("studyId").alias("defaultStudyId"))


def resolve_requests(requests: DataFrame, user_study: DataFrame) -> DataFrame:
    """requests(userId, requestedStudyId, includeClassified) -> target study and
    refusal ('no_studies', 'forbidden' or null)."""
    d = default_study(user_study)
    member = user_study.select("userId", F.col("studyId").alias("requestedStudyId"), F.lit(True).alias("_member"))
    j = requests.join(d, "userId", "left").join(member, ["userId", "requestedStudyId"], "left")
    refusal = (F.when(F.col("defaultStudyId").isNull(), F.lit("no_studies"))
               .when(F.col("requestedStudyId").isNotNull() & F.col("_member").isNull(), F.lit("forbidden")))
    return j.select("userId", "requestedStudyId", "includeClassified", "defaultStudyId",
                    refusal.alias("refusal"),
                    F.when(refusal.isNull(), F.coalesce("requestedStudyId", "defaultStudyId")).alias("targetStudyId"))


def progress_requests(requests: DataFrame, user_study: DataFrame, study: DataFrame, post: DataFrame,
                      classification: DataFrame, question: DataFrame) -> DataFrame:
    """The progress route: requests(userId, requestedStudyId) -> refusal
    ('missing_study' without a study, 'forbidden' for a non-member; there is no
    default study here) or the progress row of the requested study."""
    member = user_study.select("userId", F.col("studyId").alias("requestedStudyId"), F.lit(True).alias("_m"))
    r = requests.select("userId", "requestedStudyId").join(member, ["userId", "requestedStudyId"], "left")
    # Route parameters are strings: "0" is present (truthy), only a null is missing.
    refusal = (F.when(F.col("requestedStudyId").isNull(), F.lit("missing_study"))
               .when(F.col("_m").isNull(), F.lit("forbidden")))
    r = r.select("userId", "requestedStudyId", refusal.alias("refusal"))
    pairs = r.filter(F.col("refusal").isNull()).select("userId", F.col("requestedStudyId").alias("studyId"))
    prog = study_progress(pairs, study, post, classification, question).withColumnRenamed("studyId",
                                                                                          "requestedStudyId")
    return r.join(prog, ["userId", "requestedStudyId"], "left")


def _hash_order(seed: str, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def _hash_int(seed: str, col: str) -> Column:
    """15 hex digits of the hash: any position of any study can be a start."""
    return F.conv(F.substring(_hash_order(seed, col), 1, 15), 16, 10).cast("bigint")


def next_posts(targets: DataFrame, post: DataFrame, study: DataFrame, classification: DataFrame,
               seed: str = DEFAULT_SEED) -> DataFrame:
    """targets(userId, studyId, quota) -> (userId, studyId, postId, feedRank).

    Order: remaining posts of a study are permuted by md5(seed:postId); each
    user starts at md5(seed:userId) mod M (M = remaining posts of the study) and
    walks forward cyclically, skipping posts they already answered.  Only the
    first ``quota + (remaining posts the user answered)`` positions can be
    needed, so the candidate rows per user are bounded by the user's own
    activity - never users x posts.
    """
    status = post_status(post, study, classification)
    rem = status.filter((F.col("remaining") == 1) & F.col("postId").isNotNull()).select("studyId", "postId")
    ranked = position_in_group(rem, "studyId", [_hash_order(seed, "postId"), F.col("postId")], "pos")
    sizes = ranked.groupBy("studyId").agg(F.first("pos_n").alias("M"))
    # One row per request, used three times below: their done counts are made once.
    t = cut_lineage(targets.filter(F.col("quota") > 0))
    # The checkpointed permutation is the remaining set; only served users' answers count.
    done = (answers_of(classification, t).select("userId", "postId").distinct()
            .join(ranked.select("studyId", "postId"), "postId")
            .join(t.select("userId", "studyId"), ["userId", "studyId"], "left_semi"))
    d = done.groupBy("userId", "studyId").agg(F.count(F.lit(1)).alias("_d"))
    k = F.least(F.col("M"), F.col("quota") + F.coalesce("_d", F.lit(0)))
    users = (t.join(sizes, "studyId").join(d, ["userId", "studyId"], "left")
             .select("userId", "studyId", "quota", "M", k.alias("_k"),
                     F.pmod(_hash_int(seed, "userId"), F.col("M")).alias("_off")))
    # Candidate steps 0..k-1, generated in chunks that are spread over tasks, so a
    # user who answered a huge number of posts is not one long task.
    n_chunks = F.floor((F.col("_k") - 1) / CANDIDATE_CHUNK).cast("int")
    chunks = (users.select("*", F.explode(F.sequence(F.lit(0), n_chunks)).alias("_c"))
              .repartition("userId", "_c"))
    lo = F.col("_c").cast("bigint") * CANDIDATE_CHUNK
    hi = F.least(lo + CANDIDATE_CHUNK, F.col("_k")) - 1
    cand = chunks.select("userId", "studyId", "quota", "M", "_off", F.explode(F.sequence(lo, hi)).alias("step"))
    cand = cand.withColumn("pos", F.pmod(F.col("_off") + F.col("step"), F.col("M")))
    picked = (cand.join(ranked.select("studyId", "pos", "postId"), ["studyId", "pos"])
              .join(done.select("userId", "postId"), ["userId", "postId"], "left_anti"))
    w = Window.partitionBy("userId").orderBy("step")
    # The literal bound lets Spark keep only the first FEED_SIZE rows per user
    # before the shuffle (WindowGroupLimit); the per-user quota is applied after.
    return (picked.withColumn("feedRank", F.row_number().over(w))
            .filter(F.col("feedRank") <= FEED_SIZE)
            .filter(F.col("feedRank") <= F.col("quota"))
            .select("userId", "studyId", "postId", F.col("feedRank").cast("bigint").alias("feedRank")))


def history(classification: DataFrame, post: DataFrame, study: DataFrame) -> DataFrame:
    """Posts each user answered, per study, with the latest answer time."""
    p = post.select(F.col("id").alias("postId"), "studyId")
    s = study.select(F.col("id").alias("studyId"), F.col("name").alias("studyName"))
    return (classification.groupBy("userId", "postId").agg(F.max("createdAt").alias("createdAtMax"))
            .join(p, "postId").join(s, "studyId")
            .select("userId", "studyId", "studyName", "postId", "createdAtMax"))
