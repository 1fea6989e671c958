"""Classification state: validation of submissions, replace semantics, views.

A *submission* is one request body: (submissionId, userId, postId,
questionId, categoryIds[], sentimentoCategoryIds[], createdAt).  Rules :

* a body without postId or questionId (JavaScript falsy: null or 0) is
  rejected, then one with no category at all;
* a valid body *replaces* every earlier answer row of the same
  (user, post, question): the current state is the rows of the latest body,
  latest by (createdAt, submissionId);
* the first body of a (user, post, question) is 'created', later ones 'updated';
* the per-user view lists category ids per (post, question) in ascending id
  order where a 'sentimento' category replaces the list built so far.

Winners of bodies are found with aggregates (map-side partial ``max_by``/``min``),
so a (user, post, question) resubmitted very often is still combined per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UPQ = ["userId", "postId", "questionId"]

# Rejection reasons and statuses.
MISSING_IDS, NO_CATEGORY = "missing_post_or_question", "no_category"
CREATED, UPDATED = "created", "updated"
SENTIMENT, THEMATIC = "sentimento", "tematicas"


def _js_missing(c) -> F.Column:
    return c.isNull() | (c == 0)


def _all_categories() -> F.Column:
    return F.concat(F.coalesce("categoryIds", F.array().cast("array<bigint>")),
                    F.coalesce("sentimentoCategoryIds", F.array().cast("array<bigint>")))


def with_reject_reason(bodies: DataFrame) -> DataFrame:
    reason = (F.when(_js_missing(F.col("postId")) | _js_missing(F.col("questionId")), F.lit(MISSING_IDS))
              .when(F.size(_all_categories()) == 0, F.lit(NO_CATEGORY)))
    return bodies.withColumn("reason", reason)


def submission_rejects(bodies: DataFrame) -> DataFrame:
    """Rejected bodies with their reason."""
    return with_reject_reason(bodies).filter(F.col("reason").isNotNull()).select(
        "submissionId", *UPQ, "reason")


def valid_submissions(bodies: DataFrame) -> DataFrame:
    return with_reject_reason(bodies).filter(F.col("reason").isNull()).drop("reason")


def explode_submissions(bodies: DataFrame) -> DataFrame:
    """Valid bodies -> one row per category id (thematic ids, then sentiment ids)."""
    return valid_submissions(bodies).select("submissionId", *UPQ, F.explode(_all_categories()).alias("categoryId"),
                                            "createdAt")


def current_classifications(bodies: DataFrame) -> DataFrame:
    """The answer rows in force: the latest valid body of each (user, post, question).

    One aggregate picks the whole winning body per key (``max_by`` combines
    map-side), then only the winners are exploded."""
    valid = valid_submissions(bodies)
    body = F.struct("submissionId", "createdAt", _all_categories().alias("cats"))
    win = valid.groupBy(*UPQ).agg(F.max_by(body, F.struct("createdAt", "submissionId")).alias("_w"))
    return win.select(*UPQ, F.explode("_w.cats").alias("categoryId"), F.col("_w.createdAt").alias("createdAt"),
                      F.col("_w.submissionId").alias("submissionId"))


def submission_status(bodies: DataFrame) -> DataFrame:
    """'created' for the first valid body of a (user, post, question), else 'updated'."""
    valid = valid_submissions(bodies)
    first = (valid.groupBy(*UPQ).agg(F.min(F.struct("createdAt", "submissionId")).alias("_f")))
    j = valid.join(first, UPQ)
    is_first = (F.col("_f.createdAt") == F.col("createdAt")) & (F.col("_f.submissionId") == F.col("submissionId"))
    return j.select("submissionId", *UPQ, "createdAt",
                    F.when(is_first, F.lit(CREATED)).otherwise(F.lit(UPDATED)).alias("status"))


def user_classification_lists(classification: DataFrame, categories: DataFrame) -> DataFrame:
    """(userId, postId, questionId, categoryIds[]) with the sentiment overwrite rule.

    The list of one (user, post, question) is bounded by the question's
    categories, so collecting it is safe; no per-user map is ever built."""
    c = categories.select(F.col("id").alias("categoryId"), (F.col("categoryType") == SENTIMENT).alias("_s"))
    j = classification.join(c, "categoryId", "left").withColumn("_s", F.coalesce("_s", F.lit(False)))
    g = j.groupBy(*UPQ).agg(F.sort_array(F.collect_list(F.struct("categoryId", "_s"))).alias("_a"))
    idx = F.array_max(F.transform("_a", lambda x, i: F.when(x["_s"], i).otherwise(F.lit(0))))
    suffix = F.slice("_a", idx + 1, F.size("_a") - idx)
    return g.select(*UPQ, F.transform(suffix, lambda x: x["categoryId"]).alias("categoryIds"))


def user_classifications_nested(classification: DataFrame, categories: DataFrame) -> DataFrame:
    """(userId, postId, questions: map<questionId, array<categoryId>>) - one row per
    answered post, the nested shape of the reference's response."""
    lists = user_classification_lists(classification, categories)
    return lists.groupBy("userId", "postId").agg(
        F.map_from_entries(F.collect_list(F.struct("questionId", "categoryIds"))).alias("questions"))


# ---- legacy ---------------------------------------------------------------
def _legacy_bad() -> F.Column:
    return (_js_missing(F.col("postId")) | _js_missing(F.col("studyId")) | F.col("categoryIds").isNull()
            | (F.size("categoryIds") == 0) | F.col("userId").isNull() | (F.col("userId") == ""))


def legacy_rejects(bodies: DataFrame) -> DataFrame:
    """Legacy bodies (postId, studyId, categoryIds, sentimentoCategoryIds, userId
    as username) that the legacy handler refuses."""
    return bodies.filter(_legacy_bad())


def legacy_explode(bodies: DataFrame) -> DataFrame:
    """Legacy rows: every thematic id plus only the first sentiment id; an upsert
    on the full row, so repeats collapse (nothing is deleted)."""
    ok = bodies.filter(~_legacy_bad())
    ids = F.concat("categoryIds", F.slice(F.coalesce("sentimentoCategoryIds", F.array().cast("array<bigint>")), 1, 1))
    return (ok.select("postId", "studyId", F.explode(ids).alias("post_classification"), "userId")
            .dropDuplicates(["postId", "studyId", "post_classification", "userId"]))


def legacy_classified_posts(log: DataFrame, categories: DataFrame) -> DataFrame:
    """Per (user, post): thematic ids (ascending) and the last sentiment id."""
    c = categories.select(F.col("id").alias("post_classification"), "categoryType")
    j = log.join(c, "post_classification")
    return j.groupBy("userId", "postId").agg(
        F.sort_array(F.collect_list(F.when(F.col("categoryType") == THEMATIC, F.col("post_classification"))))
        .alias("thematic"),
        F.max(F.when(F.col("categoryType") == SENTIMENT, F.col("post_classification"))).alias("_sent"),
    ).select("userId", "postId", "thematic",
             F.when(F.col("_sent").isNull(), F.array().cast("array<bigint>"))
             .otherwise(F.array("_sent")).alias("sentiment"))


def current_from_log(rows: DataFrame) -> DataFrame:
    """The same replace rule on a stored flat log (one row per category): rows
    of the latest submission of each (user, post, question), where a submission's
    time is the latest of its rows.  The largest (time, submission) over a key's
    rows is that of the winning submission, so one window over the key is enough:
    one exchange and one sort of the log."""
    ok = rows.filter(~_js_missing(F.col("postId")) & ~_js_missing(F.col("questionId"))
                     & F.col("categoryId").isNotNull())
    newest = F.max(F.struct("createdAt", "submissionId")).over(Window.partitionBy(*UPQ))
    return (ok.withColumn("_w", newest).filter(F.col("submissionId") == F.col("_w.submissionId"))
            .select(*UPQ, "categoryId", F.col("_w.createdAt").alias("createdAt"), "submissionId"))
