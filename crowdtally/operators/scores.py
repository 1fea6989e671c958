"""Anonymised score board and activity timeline.

``stats_general`` is the reference's general statistics for one viewer: every
rater with at least one answer row who shares a study with the viewer (an
investigator sees all raters), named ``'Utilizador <n>'`` where n is the dense
rank of the rater id among the rows the viewer sees; the viewer's own row and
every row an investigator sees keep the username.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import dense_rank_global
from . import consensus as C

# Fixed value: the label prefix of anonymised raters.
ANON_PREFIX = "Utilizador "
INVESTIGATOR = "investigator"


def two_places(score):
    """Rounded to 2 places; the first rounding takes off what adding fractions in
    another order can change, so exact halves are rounded up whatever the order."""
    return F.round(F.round(score, 6), 2)


def raters(classification: DataFrame) -> DataFrame:
    """Distinct user ids with at least one answer row (partial aggregation)."""
    return classification.select("userId").distinct()


def co_members(user_study: DataFrame, viewer_id: int) -> DataFrame:
    """userId of everyone sharing at least one study with the viewer (viewer included
    when the viewer is a member of any study)."""
    mine = user_study.filter(F.col("userId") == F.lit(viewer_id)).select("studyId")
    return user_study.join(mine, "studyId", "left_semi").select("userId").distinct()


def visible_users(user: DataFrame, classification: DataFrame, user_study: DataFrame,
                  viewer_id: int, viewer_type: str) -> DataFrame:
    """Raters the viewer may see: (id, username)."""
    u = user.select("id", "username").join(raters(classification).withColumnRenamed("userId", "id"),
                                           "id", "left_semi")
    if viewer_type != INVESTIGATOR:
        u = u.join(co_members(user_study, viewer_id).withColumnRenamed("userId", "id"), "id", "left_semi")
    return u


def anonymized_users(user: DataFrame, classification: DataFrame, user_study: DataFrame,
                     viewer_id: int, viewer_username: str, viewer_type: str) -> DataFrame:
    """(userId, anonymizedUser) for the rows the viewer sees."""
    vis = visible_users(user, classification, user_study, viewer_id, viewer_type)
    if viewer_type == INVESTIGATOR:
        return vis.select(F.col("id").alias("userId"), F.col("username").alias("anonymizedUser"))
    ranked = dense_rank_global(vis, "id", "rnk")
    name = (F.when(F.col("username") == F.lit(viewer_username), F.col("username"))
            .otherwise(F.concat(F.lit(ANON_PREFIX), F.col("rnk").cast("string"))))
    return ranked.select(F.col("id").alias("userId"), name.alias("anonymizedUser"))


def all_user_scores(t: dict[str, DataFrame]) -> DataFrame:
    validated = C.validated_labels(t["classification"], t["post"], t["study"])
    return C.user_scores(C.answer_weights(t["classification"], validated))


def stats_general(t: dict[str, DataFrame], viewer_id: int, viewer_username: str, viewer_type: str) -> DataFrame:
    """anonymizedUser, validated, not_validated (rounded to 2 places).

    Labels need everybody's answers; weights are computed for the raters that the
    viewer sees only.  The score table has one row per rater, so it also tells who
    is a rater: the answers are read once for both."""
    answers, all_seen = t["classification"], viewer_type == INVESTIGATOR
    validated = C.validated_labels(answers, t["post"], t["study"])
    if not all_seen:
        answers = answers.join(co_members(t["user_study"], viewer_id), "userId", "left_semi")
    rows = C.user_scores(C.answer_weights(answers, validated)).join(
        t["user"].select(F.col("id").alias("userId"), "username"), "userId")
    shown = F.col("username")
    if not all_seen:
        rows = dense_rank_global(rows, "userId", "rnk")
        shown = F.when(shown == F.lit(viewer_username), shown).otherwise(
            F.concat(F.lit(ANON_PREFIX), F.col("rnk").cast("string")))
    return rows.select(shown.alias("anonymizedUser"), two_places("validated").alias("validated"),
                       two_places("not_validated").alias("not_validated"))


def timeline(classification: DataFrame, user_id: int | None = None, ts_col: str = "createdAt",
             user_col: str = "userId") -> DataFrame:
    """Answer rows per user per day ('yyyy-MM-dd'); one user's are ascending by date."""
    c = classification if user_id is None else classification.filter(F.col(user_col) == F.lit(user_id))
    day = F.date_format(F.col(ts_col), "yyyy-MM-dd").alias("date")
    days = c.groupBy(F.col(user_col).alias("userId"), day).agg(F.count(F.lit(1)).alias("count"))
    return days if user_id is None else days.orderBy("date")
