"""Anonymised score boards for all viewers in one run.

What a viewer may see depends only on the set of studies they belong to, so viewers fall
into classes: one class per occurring set, and one for all investigators.  A rater belongs
to exactly one class of the same kind; a viewer's class sees a rater's class when the two
sets share a study.  Pairs of classes are therefore found over the classes' studies, and
each class gets its list of raters by one join, without a duplicate to remove.  A board has
one row per (class, rater seen), never one per (viewer, rater).

The number in an anonymised name is the rater's rank among the raters the class sees,
taken over a global sort (``functions.ranking``), so a large class is not one task.  Scores
are computed once, for all raters, in one pass over the answers.  A viewer's own name is
put in last, by ``boards_of``.

Classes are named by their study ids, ascending and joined by commas; investigators are in
the class ``investigator`` and see every rater by name.  A viewer without a study is in no
class and sees nobody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import position_in_group
from .scores import ANON_PREFIX, INVESTIGATOR, all_user_scores, two_places


def study_classes(user_study: DataFrame) -> DataFrame:
    """(userId, viewerClass, studies) of every user with a study."""
    studies = F.array_sort(F.collect_set("studyId"))
    return (user_study.where(F.col("studyId").isNotNull()).groupBy("userId").agg(studies.alias("studies"))
            .withColumn("viewerClass", F.array_join(F.col("studies").cast("array<string>"), ",")))


def viewer_classes(user: DataFrame, user_study: DataFrame) -> DataFrame:
    """(viewerId, viewerClass); investigators are one class whatever their studies."""
    u = user.select(F.col("id").alias("userId"), "type")
    everyone = u.join(study_classes(user_study).drop("studies"), "userId", "left")
    name = F.when(F.col("type") == INVESTIGATOR, F.lit(INVESTIGATOR)).otherwise(F.col("viewerClass"))
    return (everyone.select(F.col("userId").alias("viewerId"), name.alias("viewerClass"))
            .where(F.col("viewerClass").isNotNull()))


def seen_classes(classes: DataFrame, viewers: DataFrame) -> DataFrame:
    """(viewerClass, raterClass) of classes that share a study, for classes with a viewer."""
    own = classes.select("viewerClass", "studies").distinct()
    of_viewers = own.join(viewers.select("viewerClass").distinct(), "viewerClass", "left_semi")
    a = of_viewers.select("viewerClass", F.explode("studies").alias("studyId"))
    b = own.select(F.col("viewerClass").alias("raterClass"), F.explode("studies").alias("studyId"))
    return a.join(b, "studyId").select("viewerClass", "raterClass").distinct()


def visible_raters(user: DataFrame, user_study: DataFrame, raters: DataFrame) -> DataFrame:
    """``raters`` (userId and more columns, one row each) as each class of viewers sees
    them: + viewerClass, username."""
    named = raters.join(user.select(F.col("id").alias("userId"), "username"), "userId")
    viewers, classes = viewer_classes(user, user_study), study_classes(user_study)
    placed = named.join(classes.select("userId", F.col("viewerClass").alias("raterClass")), "userId")
    by_study = placed.join(seen_classes(classes, viewers), "raterClass").drop("raterClass")
    # All raters for the class of investigators, if there is one (a subquery, not a join).
    staff = viewers.where(F.col("viewerClass") == INVESTIGATOR).agg((F.count("*") > 0).alias("any")).scalar()
    return by_study.unionByName(named.where(staff).withColumn("viewerClass", F.lit(INVESTIGATOR)))


def numbered(seen: DataFrame) -> DataFrame:
    """+ number (from 1, by rater id within the class) and anonymizedUser."""
    ranked = position_in_group(seen, "viewerClass", ["userId"], "_pos")
    name = F.when(F.col("viewerClass") == INVESTIGATOR, F.col("username")).otherwise(
        F.concat(F.lit(ANON_PREFIX), (F.col("_pos") + 1).cast("string")))
    return (ranked.withColumn("number", F.col("_pos") + 1).withColumn("anonymizedUser", name)
            .drop("_pos", "_pos_n"))


def visible_users_all(t: dict[str, DataFrame]) -> DataFrame:
    """(viewerClass, id, username) of every rater that a class of viewers sees."""
    raters = t["classification"].select("userId").distinct()
    return (visible_raters(t["user"], t["user_study"], raters)
            .select("viewerClass", F.col("userId").alias("id"), "username"))


def anonymized_users_all(t: dict[str, DataFrame]) -> DataFrame:
    """(viewerClass, userId, number, anonymizedUser)."""
    raters = t["classification"].select("userId").distinct()
    return (numbered(visible_raters(t["user"], t["user_study"], raters))
            .select("viewerClass", "userId", "number", "anonymizedUser"))


def stats_general_all(t: dict[str, DataFrame]) -> DataFrame:
    """(viewerClass, userId, number, anonymizedUser, validated, not_validated), rounded to
    2 places.  A rater is who has a score, so the answers are read once for both."""
    board = numbered(visible_raters(t["user"], t["user_study"], all_user_scores(t)))
    return board.select("viewerClass", "userId", "number", "anonymizedUser",
                        two_places("validated").alias("validated"),
                        two_places("not_validated").alias("not_validated"))


def boards_of(viewers: DataFrame, t: dict[str, DataFrame], board: DataFrame | None = None) -> DataFrame:
    """The boards of some viewers (a frame with ``viewerId``), each with the viewer's own
    name in place: viewerId, anonymizedUser, validated, not_validated.  Its size is the
    viewers' times what they see, so ask for those that are shown."""
    board = stats_general_all(t) if board is None else board
    own = t["user"].select(F.col("id").alias("viewerId"), F.col("username").alias("_own"))
    who = (viewers.select("viewerId").distinct()
           .join(viewer_classes(t["user"], t["user_study"]), "viewerId").join(own, "viewerId"))
    shown = F.when(F.col("userId") == F.col("viewerId"), F.col("_own")).otherwise(F.col("anonymizedUser"))
    return (board.join(who, "viewerClass")
            .select("viewerId", shown.alias("anonymizedUser"), "validated", "not_validated"))


__all__ = ["study_classes", "viewer_classes", "seen_classes", "visible_raters", "numbered",
           "visible_users_all", "anonymized_users_all", "stats_general_all", "boards_of"]
