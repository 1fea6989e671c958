"""Registered queries of the consensus kept from changes.

The submissions of the first half of the time form the state; the others arrive in three
batches, dealt by submission, so that a later batch also brings older bodies.  The oracles
count everything afresh over the latest bodies.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..operators import state as ST
from ..session import Scratch, joins_as_dealt
from ..sources.mapping import submission_bodies
from .consensus_queries import SHARE
from .registry import register

START = "1995-06-17 00:00:00"
BATCHES = 3

#: The rows in force, then the usual tally over them.
LATEST = """
body AS (
  SELECT *, row_number() OVER (PARTITION BY userId, postId, questionId ORDER BY sent DESC, submissionId DESC) AS place
  FROM (SELECT submissionId, userId, postId, questionId, max(createdAt) AS sent FROM ann_submission
        WHERE categoryId IS NOT NULL AND postId <> 0 AND questionId <> 0 GROUP BY ALL)),
force AS (
  SELECT s.userId, s.postId, s.questionId, s.categoryId
  FROM ann_submission s JOIN body USING (submissionId, userId, postId, questionId)
  WHERE place = 1 AND s.categoryId IS NOT NULL)"""
IN_FORCE = "WITH " + LATEST.strip() + "," + SHARE.strip().replace("ann_classification", "force")


def _kept(t, spark):
    """The answers, votes and labels are dealt by post once, with the bodies; from then on
    only rows by rater (and labels, for their study's limits) move."""
    scratch, n = Scratch(spark, "incremental"), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df):
        return scratch.dealt(df, n, "postId")

    with joins_as_dealt(spark):
        bodies = dealt(submission_bodies(t["submission"], t["categories"], (n, "postId")))
        first = F.col("createdAt") < F.lit(START).cast("timestamp_ntz")
        state = I.started(ST.current_classifications(bodies.where(first)), t["post"], t["study"], keep=dealt)
        state["scores"] = scratch.table(state["scores"])
        for k in range(BATCHES):
            batch = bodies.where(~first & (F.pmod("submissionId", F.lit(BATCHES)) == k))
            diff = I.differences(state, batch, t["post"], t["study"], keep=dealt)
            state = {name: scratch.table(df) if name == "scores" else dealt(df)
                     for name, df in I.folded(state, diff).items()}
            scratch.only(bodies, *state.values())
    return state


@register("consensus_after_changes", IN_FORCE + """
SELECT postId, questionId, winner AS topCategoryId FROM label""")
def _q_consensus_after_changes(t, spark, sf):
    return _kept(t, spark)["labels"].select("postId", "questionId", "topCategoryId")


@register("scores_after_changes", IN_FORCE + """
SELECT userId, round(gained, 6) AS validated, round(answered - gained, 6) AS not_validated FROM board""")
def _q_scores_after_changes(t, spark, sf):
    s = I.score_board(_kept(t, spark)["scores"])
    return s.select("userId", F.round("validated", 6).alias("validated"),
                    F.round("not_validated", 6).alias("not_validated"))


@register("votes_after_changes", "WITH " + LATEST.strip() + """
SELECT postId, questionId, categoryId, count(*) AS cnt FROM force GROUP BY ALL""")
def _q_votes_after_changes(t, spark, sf):
    return _kept(t, spark)["votes"].select("postId", "questionId", "categoryId", "cnt")
