"""Consensus kept up to date from changed answers.

The state is four tables, each with one row per key:

* ``answers`` - the rows in force, with the (createdAt, submissionId) of their body;
* ``votes`` - counted answers by (post, question, category);
* ``labels`` - the validated label of a (post, question), where there is one;
* ``scores`` - by rater: the sum of weights and the number of answered (post, question).

A batch of bodies replaces the answers of the (user, post, question) it names, if its body
is the later one.  What changes is then derived as signed differences:

1. votes: minus the replaced rows, plus the new ones, added to the counts of the touched
   (post, question) only;
2. labels: worked out again for the touched (post, question) from these counts;
3. scores: weights of the touched answers, and of all answers on a (post, question) whose
   label changed, old ones subtracted and new ones added, by rater.

So a batch reads the answers of the posts it touches, and nothing is recounted.  Where the
tables are stored by ``part_of`` a post, ``parts_touched`` tells which parts to read.  Every
join and aggregate but those by rater has the post among its keys, so tables dealt by post
(``session.Scratch.dealt``) are changed without an exchange of answers or votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import consensus as C
from . import state as ST

UPQ, PQ = ST.UPQ, C.PQ
TABLES = ("answers", "votes", "labels", "scores")


def part_of(parts: int, post: str = "postId") -> Column:
    """The part of a stored table that holds a post's rows."""
    return F.pmod(F.xxhash64(F.col(post).cast("long")), F.lit(parts)).cast("int")


def parts_touched(bodies: DataFrame, parts: int) -> list[int]:
    """The parts that a batch can change: at most ``parts`` numbers."""
    return sorted(r[0] for r in ST.valid_submissions(bodies).select(part_of(parts)).distinct().collect())


def started(answers: DataFrame, post: DataFrame, study: DataFrame, keep=lambda df: df) -> dict[str, DataFrame]:
    """The state for answers (userId, postId, questionId, categoryId, createdAt, submissionId).
    ``keep`` materialises the first three tables, each of which the next ones read."""
    answers = keep(answers)
    votes = keep(C.category_votes(answers))
    labels = keep(C.validated_labels(answers, post, study, votes=votes))
    return {"answers": answers, "votes": votes, "labels": labels,
            "scores": _scores(C.answer_weights(answers, labels))}


def _scores(weights: DataFrame) -> DataFrame:
    return weights.groupBy("userId").agg(F.sum("weight").alias("gained"), F.count(F.lit(1)).alias("answered"))


def differences(state: dict[str, DataFrame], bodies: DataFrame, post: DataFrame, study: DataFrame,
                keep=lambda df: df) -> dict[str, DataFrame]:
    """What a batch of bodies changes:

    * ``touched`` (user, post, question) with later answers, ``answers`` their new rows;
    * ``pairs`` the touched (post, question), ``votes`` and ``labels`` what holds for them now;
    * ``scores`` signed differences by rater.

    ``keep`` materialises the steps that several others read (a table or a checkpoint)."""
    body = F.struct("createdAt", "submissionId", ST._all_categories().alias("cats"))
    newest = (ST.valid_submissions(bodies).groupBy(*UPQ)
              .agg(F.max_by(body, F.struct("createdAt", "submissionId")).alias("b")))
    stamp = F.struct("createdAt", "submissionId")
    known = (state["answers"].join(newest.select(*UPQ), UPQ, "left_semi")
             .groupBy(*UPQ).agg(F.max(stamp).alias("had")))
    won = F.struct(F.col("b.createdAt").alias("createdAt"), F.col("b.submissionId").alias("submissionId"))
    winners = keep(newest.join(known, UPQ, "left")
                   .where(F.col("had").isNull() | (won > F.col("had"))).select(*UPQ, "b"))
    touched = winners.select(*UPQ)
    gone = state["answers"].join(touched, UPQ, "left_semi")
    fresh = winners.select(*UPQ, F.explode("b.cats").alias("categoryId"), "b.createdAt", "b.submissionId")
    pairs = keep(touched.select(*PQ).distinct())

    signed = (gone.select(*PQ, "categoryId", F.lit(-1).alias("cnt"))
              .unionAll(fresh.select(*PQ, "categoryId", F.lit(1).alias("cnt"))))
    votes = keep(state["votes"].join(pairs, PQ, "left_semi").select(*PQ, "categoryId", "cnt")
                 .unionAll(signed.select(*PQ, "categoryId", F.col("cnt").cast("long")))
                 .groupBy(*PQ, "categoryId").agg(F.sum("cnt").alias("cnt")).where("cnt > 0"))
    labels = keep(C.validated_labels(state["answers"], post, study, votes=votes))
    was = state["labels"].join(pairs, PQ, "left_semi")
    flipped = keep(was.withColumnRenamed("topCategoryId", "was").join(labels, PQ, "full_outer")
                   .where(~F.col("was").eqNullSafe(F.col("topCategoryId"))).select(*PQ))

    # Answers whose weight may differ: the touched ones, and all on a pair with another label.
    others = state["answers"].join(flipped, PQ, "left_semi").join(touched, UPQ, "left_anti")
    minus, plus = C.answer_weights(gone.unionAll(others), was), C.answer_weights(fresh.unionAll(others), labels)
    scores = (minus.select("userId", (-F.col("weight")).alias("weight"), F.lit(-1).alias("n"))
              .unionAll(plus.select("userId", "weight", F.lit(1).alias("n")))
              .groupBy("userId").agg(F.sum("weight").alias("gained"), F.sum("n").alias("answered")))
    return {"touched": touched, "pairs": pairs, "answers": fresh, "votes": votes, "labels": labels,
            "flipped": flipped, "scores": scores}


def folded(state: dict[str, DataFrame], diff: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The state after a batch: rows of untouched keys as they are, the others replaced."""
    def replaced(name: str, keys: DataFrame, on: list[str]) -> DataFrame:
        return state[name].join(keys, on, "left_anti").unionByName(diff[name].select(*state[name].columns))

    scores = (state["scores"].unionByName(diff["scores"]).groupBy("userId")
              .agg(F.sum("gained").alias("gained"), F.sum("answered").alias("answered")).where("answered > 0"))
    return {"answers": replaced("answers", diff["touched"], UPQ), "votes": replaced("votes", diff["pairs"], PQ),
            "labels": replaced("labels", diff["pairs"], PQ), "scores": scores}


def score_board(scores: DataFrame) -> DataFrame:
    """userId, validated, not_validated, as ``consensus.user_scores`` gives them."""
    return scores.select("userId", F.col("gained").alias("validated"),
                         (F.col("answered") - F.col("gained")).alias("not_validated"))
