"""Classification state: rejects, replace semantics, status, sentiment overwrite."""

import datetime as dt

from crowdtally.operators import state as ST
from crowdtally.streaming import jobs as J

BODY = ("submissionId bigint, userId bigint, postId bigint, questionId bigint, categoryIds array<bigint>, "
        "sentimentoCategoryIds array<bigint>, createdAt timestamp_ntz")
T0 = dt.datetime(2025, 1, 1)


def _bodies(spark, rows):
    return spark.createDataFrame(rows, BODY)


def test_rejects(spark):
    b = _bodies(spark, [(1, 1, 0, 7, [1], None, T0), (2, 1, 5, None, [1], None, T0), (3, 1, 5, 7, [], None, T0),
                        (4, 1, 5, 7, None, [2], T0)])
    r = {x.submissionId: x.reason for x in ST.submission_rejects(b).collect()}
    assert r == {1: ST.MISSING_IDS, 2: ST.MISSING_IDS, 3: ST.NO_CATEGORY}


def test_resubmission_replaces_everything(spark):
    b = _bodies(spark, [(1, 1, 5, 7, [1, 2], None, T0), (2, 1, 5, 7, [3], None, T0 + dt.timedelta(hours=1))])
    cur = sorted(x.categoryId for x in ST.current_classifications(b).collect())
    assert cur == [3]
    st = {x.submissionId: x.status for x in ST.submission_status(b).collect()}
    assert st == {1: ST.CREATED, 2: ST.UPDATED}


def test_same_time_tie_broken_by_submission_id(spark):
    b = _bodies(spark, [(5, 1, 5, 7, [1], None, T0), (9, 1, 5, 7, [2], [4], T0)])
    assert sorted(x.categoryId for x in ST.current_classifications(b).collect()) == [2, 4]


def test_current_is_idempotent_and_stream_merge_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, 5, 7, [i % 4], None, T0 + dt.timedelta(minutes=i % 5)) for i in range(1, 40)]
    b = _bodies(spark, rows)
    once = sorted(tuple(x) for x in ST.current_classifications(b).collect())
    first, second = _bodies(spark, rows[:20]), _bodies(spark, rows[20:])
    write = J.classification_batch_writer(str(tmp_path), fan_in=2)
    write(first, 0)
    write(second, 1)
    cols = ["userId", "postId", "questionId", "categoryId", "createdAt", "submissionId"]
    assert sorted(tuple(x) for x in J.current_state(spark, str(tmp_path)).select(*cols).collect()) == once
    write(second, 2)
    assert sorted(tuple(x) for x in J.current_state(spark, str(tmp_path)).select(*cols).collect()) == once


def test_sentiment_overwrite(spark):
    cls = spark.createDataFrame([(1, 5, 7, 1), (1, 5, 7, 2), (1, 5, 7, 3), (1, 6, 7, 1), (1, 6, 7, 3)],
                                "userId bigint, postId bigint, questionId bigint, categoryId bigint")
    cats = spark.createDataFrame([(1, "tematicas"), (2, "sentimento"), (3, "tematicas")],
                                 "id bigint, categoryType string")
    got = {(x.postId): x.categoryIds for x in ST.user_classification_lists(cls, cats).collect()}
    assert got == {5: [2, 3], 6: [1, 3]}
    nested = ST.user_classifications_nested(cls, cats).collect()
    assert {r.postId: dict(r.questions) for r in nested} == {5: {7: [2, 3]}, 6: {7: [1, 3]}}


def test_legacy_explode_first_sentiment_only(spark):
    b = spark.createDataFrame([(1, 5, 2, [1, 3], [8, 9], "ana", T0), (2, 5, 2, [1], None, "ana", T0),
                               (3, 5, 0, [1], None, "ana", T0), (4, 5, 2, [], [8], "ana", T0)],
                              "submissionId bigint, postId bigint, studyId bigint, categoryIds array<bigint>, "
                              "sentimentoCategoryIds array<bigint>, userId string, createdAt timestamp_ntz")
    got = sorted(x.post_classification for x in ST.legacy_explode(b).collect())
    assert got == [1, 3, 8]
