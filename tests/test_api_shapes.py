"""The response shapes stated in the reference's API examples (FIXTURES section 3)."""

import datetime as dt

from crowdtally.operators import scores as S
from crowdtally.operators import state as ST


def test_nested_classification_map_example(spark):
    # {"45": {"7": [2, 5], "8": [3]}, "46": {"7": [9]}}, question 8 being a sentiment question
    cls = spark.createDataFrame([(1, 45, 7, 2), (1, 45, 7, 5), (1, 45, 8, 3), (1, 46, 7, 9)],
                                "userId bigint, postId bigint, questionId bigint, categoryId bigint")
    cats = spark.createDataFrame([(2, "tematicas"), (5, "tematicas"), (3, "sentimento"), (9, "tematicas")],
                                 "id bigint, categoryType string")
    got = {r.postId: dict(r.questions) for r in ST.user_classifications_nested(cls, cats).collect()}
    assert got == {45: {7: [2, 5], 8: [3]}, 46: {7: [9]}}


def test_timeline_row_example(spark):
    t = dt.datetime(2026, 2, 20, 9, 30)
    rows = [(7, t + dt.timedelta(minutes=i)) for i in range(15)] + [(7, dt.datetime(2026, 2, 21, 1))]
    cls = spark.createDataFrame(rows, "userId bigint, createdAt timestamp_ntz")
    got = [tuple(r) for r in S.timeline(cls, user_id=7).collect()]
    assert got == [(7, "2026-02-20", 15), (7, "2026-02-21", 1)]


def test_user_score_example(spark):
    """validated 12.5, not_validated 7.5: 20 answered pairs, 12 right, one
    half right (two categories ticked), 7 wrong."""
    from crowdtally.operators import consensus as C

    rows = []
    for pair in range(20):
        post, q = 100 + pair, 7
        rows += [(u, post, q, 1) for u in (2, 3, 4)]          # the crowd agrees on category 1
        if pair < 12:
            rows.append((1, post, q, 1))
        elif pair == 12:
            rows += [(1, post, q, 1), (1, post, q, 2)]
        else:
            rows.append((1, post, q, 2))
    cls = spark.createDataFrame(rows, "userId bigint, postId bigint, questionId bigint, categoryId bigint")
    post = spark.createDataFrame([(100 + p, 1) for p in range(20)], "id bigint, studyId bigint")
    study = spark.createDataFrame([(1, "s", 3, None, 50)], "id bigint, name string, minClassificationsPerPost int, "
                                  "maxClassificationsPerUser int, validationAgreementPercent int")
    user = spark.createDataFrame([(1, "ana")], "id bigint, username string")
    assert [tuple(r) for r in C.stats_user(cls, user, post, study, "ana").collect()] == [(12.5, 7.5)]
