"""Tables of the kept consensus that are dealt by post are changed where they lie."""

import datetime as dt
import random

from crowdtally.operators import incremental as I
from crowdtally.operators import state as ST
from crowdtally.session import Scratch, joins_as_dealt

BODY = "submissionId bigint, userId bigint, postId bigint, questionId bigint, categoryIds array<bigint>, " \
       "sentimentoCategoryIds array<bigint>, createdAt timestamp_ntz"


def bodies(spark, n, seed, start=0):
    draw = random.Random(seed)
    return spark.createDataFrame(
        [(start + i, draw.randrange(9), draw.choice([None, *range(1, 9)]), 1, draw.sample(range(3), draw.randint(0, 2)), None,
          dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randrange(300))) for i in range(n)], BODY)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_answers_and_votes_are_not_exchanged(spark):
    post = spark.createDataFrame([(p, 0) for p in range(1, 9)], "id long, studyId long")
    study = spark.createDataFrame([(0, 2, 60)], "id long, minClassificationsPerPost int, validationAgreementPercent int")
    old, new = bodies(spark, 80, 1), bodies(spark, 60, 2, 100)
    scratch = Scratch(spark, "dealt")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joins_as_dealt(spark):
            keep = lambda df: scratch.dealt(df, 4, "postId")
            state = I.started(ST.current_classifications(keep(old)), post, study, keep=keep)
            diff = I.differences(state, keep(new), post, study, keep=keep)
            after = I.folded(state, diff)
            assert [exchanges(after[n]) for n in ("answers", "votes", "labels")] == [0, 0, 0]
            got = {n: sorted(map(str, after[n].select(*sorted(after[n].columns)).collect())) for n in ("answers", "votes", "labels")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = I.started(ST.current_classifications(old.unionAll(new)), post, study)
    for n, rows in got.items():
        assert rows == sorted(map(str, want[n].select(*sorted(want[n].columns)).collect()))
    scratch.only()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("scratch_")]
