"""Consensus after any sequence of batches equals the count from scratch."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from crowdtally.operators import consensus as C
from crowdtally.operators import incremental as I
from crowdtally.operators import state as ST
from crowdtally.session import Scratch

BODY = "submissionId bigint, userId bigint, postId bigint, questionId bigint, categoryIds array<bigint>, " \
       "sentimentoCategoryIds array<bigint>, createdAt timestamp_ntz"


@pytest.fixture(scope="module")
def world(spark):
    post = spark.createDataFrame([(p, p % 2) for p in range(1, 9)], "id long, studyId long")
    study = spark.createDataFrame([(0, 2, 60), (1, 3, 50)],
                                  "id long, minClassificationsPerPost int, validationAgreementPercent int")
    return post, study


def bodies(spark, n, seed, start=0):
    draw = random.Random(seed)
    rows = [(start + i, draw.randrange(9), draw.choice([None, *range(1, 9)]), draw.choice([1, 2]),
             draw.sample(range(3), draw.randint(0, 2)), draw.choice([None, [7]]),
             dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randrange(300))) for i in range(n)]
    return spark.createDataFrame(rows, BODY)


def facts(state):
    board = {r.userId: (round(r.gained, 9), r.answered) for r in state["scores"].collect()}
    return (sorted(tuple(r) for r in state["answers"].select(*I.UPQ, "categoryId", "submissionId").collect()),
            sorted(tuple(r) for r in state["votes"].select(*I.PQ, "categoryId", "cnt").collect()),
            sorted(tuple(r) for r in state["labels"].select(*I.PQ, "topCategoryId").collect()), board)


@pytest.mark.parametrize("seed", [1])
def test_any_sequence_of_batches(spark, world, seed):
    post, study = world
    scratch = Scratch(spark, "test")
    batches = [bodies(spark, 60, seed), bodies(spark, 1, seed + 10, 100), bodies(spark, 40, seed + 20, 200),
               bodies(spark, 0, 0), bodies(spark, 25, seed + 30, 300)]
    state = I.started(ST.current_classifications(batches[0].limit(0)), post, study)
    seen = batches[0].limit(0)
    for b in batches:
        diff = I.differences(state, b, post, study, keep=scratch.table)
        state = {k: scratch.table(v) for k, v in I.folded(state, diff).items()}
        seen = seen.unionAll(b)
        assert facts(state) == facts(I.started(ST.current_classifications(seen), post, study))
    again = I.differences(state, batches[2], post, study, keep=scratch.table)   # nothing is later
    assert again["touched"].count() == 0 and again["scores"].count() == 0


def test_only_flipped_labels_bring_other_raters_in(spark, world):
    post, study = world
    t = dt.datetime
    rows = [(i, u, 2, 1, [c], None, t(2024, 1, 1)) for i, (u, c) in enumerate([(1, 0), (2, 0), (3, 0), (4, 1)])]
    state = I.started(ST.current_classifications(spark.createDataFrame(rows, BODY)), post, study)
    same = I.differences(state, spark.createDataFrame([(9, 4, 2, 1, [2], None, t(2024, 1, 2))], BODY), post, study)
    assert same["flipped"].count() == 0 and {r.userId for r in same["scores"].collect()} == {4}
    other = I.differences(state, spark.createDataFrame(
        [(8, 1, 2, 1, [1], None, t(2024, 1, 2)), (9, 2, 2, 1, [1], None, t(2024, 1, 2))], BODY), post, study)
    assert [tuple(r) for r in other["flipped"].collect()] == [(2, 1)]
    assert {r.userId for r in other["scores"].collect()} == {1, 2, 3, 4}


def test_untouched_posts_are_not_read(spark, world):
    post, study = world
    state = I.started(ST.current_classifications(bodies(spark, 80, 5)), post, study)
    root, parts = tempfile.mkdtemp(prefix="ct-parts-", dir="/tmp"), 5
    for name in ("answers", "votes", "labels"):
        state[name].withColumn("part", I.part_of(parts)).write.partitionBy("part").parquet(os.path.join(root, name))
    batch = bodies(spark, 40, 6, 500).where("postId IN (3, 4)")
    touched = I.parts_touched(batch, parts)
    assert 0 < len(touched) < parts
    for name in ("answers", "votes", "labels"):       # other parts cannot be read any more
        for d in os.listdir(os.path.join(root, name)):
            if d.startswith("part=") and int(d[5:]) not in touched:
                for f in os.listdir(os.path.join(root, name, d)):
                    if f.endswith(".parquet"):
                        open(os.path.join(root, name, d, f), "wb").close()
    stored = {n: spark.read.schema(state[n].schema.add("part", "integer")).parquet(os.path.join(root, n))
              .where(F.col("part").isin(touched)).drop("part") for n in ("answers", "votes", "labels")}
    got = I.differences(stored, batch, post, study)
    want = I.differences(state, batch, post, study)
    for name in ("answers", "votes", "labels", "scores"):
        assert sorted(map(tuple, got[name].collect())) == sorted(map(tuple, want[name].select(got[name].columns).collect()))
