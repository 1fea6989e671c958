"""Stored tables: changes rewrite what they touch, bucketed answers need no exchange."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from crowdtally.operators import consensus as C
from crowdtally.operators import progress as P
from crowdtally.sources import tables as TB
from crowdtally.sources.mapping import annotation_tables

SF = "/root/testdata/sf0.001"
CHANGE = "batchOrder long, op string, id long, details string, studyId long"


def stored(spark):
    base = tempfile.mkdtemp(prefix="ct-stored-", dir="/tmp")
    TB.write_tables({"post": annotation_tables(spark, SF)["post"]}, base)
    return base


def files(base):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, ns in os.walk(os.path.join(base, "post"))
            for n in ns if n.endswith(".parquet")}


def posts(spark, base):
    return {r.id: (r.studyId, r.details) for r in TB.load_tables(spark, base, names=["post"])["post"].collect()}


def test_untouched_partitions_keep_their_files(spark):
    base = stored(spark)
    before, old = files(base), posts(spark, base)
    status = TB.write_changes(spark, base, "post", spark.createDataFrame(
        [(1, "update", 1, "new", None), (2, "delete", 6, None, None), (3, "update", 10_000, "x", None)], CHANGE))
    assert sorted(r.status for r in status.collect()) == ["deleted", "not_found", "updated"]
    after, now = files(base), posts(spark, base)
    kept = {p for p in before if "studyId=1/" not in p}
    assert kept and all(after[p] == before[p] for p in kept)
    assert not any(p in after for p in before if "studyId=1/" in p)
    assert now == {k: v for k, v in old.items() if k != 6} | {1: (1, "new")}


def test_a_row_can_move_and_a_study_can_end(spark):
    base = stored(spark)
    old = posts(spark, base)
    of_two = [i for i, (s, _) in old.items() if s == 2]
    changes = [(n, "delete", i, None, None) for n, i in enumerate(of_two[1:])]
    changes += [(900, "update", of_two[0], None, 3), (901, "insert", 5000, "first of its study", 77)]
    TB.write_changes(spark, base, "post", spark.createDataFrame(changes, CHANGE))
    now = posts(spark, base)
    assert now[of_two[0]][0] == 3 and now[5000] == (77, "first of its study")
    assert {k: v for k, v in now.items() if k not in (of_two[0], 5000)} == {k: v for k, v in old.items() if v[0] != 2}
    assert not os.path.exists(os.path.join(base, "post", "studyId=2"))


def test_a_failed_write_leaves_the_old_rows(spark):
    base = stored(spark)
    before, old = files(base), posts(spark, base)
    bad = spark.createDataFrame([(1, "update", 1, "new", None)], CHANGE).withColumn(
        "details", F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("details")))
    with pytest.raises(Exception, match="lost"):
        TB.write_changes(spark, base, "post", bad)
    assert files(base) == before and posts(spark, base) == old


def test_old_rows_are_read_from_touched_studies_only(spark):
    base = stored(spark)
    old = TB.load_tables(spark, base, names=["post"])["post"]
    at = os.path.join(base, "touched")
    spark.createDataFrame([(1, 3)], "studyId long, n long").write.parquet(at)
    found = TB.rows_of_touched(old, spark.read.parquet(at), "studyId")
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert {r.studyId for r in found.collect()} == {1}


def test_bucketed_answers_are_not_exchanged(spark):
    t = annotation_tables(spark, SF)
    b = TB.write_bucketed(spark, t["classification"], t["post"], 4, f"t_{uuid.uuid4().hex}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = C.validated_labels(b["classification"], b["post"], t["study"].hint("broadcast"))
        counts = P.post_rater_counts(b["classification"])
        for df in (labels, counts):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan, plan
        plain = C.validated_labels(t["classification"], t["post"], t["study"])
        assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
