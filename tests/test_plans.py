"""Plan shape of every registered query: no product, no nested-loop join, no
Python evaluation in the physical plan."""

import pytest

from crowdtally.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]


@pytest.mark.parametrize("key", sorted(all_queries()))
def test_plan_has_no_product_or_python(spark, key):
    df = all_queries()[key](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [op for op in FORBIDDEN if op in plan]
    assert not bad, f"{key}: {bad}"


SF = "/root/testdata/sf0.01"


def _plan(df) -> list[str]:
    """Lines of the physical plan as a tree."""
    return [x.strip(" :+-*()0123456789") for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]


def _scans(lines, column):
    return sum("FileScan" in x and column in x for x in lines)


def test_posts_are_not_shuffled_by_study(spark):
    """With broadcasts held to small tables, only pre-aggregated rows move by studyId."""
    from crowdtally.operators import progress as P
    from crowdtally.sources.mapping import annotation_tables

    t = annotation_tables(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        for df in (P.study_completion(t["study"], t["post"], t["classification"]),
                   P.study_progress(t["user_study"], t["study"], t["post"], t["classification"], t["question"])):
            lines = _plan(df)
            for n, x in enumerate(lines):
                if "Exchange hashpartitioning(studyId" in x and "postId" not in x:
                    below = " ".join(lines[n:n + 3])
                    assert "HashAggregate" in below or "FileScan" not in " ".join(lines[n:n + 8]) \
                        or "p_partkey" not in " ".join(lines[n:n + 8]), below
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_latest_state_needs_one_exchange_of_the_log(spark):
    from crowdtally.operators import state as ST
    from crowdtally.sources.mapping import annotation_tables, submission_bodies

    t = annotation_tables(spark, SF)
    for df in (ST.current_from_log(t["submission"]),
               ST.current_classifications(submission_bodies(t["submission"], t["categories"]))):
        lines = _plan(df)
        assert sum("Exchange hashpartitioning" in x for x in lines) == 1, lines


def test_next_posts_reads_the_answers_three_times_at_most(spark):
    from crowdtally.plans.progress_queries import _served
    from crowdtally.sources.mapping import annotation_tables

    assert _scans(_plan(_served(annotation_tables(spark, SF))), "l_orderkey") <= 3
