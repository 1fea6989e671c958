"""The candidates of one name are spread over the tasks."""

from pyspark.sql import functions as F

from crowdtally.operators import validate as V


def test_whole_rows_of_a_name_are_in_many_tasks(spark):
    cands = spark.createDataFrame(
        [(i, "A", "topic", 1) for i in range(200)] + [(500, "B", "topic", 1), (500, "B", "topic", 1), (501, "B", "topic", 1),
         (None, "B", "topic", 1), (502, "taken", "topic", 1), (None, "taken", "topic", 1), (503, None, "topic", 1)],
        "batchOrder long, name string, categoryType string, questionId long")
    categories = spark.createDataFrame([(1, "taken", 1)], "id long, name string, questionId long")
    question = spark.createDataFrame([(1, 1)], "id long, studyId long")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for legacy in (True, False):
            got = (V.category_import(cands, categories, question, legacy_global_names=legacy)
                   .select("batchOrder", "name", "reason", F.spark_partition_id().alias("task")).collect())
            assert len({r.task for r in got if r.name == "A"}) > 1
            why = {(r.name, r.batchOrder): r.reason for r in got}
            assert len(got) == 207 and why["A", 0] is None and all(why["A", i] == V.DUPLICATE for i in range(1, 200))
            assert (why["B", 500], why["B", 501], why["B", None]) == (None, V.DUPLICATE, None)
            assert why["taken", 502] == why["taken", None] == V.NAME_TAKEN and why[None, 503] == V.MISSING
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
