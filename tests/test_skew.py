"""A post holding a third of all answers: AQE splits the hot join partition and
the scores are unchanged."""

from pyspark.sql import functions as F

from crowdtally.operators import consensus as C
from crowdtally.sources.mapping import annotation_tables, classification_from_submissions

# Thresholds scaled down to the test data (defaults: 256 MB and factor 5).
SKEW_CONF = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
             "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.shuffle.partitions": "16"}


def _hot_classification(t):
    sub = t["submission"]
    hot = F.col("submissionId") % 3 == 0
    sub = (sub.withColumn("postId", F.when(hot, F.lit(0)).otherwise(F.col("postId")))
              .withColumn("questionId", F.when(hot, F.lit(1)).otherwise(F.col("questionId")))
              .withColumn("categoryId", F.when(hot, F.lit(3) + F.col("categoryId") % 3).otherwise(F.col("categoryId")))
              .withColumn("userId", F.when(hot, F.col("submissionId") + 1000000).otherwise(F.col("userId"))))
    return classification_from_submissions(sub)


def _scores(spark, t):
    cls = _hot_classification(t)
    v = C.validated_labels(cls, t["post"], t["study"])
    return C.user_scores(C.answer_weights(cls, v))


def test_hot_post_is_split_and_scores_are_unchanged(spark):
    t = annotation_tables(spark, "/root/testdata/sf0.1")
    old = {k: spark.conf.get(k) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        df = _scores(spark, t)
        split = sorted((r.userId, round(r.validated, 9), round(r.not_validated, 9)) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        plain = sorted((r.userId, round(r.validated, 9), round(r.not_validated, 9)) for r in _scores(spark, t).collect())
        assert split == plain and len(split) > 10000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
