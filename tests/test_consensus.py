"""Consensus rules on hand-made frames (FIXTURES section 5)."""

import pytest
from pyspark.sql import functions as F

from crowdtally.operators import consensus as C
from crowdtally.operators import scores as S

CLS = "userId bigint, postId bigint, questionId bigint, categoryId bigint"
STUDY = ("id bigint, name string, minClassificationsPerPost int, maxClassificationsPerUser int, "
         "validationAgreementPercent int")


def _study(spark, min_cls, pct):
    return spark.createDataFrame([(1, "s", min_cls, None, pct)], STUDY)


def _post(spark):
    return spark.createDataFrame([(10, 1)], "id bigint, studyId bigint")


def _votes(spark, cats):
    return spark.createDataFrame([(u, 10, 7, c) for u, c in enumerate(cats)], CLS)


def _validated(spark, cats, min_cls, pct):
    cls = _votes(spark, cats)
    return [tuple(r) for r in C.validated_labels(cls, _post(spark), _study(spark, min_cls, pct)).collect()]


def test_tie_for_top_never_validates(spark):
    assert _validated(spark, [1, 1, 2, 2], 1, 10) == []


def test_exact_threshold(spark):
    assert _validated(spark, [1, 1, 1, 2, 2], 5, 60) == [(10, 7, 1)]


def test_just_below_threshold(spark):
    assert _validated(spark, [1, 1, 1, 2, 2], 5, 61) == []


def test_below_min(spark):
    assert _validated(spark, [1, 1], 3, 10) == []


def test_null_limits(spark):
    assert _validated(spark, [1, 1, 1], None, 10) == []
    assert _validated(spark, [1, 1, 1], 1, None) == []


def test_multi_select_weight_half(spark):
    # user 0 picks A and B; users 1, 2 pick A -> label A (3 of 4 rows)
    rows = [(0, 10, 7, 1), (0, 10, 7, 2), (1, 10, 7, 1), (2, 10, 7, 1)]
    cls = spark.createDataFrame(rows, CLS)
    v = C.validated_labels(cls, _post(spark), _study(spark, 3, 50))
    w = {r.userId: r.weight for r in C.answer_weights(cls, v).collect()}
    assert w == {0: 0.5, 1: 1.0, 2: 1.0}
    s = {r.userId: (r.validated, r.not_validated) for r in C.user_scores(C.answer_weights(cls, v)).collect()}
    assert s[0] == (0.5, 0.5)


def test_properties_on_driver_data(spark):
    from crowdtally.sources.mapping import annotation_tables
    t = annotation_tables(spark, "/root/testdata/sf0.001")
    v = C.validated_labels(t["classification"], t["post"], t["study"])
    assert v.groupBy("postId", "questionId").count().filter("count > 1").count() == 0
    w = C.answer_weights(t["classification"], v)
    sc = C.user_scores(w)
    pairs = w.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
    bad = sc.join(pairs, "userId").filter(F.abs(F.col("validated") + F.col("not_validated") - F.col("n")) > 1e-9)
    assert bad.count() == 0


def test_stats_user_unknown_user_gives_zeros(spark):
    cls = _votes(spark, [1, 1, 1])
    user = spark.createDataFrame([(0, "a")], "id bigint, username string")
    r = C.stats_user(cls, user, _post(spark), _study(spark, 1, 10), "nobody").collect()
    assert [tuple(x) for x in r] == [(0.0, 0.0)]


def test_anonymity_numbering(spark):
    # raters 1..4; viewer 2 shares study 100 with 3 and 4 only; rater 1 is elsewhere
    user = spark.createDataFrame([(i, f"u{i}", "user") for i in range(1, 5)], "id bigint, username string, type string")
    cls = spark.createDataFrame([(i, 10, 7, 1) for i in range(1, 5)], CLS)
    us = spark.createDataFrame([(1, 200), (2, 100), (3, 100), (4, 100)], "userId bigint, studyId bigint")
    anon = {r.userId: r.anonymizedUser for r in S.anonymized_users(user, cls, us, 2, "u2", "user").collect()}
    assert anon == {2: "u2", 3: "Utilizador 2", 4: "Utilizador 3"}
    inv = {r.userId: r.anonymizedUser for r in S.anonymized_users(user, cls, us, 9, "boss", "investigator").collect()}
    assert inv == {1: "u1", 2: "u2", 3: "u3", 4: "u4"}


@pytest.mark.parametrize("n_parts", [1, 3, 7])
def test_dense_rank_global_matches_window(spark, n_parts):
    from pyspark.sql import Window

    from crowdtally.functions.ranking import dense_rank_global
    df = spark.range(0, 500).select((F.col("id") * 7 % 1000).alias("k"))
    df = df.unionByName(df)  # duplicates must share a rank
    got = {r.k: r.rank for r in dense_rank_global(df, "k", "rank", num_partitions=n_parts).collect()}
    want = {r.k: r.r for r in df.distinct().select("k", F.dense_rank().over(Window.orderBy("k")).alias("r")).collect()}
    assert got == want
