"""Progress, quota and feed rules (FIXTURES section 5, SURVEY N6)."""

from pyspark.sql import functions as F

from crowdtally.operators import feed as FD
from crowdtally.operators import progress as P

CLS = "userId bigint, postId bigint, questionId bigint, categoryId bigint, createdAt timestamp"
STUDY = ("id bigint, name string, minClassificationsPerPost int, maxClassificationsPerUser int, "
         "validationAgreementPercent int")


def _fixture(spark, max_limit=None):
    study = spark.createDataFrame([(1, "s1", 2, max_limit, 50), (2, "empty", 2, None, 50), (3, "nolimit", None, None, 50)],
                                  STUDY)
    post = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (30, 3)], "id bigint, studyId bigint")
    question = spark.createDataFrame([(7, 1), (9, 3)], "id bigint, studyId bigint")
    cls = spark.createDataFrame([(1, 10, 7, 1, None), (2, 10, 7, 1, None), (1, 11, 7, 1, None), (5, 30, 9, 1, None)],
                                CLS)
    us = spark.createDataFrame([(1, 1), (3, 1), (1, 2), (1, 3)], "userId bigint, studyId bigint")
    return study, post, question, cls, us


def test_study_completion_and_empty_study(spark):
    study, post, question, cls, us = _fixture(spark)
    c = {r.studyId: (r.totalPosts, r.completedPosts, r.remainingPosts)
         for r in P.study_completion(study, post, cls).collect()}
    assert c[1] == (3, 1, 2)          # post 10 has 2 raters
    assert c[2] == (0, 0, 1)          # kept quirk: empty study counts one remaining
    assert c[3] == (1, 0, 0)          # null min: neither completed nor remaining


def test_progress_rows(spark):
    study, post, question, cls, us = _fixture(spark, max_limit=3)
    rows = {(r.userId, r.studyId): r for r in P.study_progress(us, study, post, cls, question).collect()}
    r = rows[(1, 1)]
    assert r.userDonePosts == 2 and r.userRemainingLimit == 1 and r.availablePostsForUser == 1
    assert r.completionPercentage == 33
    r3 = rows[(3, 1)]
    assert r3.userDonePosts == 0 and r3.availablePostsForUser == 2 and r3.userRemainingLimit == 3
    e = rows[(1, 2)]
    assert e.totalPosts == 0 and e.remainingPosts == 1 and e.availablePostsForUser == 1
    assert e.completionPercentage == 0 and e.userRemainingLimit is None


def test_no_max_limit_available_is_raw(spark):
    study, post, question, cls, us = _fixture(spark, max_limit=None)
    r = {(x.userId, x.studyId): x for x in P.study_progress(us, study, post, cls, question).collect()}[(1, 1)]
    assert r.userRemainingLimit is None and r.availablePostsForUser == 1


def test_quota(spark):
    study, post, question, cls, us = _fixture(spark, max_limit=2)
    q = {(r.userId, r.studyId): (r.quota, r.limitReached) for r in P.user_quota(us, study, cls, question).collect()}
    assert q[(1, 1)] == (0, True)
    assert q[(3, 1)] == (2, False)
    assert q[(1, 3)] == (10, False)


def test_next_posts_on_driver_data(spark):
    from crowdtally.plans.progress_queries import _served
    from crowdtally.sources.mapping import annotation_tables
    t = annotation_tables(spark, "/root/testdata/sf0.01")
    served = _served(t).cache()
    assert served.groupBy("userId").count().filter("count > 10").count() == 0
    done = t["classification"].select("userId", "postId").distinct()
    assert served.join(done, ["userId", "postId"]).count() == 0
    ranks = served.groupBy("userId").agg(F.max("feedRank").alias("m"), F.count(F.lit(1)).alias("n"))
    assert ranks.filter("m != n").count() == 0


def test_resolve_requests(spark):
    us = spark.createDataFrame([(1, 4), (1, 2), (2, 3)], "userId bigint, studyId bigint")
    req = spark.createDataFrame([(1, None, False), (2, 4, False), (3, None, True)],
                                "userId bigint, requestedStudyId bigint, includeClassified boolean")
    r = {x.userId: (x.refusal, x.targetStudyId) for x in P.resolve_requests(req, us).collect()}
    assert r == {1: (None, 2), 2: ("forbidden", None), 3: ("no_studies", None)}


def test_feed_payload_shapes(spark):
    from crowdtally.sources.mapping import annotation_tables
    t = annotation_tables(spark, "/root/testdata/sf0.001")
    qs = FD.study_questionnaire(t["question"], t["categories"]).collect()
    assert all(len(r.questions) == 3 and all(len(q.categories) == 3 for q in r.questions) for r in qs)
    imgs = FD.post_images_base64(t["image"]).collect()
    assert all(i.image_data is None or "\n" not in i.image_data for r in imgs for i in r.images)


def test_next_posts_chunked_candidates_match_brute_force(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(P, "CANDIDATE_CHUNK", 3)
    study = spark.createDataFrame([(1, "s", 3, None, 50)], STUDY)
    post = spark.createDataFrame([(p, 1) for p in range(40)], "id bigint, studyId bigint")
    done = {1: set(range(0, 40, 2)), 2: set(range(25)), 3: set()}
    other = [(u, p) for u in (7, 8, 9) for p in range(30, 40)]           # posts 30..39 complete
    rows = [(u, p, 1, 1, None) for u, ps in done.items() for p in ps] + [(u, p, 1, 1, None) for u, p in other]
    cls = spark.createDataFrame(rows, CLS)
    targets = spark.createDataFrame([(1, 1, 10), (2, 1, 4), (3, 1, 10)], "userId bigint, studyId bigint, quota bigint")
    got = {}
    for r in P.next_posts(targets, post, study, cls, "42").collect():
        got.setdefault(r.userId, []).append((r.feedRank, r.postId))
    raters = {}
    for u, p, *_ in rows:
        raters.setdefault(p, set()).add(u)
    remaining = sorted((p for p in range(40) if len(raters.get(p, ())) < 3),
                       key=lambda p: (hashlib.md5(f"42:{p}".encode()).hexdigest(), p))
    m = len(remaining)
    for u, quota in ((1, 10), (2, 4), (3, 10)):
        off = int(hashlib.md5(f"42:{u}".encode()).hexdigest()[:15], 16) % m
        walk = [remaining[(off + s) % m] for s in range(m)]
        want = [p for p in walk if p not in done[u]][:quota]
        assert [p for _, p in sorted(got.get(u, []))] == want


def test_completed_plus_remaining_is_total_on_driver_data(spark):
    from crowdtally.sources.mapping import annotation_tables
    t = annotation_tables(spark, "/root/testdata/sf0.01")
    c = P.study_completion(t["study"], t["post"], t["classification"])
    rows = c.filter(F.col("minClassificationsPerPost").isNotNull() & (F.col("totalPosts") > 0)).collect()
    assert rows and all(r.completedPosts + r.remainingPosts == r.totalPosts for r in rows)
    prog = P.study_progress(t["user_study"], t["study"], t["post"], t["classification"], t["question"])
    assert prog.filter("availablePostsForUser < 0 OR availablePostsForUser > remainingPosts").count() == 0
