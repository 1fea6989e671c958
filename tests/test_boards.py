"""Boards for all viewers against each viewer's own board, worked out user by user."""

import random

import pytest

from crowdtally.operators import boards as B
from crowdtally.operators import scores as S


@pytest.fixture(scope="module")
def world(spark):
    draw = random.Random(4)
    users = [(i, f"name{i}", "investigator" if i % 9 == 0 else "user") for i in range(40)]
    member = [(u, s) for u, _, _ in users for s in range(6) if draw.random() < 0.3] + [(3, 1), (3, 1), (99, 2)]
    studies = [(s, 2, 50) for s in range(6)]
    posts = [(p, p % 6) for p in range(30)]
    answers = sorted({(draw.randrange(35), draw.randrange(30), 1, draw.randrange(3)) for _ in range(700)})
    frame = spark.createDataFrame
    return {"user": frame(users, "id long, username string, type string"),
            "user_study": frame(member, "userId long, studyId long"),
            "study": frame(studies, "id long, minClassificationsPerPost int, validationAgreementPercent int"),
            "post": frame(posts, "id long, studyId long"),
            "classification": frame(answers, "userId long, postId long, questionId long, categoryId long")}, users


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_each_viewer_gets_the_board_of_their_own(world):
    t, users = world
    everyone = B.boards_of(t["user"].selectExpr("id AS viewerId"), t).collect()
    seen = {u: sorted(tuple(r)[1:] for r in everyone if r.viewerId == u) for u, _, _ in users}
    for u, name, kind in users[::9] + [users[1]]:
        assert seen[u] == rows(S.stats_general(t, u, name, kind))


def test_some_viewers_only(world, spark):
    t, _ = world
    two = spark.createDataFrame([(9,), (5,), (5,), (1234,)], "viewerId long")
    assert {r.viewerId for r in B.boards_of(two, t).collect()} <= {5, 9}
    assert rows(B.boards_of(two, t)) == [r for r in rows(B.boards_of(t["user"].selectExpr("id AS viewerId"), t))
                                         if r[0] in (5, 9)]


def test_a_board_is_kept_once_per_class(world):
    t, users = world
    classes = {r.viewerId: r.viewerClass for r in B.viewer_classes(t["user"], t["user_study"]).collect()}
    board = B.stats_general_all(t).collect()
    assert {r.viewerClass for r in board} <= set(classes.values())
    keys = [(r.viewerClass, r.userId) for r in board]
    assert len(keys) == len(set(keys)) < 40 * 35
    for c in set(classes.values()):
        own = sorted((r.userId, r.number) for r in board if r.viewerClass == c)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_nobody_rates_or_belongs(world, spark):
    t, _ = world
    none = t | {"classification": t["classification"].limit(0)}
    assert B.stats_general_all(none).collect() == []
    alone = t | {"user_study": t["user_study"].limit(0)}
    assert {r.viewerClass for r in B.anonymized_users_all(alone).collect()} == {"investigator"}
    plain = t | {"user": t["user"].where("type = 'user'")}
    assert "investigator" not in {r.viewerClass for r in B.visible_users_all(plain).collect()}
