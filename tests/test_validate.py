"""Batch validation rules and snapshot changes."""

import random

import pytest
from pyspark.sql import functions as F

from crowdtally.operators import validate as V


def test_category_import_reasons_and_in_batch_duplicates(spark):
    question = spark.createDataFrame([(7, 1), (8, 1), (9, 2)], "id bigint, studyId bigint")
    cats = spark.createDataFrame([(1, "A", "tematicas", 7)], "id bigint, name string, categoryType string, questionId bigint")
    cands = spark.createDataFrame([
        (1, "A", "Temáticas", 8),      # name taken in study 1 (via question 8)
        (2, "B", " Temáticas 2024 !", 8),
        (3, "B", "tematicas", 7),      # same name, same study, later -> duplicate
        (4, "B", "tematicas", 9),      # other study -> fine
        (5, None, "x", 7),             # missing
        (6, "C", "123", 7),            # type empty after slug
        (7, "D", "ok", 99),            # unknown question
        (8, "E", "ok", 0),             # 0 is missing in JS
    ], "batchOrder bigint, name string, categoryType string, questionId bigint")
    r = {x.batchOrder: (x.reason, x.normalizedType) for x in V.category_import(cands, cats, question).collect()}
    assert r[1][0] == V.NAME_TAKEN and r[2] == (None, "tematicas") and r[3][0] == V.DUPLICATE
    assert r[4][0] is None and r[5][0] == V.MISSING and r[6][0] == V.BAD_TYPE
    assert r[7][0] == V.UNKNOWN_QUESTION and r[8][0] == V.MISSING
    legacy = {x.batchOrder: x.reason for x in V.category_import(cands, cats, question, True).collect()}
    assert legacy[4] == V.DUPLICATE


def test_user_import_two_keys(spark):
    user = spark.createDataFrame([(1, "ana", "a@x")], "id bigint, username string, email string")
    cands = spark.createDataFrame([
        (1, "bob", "pw", "b@x", "user", None),
        (2, "bob", "pw", "c@x", "user", "me"),   # username of an earlier candidate
        (3, "carl", "pw", "b@x", "user", None),  # email of an earlier candidate
        (4, "dan", "pw", "a@x", "user", None),   # email taken
        (5, "eve", "", "e@x", "user", None),     # missing password
        (6, "fay", "pw", "f@x", "user", None),
    ], "batchOrder bigint, username string, password string, email string, type string, createdBy string")
    out = V.user_import(cands, user)
    assert "password" not in out.columns
    r = {x.batchOrder: (x.reason, x.createdBy) for x in out.collect()}
    assert r[1] == (None, "admin") and r[2][0] == V.DUPLICATE and r[3][0] == V.DUPLICATE
    assert r[4][0] == V.USER_TAKEN and r[5][0] == V.MISSING and r[6] == (None, "admin")


COLUMNS = "batchOrder bigint, op string, id bigint, name string, n bigint, clear array<string>"


def applied(spark, old, changes, key="id"):
    snap, stat = V.apply_changes(old, spark.createDataFrame(changes, COLUMNS), key)
    return sorted(tuple(r) for r in snap.collect()), [r.status for r in stat.orderBy("batchOrder").collect()]


@pytest.mark.parametrize("block", [V.CHANGE_BLOCK, 2])
def test_apply_changes_in_order(spark, monkeypatch, block):
    monkeypatch.setattr(V, "CHANGE_BLOCK", block)
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id bigint, name string, n bigint")
    snap, status = applied(spark, old, [
        (1, "update", 1, None, 11, None), (2, "delete", 2, None, None, None), (3, "update", 9, "z", None, None),
        (4, "insert", 4, "d", 40, None), (5, "insert", 3, "x", 1, None), (6, "update", 1, "late", None, None),
        (7, "insert", 2, None, 22, None), (8, "update", 4, None, None, ["n"]), (9, "delete", 4, None, None, None),
        (10, "delete", 4, None, None, None), (11, "update", 3, None, 5, ["n", "name"])])
    assert snap == [(1, "late", 11), (2, None, 22), (3, None, 5)]
    assert status == ["updated", "deleted", V.NOT_FOUND, "inserted", V.CONFLICT, "updated", "inserted", "updated",
                      "deleted", V.NOT_FOUND, "updated"]


def test_update_clears_a_limit(spark):
    raw = spark.createDataFrame([(1, "", "7", "", "  ")],
                                "id bigint, minClassificationsPerPost string, maxClassificationsPerUser string, "
                                "validationAgreementPercent string, finishedAt string")
    limits = ["minClassificationsPerPost", "maxClassificationsPerUser", "validationAgreementPercent", "finishedAt"]
    update = V.set_always(V.study_clean(raw), limits).withColumns(
        {"batchOrder": F.lit(1).cast("long"), "op": F.lit("update")})
    old = spark.createDataFrame([(1, "s", 3, 4, 60, "2024-01-01")],
                                "id bigint, name string, minClassificationsPerPost int, "
                                "maxClassificationsPerUser int, validationAgreementPercent int, finishedAt string")
    snap, _ = V.apply_changes(old, update)
    assert [tuple(r) for r in snap.collect()] == [(1, "s", None, 7, None, None)]


def test_replay_against_a_plain_loop(spark):
    rnd = random.Random(3)
    old = [(i, f"o{i}", i) for i in range(1, 6)]
    changes = [(k, rnd.choice(["insert", "update", "update", "delete"]), rnd.randint(1, 8),
                rnd.choice([None, f"c{k}"]), rnd.choice([None, k]), rnd.choice([None, ["n"], ["name"]]))
               for k in range(300)]
    now, status = {i: [a, b] for i, a, b in old}, []
    for _, op, i, name, n, clear in changes:
        if op == "insert":
            status.append(V.CONFLICT if i in now else "inserted")
            now.setdefault(i, [name, n])
        elif i not in now:
            status.append(V.NOT_FOUND)
        elif op == "delete":
            status.append("deleted")
            del now[i]
        else:
            status.append("updated")
            for at, (c, v) in enumerate((("name", name), ("n", n))):
                if v is not None or c in (clear or ()):
                    now[i][at] = v
    got = applied(spark, spark.createDataFrame(old, "id bigint, name string, n bigint"), changes)
    assert got == (sorted((i, *v) for i, v in now.items()), status)


def test_update_rules(spark):
    study = spark.createDataFrame([(1, "A"), (2, "B")], "id bigint, name string")
    ups = spark.createDataFrame([(1, 1, "B"), (2, 1, "C"), (3, 2, "C"), (4, 1, "C"), (5, 9, "D"), (6, 1, None)],
                                "batchOrder bigint, id bigint, name string")
    r = {x.batchOrder: x.reason for x in V.study_update(ups, study).collect()}
    assert r == {1: V.NAME_TAKEN, 2: None, 3: V.DUPLICATE, 4: None, 5: None, 6: None}
    question = spark.createDataFrame([(1, 1, "q")], "id bigint, studyId bigint, question string")
    # The name "q" is taken until its question gets another one.
    qs = spark.createDataFrame([(0, 99, "Q ", "c", "t", 1), (1, 1, "x", "c", "t", 1), (2, 99, "y", "c", "t", 1),
                                (3, 99, "Q ", "c", "t", 1)],
                               "batchOrder bigint, id bigint, question string, content string, inputType string, "
                               "studyId bigint")
    r = {x.batchOrder: x.reason for x in V.question_import(qs, question).collect()}
    assert r == {0: V.NAME_TAKEN, 1: None, 2: V.NOT_FOUND, 3: V.NOT_FOUND}


def test_study_clean(spark):
    df = spark.createDataFrame([(1, "", "5", " ", "2025-01-01"), (2, "3", "", "60", "  ")],
                               "id bigint, minClassificationsPerPost string, maxClassificationsPerUser string, "
                               "validationAgreementPercent string, finishedAt string")
    r = {x.id: tuple(x)[1:] for x in V.study_clean(df).collect()}
    assert r[1] == (None, 5, None, "2025-01-01") and r[2] == (3, None, 60, None)
