"""Uniqueness without case and accents, as an option."""

from crowdtally.operators import validate as V
from crowdtally.operators.collation import representatives, with_collation


def reasons(df):
    return {r.batchOrder: r.reason for r in df.collect()}


def test_binary_is_the_default_and_a_collation_folds(spark):
    study = spark.createDataFrame([(1, "Estudo")], "id long, name string")
    cands = spark.createDataFrame([(1, "estudo", "a"), (2, "Novo", "a"), (3, "NOVÓ", "a"), (4, None, "a"), (5, "x", "a")],
                                  "batchOrder long, name string, addedBy string")
    assert reasons(V.study_import(cands, study)) == {1: None, 2: None, 3: None, 4: V.MISSING, 5: None}
    got = with_collation(V.study_import, cands, ["name"], [(study, ["name"])])
    assert reasons(got) == {1: V.NAME_TAKEN, 2: None, 3: V.DUPLICATE, 4: V.MISSING, 5: None}
    assert {r.batchOrder: r.name for r in got.collect()} == {1: "estudo", 2: "Novo", 3: "NOVÓ", 4: None, 5: "x"}
    exact = with_collation(V.study_import, cands, ["name"], [(study, ["name"])], collation="UTF8_BINARY")
    assert reasons(exact) == reasons(V.study_import(cands, study))


def test_two_keys(spark):
    user = spark.createDataFrame([(1, "Ana", "ana@x.pt")], "id long, username string, email string")
    cands = spark.createDataFrame(
        [(1, "ANA", "p", "other@x.pt", "user", None), (2, "Bé", "p", "b@x.pt", "user", None),
         (3, "be", "p", "c@x.pt", "user", None), (4, "C", "p", "B@X.PT", "user", None), (5, "D", "p", "c@x.pt", "user", None)],
        "batchOrder long, username string, password string, email string, type string, createdBy string")
    both = ["username", "email"]
    got = with_collation(V.user_import, cands, both, [(user, both)])
    assert reasons(got) == {1: V.USER_TAKEN, 2: None, 3: V.DUPLICATE, 4: V.DUPLICATE, 5: None}


def test_names_are_matched_by_equi_joins(spark):
    names = spark.createDataFrame([("A",), ("á",), ("b",), (None,)], "text string")
    found = representatives(names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {tuple(r) for r in found.collect()} == {("A", "A"), ("á", "A"), ("b", "b")}
