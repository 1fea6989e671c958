"""Batches decided by rounds against replays of the requests one by one."""

import random

import pytest
from pyspark.sql import functions as F

from crowdtally.operators.claims import (GONE, HELD, WON, first_independent, replay_claims,
                                         replay_renames)


def replay(cands):
    taken, accepted = set(), []
    for order, *keys in sorted(cands):
        own = {(i, k) for i, k in enumerate(keys) if k is not None}
        if not own & taken:
            taken |= own
            accepted.append(order)
    return accepted


def decided(spark, cands, log=None):
    df = spark.createDataFrame(cands, "batchOrder long, username string, email string")
    return sorted(r[0] for r in first_independent(df, ["username", "email"], log).collect())


def test_a_refused_candidate_claims_nothing(spark):
    assert decided(spark, [(1, "u1", "e1"), (2, "u1", "e2"), (3, "u3", "e2")]) == [1, 3]


def test_a_long_chain(spark):
    chain = [(i, f"u{i // 2}", f"e{(i + 1) // 2}") for i in range(14)]
    log = []
    assert decided(spark, chain, log) == replay(chain) == list(range(0, 14, 2))
    assert log[-1] == 0 and len(log) <= 8


@pytest.mark.parametrize("seed", range(2))
def test_random_batches(spark, seed):
    draw = random.Random(seed)
    cands = [(i, draw.choice([None, *map(str, range(12))]), draw.choice([None, *map(str, range(15))])) for i in range(120)]
    assert decided(spark, cands) == replay(cands)


def test_one_hot_name_takes_few_rounds(spark):
    cands = [(i, "hot" if i % 3 else f"u{i}", f"e{i}") for i in range(2000)]
    log = []
    assert decided(spark, cands, log) == replay(cands)
    assert len(log) <= 3


def test_copies_and_an_empty_batch(spark):
    log = []
    assert decided(spark, [(i, "a", "b") for i in range(50)], log) == [0] and len(log) == 2
    empty = spark.createDataFrame([], "batchOrder long, username string, email string")
    assert first_independent(empty, ["username", "email"]).collect() == []


# ---- changed rows: names are released ---------------------------------------------

def updated(spark, stored, asked, log=None):
    """Outcome by batchOrder; ``asked``: (batchOrder, id, a, b)."""
    s = spark.createDataFrame(stored, "id long, a string, b string")
    c = spark.createDataFrame(asked, "batchOrder long, id long, a string, b string")
    names = {"a": F.col("a"), "b": F.col("b")}
    known = F.col("id").isin([r[0] for r in stored])
    got = {r[0]: r[1] for r in replay_claims(c, s, names, known, log=log).collect()}
    return [got.get(r[0]) for r in sorted(asked)]


def replayed(stored, asked):
    rows, out = {i: ((a, True), (b, True)) for i, a, b in stored}, []
    for _, i, *new in sorted(asked):
        others = [n[k][1] for r, n in rows.items() if r != i for k in (0, 1) if new[k] is not None and n[k][0] == new[k]]
        out.append((HELD if any(others) else WON) if others else None)
        if not others and i in rows:
            rows[i] = tuple((new[k], rows[i][k][0] == new[k] and rows[i][k][1]) for k in (0, 1))
    return out


def test_a_released_name_can_be_taken(spark):
    assert updated(spark, [(1, "A", None), (2, "B", None)], [(1, 1, "C", None), (2, 2, "A", None)]) == [None, None]


def test_a_swap_needs_a_third_name(spark):
    stored = [(1, "A", None), (2, "B", None)]
    assert updated(spark, stored, [(1, 1, "B", None), (2, 2, "A", None)]) == [HELD, HELD]
    assert updated(spark, stored, [(1, 1, "x", None), (2, 2, "A", None), (3, 1, "B", None)]) == [None] * 3


def test_a_rename_back_and_a_name_won_in_the_batch(spark):
    stored = [(1, "A", None), (2, "B", None)]
    asked = [(1, 1, "C", None), (2, 1, "A", None), (3, 2, "C", None), (4, 1, "C", None), (5, 2, "A", None)]
    assert updated(spark, stored, asked) == [None, None, None, WON, WON] == replayed(stored, asked)


def test_unknown_ids_write_nothing(spark):
    assert updated(spark, [(1, "A", None)], [(1, 9, "n", None), (2, 1, "n", None), (3, 9, "n", None)]) == [None, None, WON]


def test_a_chain_of_releases_takes_few_rounds(spark):
    n, log = 200, []
    stored = [(i, f"n{i}", None) for i in range(n)]
    asked = [(n - i, i, f"n{i + 1}", None) for i in range(n)]    # the last row moves away first
    assert updated(spark, stored, asked, log) == [None] * n
    assert log[-1] == 0 and len(log) <= 12


@pytest.mark.parametrize("seed", range(2))
def test_random_updates_of_two_names(spark, seed):
    draw = random.Random(seed)
    stored = [(i, f"a{i}", f"b{i}") for i in range(10)] + [(10, "a1", "b1"), (11, None, None)]
    asked = [(i, draw.randrange(14), draw.choice([None, f"a{draw.randrange(14)}"]), f"b{draw.randrange(14)}")
             for i in range(250)]
    got = updated(spark, stored, asked)
    assert got == replayed(stored, asked) and {None, HELD, WON} == set(got)


@pytest.mark.parametrize("seed", range(2))
def test_random_renames(spark, seed):
    draw = random.Random(seed)
    names = [f"n{i}" for i in range(8)]
    asked = [(i, draw.choice([*names, "nobody", None]), draw.choice([*names, "x", "y", None])) for i in range(150)]
    there, want = dict.fromkeys(names[:5], True), []
    for _, cur, new in asked:
        if cur not in there:
            want.append(GONE)
        elif new is None or new == cur:
            want.append(None)
        elif new in there:
            want.append(HELD if there[new] else WON)
        else:
            del there[cur]
            there[new] = False
            want.append(None)
    c = spark.createDataFrame(asked, "batchOrder long, cur string, new string")
    s = spark.createDataFrame([(x,) for x in names[:5]], "name string")
    got = {r[0]: r[1] for r in replay_renames(c, s, F.col("cur"), F.col("new")).collect()}
    assert [got.get(i) for i in range(150)] == want


def test_empty_batches(spark):
    stored = spark.createDataFrame([(1, "A")], "id long, a string")
    none = spark.createDataFrame([], "batchOrder long, id long, a string")
    assert replay_claims(none, stored, {"a": F.col("a")}).collect() == []
    assert updated(spark, [(1, "A", "B")], [(1, None, "A", None), (2, 1, None, None)]) == [HELD, None]
