import math

import numpy as np
import pytest

from crowdtally.llm import neighbours as N

VEC = "vec_id long, embedding array<float>, label int, score string, rank string"


def exact(data, k=N.K, step=N.QUERY_STEP):
    """(query, rank, vec) -> score by comparing each query with all rows."""
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in data
            if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    sizes = [len(v) for _, v in fine]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    fine = [(i, v) for i, v in fine if len(v) == size]
    out = {}
    for q, x in {(i, tuple(v)) for i, v in fine if i % step == 0}:
        near = sorted({(-float(np.dot(v, x)), i) for i, v in fine if i != q})[:k]
        out[q] = [i for _, i in near]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for rows in out.values():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
    return {q: [r[1] for r in rows] for q, rows in out.items()}


def test_chi_square():
    for x in (0.5, 3.0, 20.0):  # two degrees of freedom: an exponential law
        assert math.isclose(N.chi_square_cdf(x, 2), 1 - math.exp(-x / 2), rel_tol=1e-12)
    assert math.isclose(N.chi_square_cdf(N.chi_square_quantile(0.9, 10), 10), 0.9, rel_tol=1e-9)
    rng = np.random.default_rng(1)
    sums = (rng.standard_normal((200_000, 10)) ** 2).sum(axis=1)
    assert abs((sums < N.chi_square_quantile(0.97, 10)).mean() - 0.97) < 0.003


def test_projected_distances_follow_the_law():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 4000, 64))
    m = N.projection(64)
    gap = ((N.project(x, None, m) - N.project(y, None, m)) ** 2).sum(axis=1) / ((x - y) ** 2).sum(axis=1)
    assert abs(gap.mean() - N.PROJECTED) < 2.5  # one matrix for all pairs


ODD = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]),
       (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (40, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
       (9, [-1.0, 0.0]), (10, [0.0, 3.0]), (10, [0.0, 3.0]), (60, [1.0, 0.0]), (11, [-0.0, 1.0]), (80, None)]


def test_small_table_with_odd_rows(rows):
    df = rows(VEC, *[(i, v, 1, "clash", "clash") for i, v in ODD])
    assert found(N.nearest(df)) == exact(ODD)
    assert found(N.nearest(df, k=3)) == exact(ODD, 3)
    assert N.nearest(df.limit(0)).collect() == []
    assert N.nearest(rows(VEC, (20, [1.0], 1, None, None))).collect() == []


def test_ties_go_to_smaller_ids(rows):
    data = [(i, [1.0, float(i % 2)]) for i in range(100)]
    df = rows(VEC, *[(i, v, None, None, None) for i, v in data])
    assert found(N.nearest(df)) == exact(data)
    other = [(i, [1.0, float(i)]) for i in range(100)] + [(200, [1.0, 0.0])]  # different vectors, equal scores
    df = rows(VEC, *[(i, v, None, None, None) for i, v in other])
    assert found(N.nearest(df))[200] == exact(other)[200] == list(range(20))


@pytest.mark.parametrize("hot", [False, True])
def test_recall_over_several_cells(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "CELL_POINTS", 150)
    monkeypatch.setattr(N, "QUERY_BLOCK", 20)
    monkeypatch.setattr(N, "LEAF", 16)
    monkeypatch.setattr(N, "CHUNK_VALUES", 24 * 60)  # several chunks a cell
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 24)) * 1.5
    v = (centres[rng.integers(0, 8, 1500)] + rng.standard_normal((1500, 24))).astype(np.float32)
    if hot:
        v[::3] = v[0]  # a third of all rows is one vector
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    got = found(N.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)))
    want = exact(data)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * 20 * len(want)


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(N.query(spark, sf)), exact(data)
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_copies_follow_the_points(spark, monkeypatch):
    """Four times the points, queries and cells give four times the rows to shuffle; only a cell
    that many queries visit is copied, and a large cell is cut."""
    monkeypatch.setattr(N, "QUERY_BLOCK", 50)
    monkeypatch.setattr(N, "CHUNK_VALUES", 400)
    for cells in (10, 40):
        points = spark.range(100 * cells).selectExpr(f"id % {cells} AS cell", "id AS key", "array(1D, 2D) AS vec",
                                                     "id AS low")
        asks = spark.range(30 * cells).selectExpr(f"id % {cells} AS cell", "id AS key", "array(1D, 2D) AS vec",
                                                  "0D AS least")
        plan = N.layout(points, asks, 2)
        assert N.spread(points, plan).count() == 100 * cells
        assert N.asked_of(asks, plan).count() == 30 * cells
    hot = asks.union(spark.range(1000, 1100).selectExpr("3L", "id", "array(1D, 2D)", "0D"))
    plan = N.layout(points.union(spark.range(9000, 9300).selectExpr("5L", "id", "array(1D, 2D)", "id")), hot, 2)
    assert {r.cell: (r.blocks, r.chunks) for r in plan.collect() if (r.blocks, r.chunks) != (1, 1)} \
        == {3: (3, 1), 5: (1, 2)}
    sent = N.spread(points, plan)
    assert sent.where("cell = 3").count() == 300 and sent.where("cell <> 3").count() == 3900
    assert N.asked_of(hot, plan).where("cell = 5").count() == 60
