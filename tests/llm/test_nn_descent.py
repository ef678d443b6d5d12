import numpy as np

from codecorpus.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, top, every):
    own = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    out = {}
    for q in own:
        if q % every == 0:
            near = sorted(((-float(own[q] @ own[i]), i) for i in own if i != q))[:top]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_recall_and_order(spark):
    g = np.random.default_rng(7)
    x = g.normal(size=(900, 24)).astype(np.float32)
    x *= g.uniform(0.5, 2, size=(900, 1)).astype(np.float32)
    x[500:540] = x[17]  # more copies than an answer holds
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    want = brute(rows, 20, 20)
    got: dict = {}
    for r in nn_descent.nearest(table(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, 21)) and all(r.vec_id != q for r in found)
        assert [(r.score, -r.vec_id) for r in found] == sorted(((r.score, -r.vec_id) for r in found), reverse=True)
        for r in found:
            assert abs(r.score - float(x[q].astype(float) @ x[r.vec_id].astype(float))) < 1e-12
        hits += len({r.vec_id for r in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    assert [r.vec_id for r in got[500]] == [i for i, _ in want[500]]


def test_few_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (20, [-1.0, 2.0], 1), (40, [0.0, 0.0], 1), (0, [1.0, 0.0], 1)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nn_descent.nearest(table(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 1, 0.5), (0, 3, 20, -1.0), (20, 1, 1, 0.5), (20, 2, 0, -1.0), (20, 3, 7, -1.0)]
    assert nn_descent.nearest(table(spark, rows[:1])).count() == 0
    assert nn_descent.nearest(table(spark, [])).count() == 0 == nn_descent.nearest(table(spark, rows[2:4])).count()
