import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecorpus.llm import hard_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, q string, part string"
MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("dims,high", [(64, 256), (1, 5), (0, 1), (200, 10_000), (64, 3 * 10**8), (7, 10**9)])
def test_products_by_remainders_are_exact(dims, high):
    r = np.random.default_rng(dims)
    a, b = r.integers(-high, high + 1, (30, dims)), r.integers(-high, high + 1, (50, dims))
    a[0], b[0] = high, -high
    moduli = op.primes(max(1, dims * high**2))
    got = op.scores(op.residues(a, moduli), op.residues(b, moduli), moduli)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]


def brute(rows, every, most):
    """The contract, row by row."""
    seen = {}
    for i, vector, label in rows:
        if None in (i, label, vector) or any(x is None or not np.isfinite(x) for x in vector):
            continue
        q = tuple(int(np.floor(256 * float(np.float32(x)))) for x in vector)
        seen[i, label, q] = None
    score = lambda u, v: sum(x * y for x, y in zip(u[2], v[2], strict=True))
    out = []
    for a in seen:
        if a[0] % every:
            continue
        others = [(score(a, b), b) for b in seen if b[0] != a[0] and len(b[2]) == len(a[2])]
        others.sort(key=lambda x: (-x[0], x[1][0]))
        for s, p in [x for x in others if x[1][1] == a[1]][:most]:
            near = [(t, n) for t, n in others if n[1] != a[1] and 80 * s <= 100 * t <= 100 * s]
            out += [(a[0], p[0], k + 1, n[0], s, t) for k, (t, n) in enumerate(near[:most])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*x, 1, 2, "q", "p") for x in rows], SCHEMA)
    return sorted(map(tuple, op.mine(df, every=4, **more).select(*MINED).collect()))


def test_odd_rows_ties_and_clashing_columns(spark):
    r = random.Random(1)
    vector = lambda n: [r.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(n)]
    rows = [(i, vector(6), r.randrange(3)) for i in range(90)]
    rows += [(100 + i, rows[4][1], i % 2) for i in range(40)]  # one vector again and again
    rows += rows[:8]  # repeated rows
    rows += [(8, vector(6), 1), (None, vector(6), 1), (200, None, 1), (204, vector(6), None), (208, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (212, [float("nan")] * 6, 1), (216, [float("inf")] * 6, 1)]
    rows += [(220 + i, vector(3), i % 2) for i in range(12)]  # of another size
    rows += [(240 + i, [], i % 2) for i in range(6)]
    rows += [(-4, vector(6), 0), (-5, vector(6), 1)]
    assert mined(spark, rows) == brute(rows, 4, 5)
    assert mined(spark, rows, positives=2, negatives=2) == brute(rows, 4, 2)


def test_many_blocks_parts_and_tiles(spark, monkeypatch):
    for name, n in (("BLOCK", 7), ("SMALL_PART", 20), ("TILE_ANCHORS", 3), ("TILE_ROWS", 5)):
        monkeypatch.setattr(op, name, n)
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(70)], r.randrange(2)) for i in range(160)]
    got = mined(spark, rows)
    assert got == brute(rows, 4, 5) and len(got) > 200


def test_large_components(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 1.0]) * r.randrange(1 << 20) for _ in range(4)], r.randrange(2)) for i in range(40)]
    assert mined(spark, rows) == brute(rows, 4, 5)
    assert mined(spark, [*rows, (44, [1e30, 0.0, 0.0, 0.0], 0)]) == brute(rows, 4, 5)  # its scores would be no longs


def test_few_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(4, [1.0], 1)]) == [] and mined(spark, [(4, [1.0], 1), (5, [1.0], 1)]) == []
    assert mined(spark, [(4, [1.0], 1), (5, [1.0], 1), (6, [0.9], 2)]) == [(4, 5, 1, 6, 65536, 58880)]
    df = spark.createDataFrame([(4, [1.0], 0), (5, [1.0], 1), (6, [0.9], 2)], "vec_id long, embedding array<float>, label int")
    assert op.mine(df, F.when(F.col("vec_id") == 4, 1).otherwise(F.col("label")), every=4).count() == 1
