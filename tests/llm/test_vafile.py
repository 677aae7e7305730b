import math
import random

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import vafile


def brute(rows, k, every):
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a in q:
        if i % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in q if j != i and len(b) == len(a))[:k]
        out += [(i, r + 1, j, -z) for r, (z, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k=5, every=50, **kw):
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, q string")
    return sorted(map(tuple, vafile.top_k(d, F.col("vec_id") % every == 0, k).collect()))


def test_random_ties_and_blocks(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(400)]
    rows += [(i + 400, [r.choice((-1, 0, 1)) / 4 for _ in range(16)]) for i in range(150)] + [(600 + i, rows[0][1]) for i in range(9)]
    want = brute(rows, 5, 10)
    assert run(spark, rows, every=10) == want
    monkeypatch.setattr(vafile, "BLOCK", 100)
    monkeypatch.setattr(vafile, "QUERIES", 9)
    assert run(spark, rows, every=10) == want


def test_edges(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows = bad + [(0, [0.1, -0.1]), (7, [0.5, 0.2]), (8, [0.5, 0.2]), (9, [1.0, 2.0, 3.0]), (50, [1e6, -3e6]), (51, [2e6, 7e6])]
    assert run(spark, rows) == brute(rows, 5, 50)
    assert run(spark, bad) == [] and run(spark, []) == []


def test_bounds_hold():
    import numpy as np

    g = np.random.default_rng(1)
    x, q = np.floor(g.normal(0, 40, (500, 12))), np.floor(g.normal(0, 40, (20, 12)))
    assert (vafile.Approximation(x).upper(q) >= q @ x.T).all()


def test_large_components_take_part(spark):
    big = float(1 << 23)  # 256 times it is 2^31
    rows = [(0, [big, 1.0]), (1, [big, -1.0]), (2, [1.0, 0.0]), (3, [-big, 2.0]), (4, [float("inf"), 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in vafile.top_k(d, F.col("vec_id") == 0, 3).orderBy("rank").collect()]
    assert got == [(1, 2**62 - 2**16), (2, 2**39), (3, -(2**62) + 2**17)]
    # terms of 2^80 that cancel: the kth best is told by far smaller ones
    r = np.random.default_rng(5)
    x = np.column_stack([np.full(400, 2.0**40), np.full(400, 2.0**40), r.integers(-500, 500, 400)])
    q = np.array([[2.0**40, -(2.0**40), 3.0]])
    want = sorted(((3 * int(v), -i) for i, v in enumerate(x[:, 2])), reverse=True)[:5]
    assert vafile.search(np.arange(400), x, np.array([-1]), q, 5) == [(0, -i, v) for v, i in want]


def test_repeated_query_rows_have_results_of_their_own(spark):
    rows = [(50, [0.5, 0.0]), (50, [0.5, 0.0]), (50, [0.0, 0.5]), *((i, [i / 10, 1.0 - i / 10]) for i in range(1, 9))]
    got = run(spark, rows, 3)
    assert got == brute(rows, 3, 50) and len(got) == 9 and {r[1] for r in got} == {1, 2, 3}
    assert [r[2] for r in got if r[1] == 1] == [1, 8, 8]
