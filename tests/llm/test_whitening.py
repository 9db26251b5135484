"""Exact scatter by bit planes, and whitening against a plain computation."""

import math
import random

import numpy as np
import pytest

from quire.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x int, n long, whitened string"


@pytest.mark.parametrize("high", [1, 2, 1000, 1 << 40])
def test_counts_of_planes_are_exact(high):
    y = np.random.default_rng(3).integers(0, high, (130, 5))
    bits = [max(int(c.max()).bit_length(), 1) for c in y.T]
    counts = np.zeros((sum(bits), sum(bits)), "i8")
    for at in (0, 70):
        W.count_pairs(W.planes(y[at : at + 70], bits), counts)
    exact = y.astype(object)
    assert (W.weighed(counts, bits, 130) == exact.T @ exact).all()


def test_equals_a_plain_computation(spark):
    r = random.Random(5)
    rows = [(i // 2, [r.gauss(0, 1 + k) + (k == 3) * r.random() for k in range(12)], 1, 2, "s") for i in range(333)]
    got = W.op12_embedding_whitening(spark.createDataFrame(rows, SCHEMA)).toPandas()
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v, *_ in rows])
    n, sums = len(x), x.sum(0)
    deviations = sorted(int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))) for v in x)
    assert sorted(got[got["component"] == 1]["deviation"]) == deviations and set(got["n"]) == {n}
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    for k in range(8):
        own = got[got["component"] == k + 1]
        plain = (x - x.mean(0)) @ vectors[:, -1 - k] / math.sqrt(values[-1 - k])
        assert np.allclose(sorted(abs(own["whitened"])), sorted(abs(plain)), atol=1e-9)
        assert abs(own["explained"].iloc[0] / (values[-1 - k] / values.sum()) - 1) < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_vectors_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, []), (5, [inf, 0.0]), (6, [1.0]), (7, [1e30, 1.0])]
    good = [(None, [1.0, 2.0]), (9, [3.0, 2.5]), (9, [2.0, -1.0])]
    frame = lambda rows: spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], SCHEMA)
    both, alone = (W.op12_embedding_whitening(frame(rows)).collect() for rows in (bad + good, good))
    assert sorted(map(str, both)) == sorted(map(str, alone)) and len(alone) == 6
    assert W.op12_embedding_whitening(frame(bad[:5])).count() == 0 == W.op12_embedding_whitening(frame([])).count()


def test_no_variance_and_huge_numbers(spark):
    same = W.op12_embedding_whitening(spark.createDataFrame([(i, [1.0, 2.0], 1, 2, "s") for i in range(3)], SCHEMA)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] is None for r in same)
    rows = [(i, [float(i), 1e14 * (i % 3)], 1, 2, "s") for i in range(50)]
    wide = W.op12_embedding_whitening(spark.createDataFrame(rows, SCHEMA)).collect()
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v, *_ in rows]
    sums = [sum(c) for c in zip(*x)]
    assert {(r["vec_id"], r["deviation_exact"]) for r in wide} == {(i, str(sum((50 * a - s) ** 2 for a, s in zip(v, sums)))) for i, v in enumerate(x)}
    assert all(r["deviation"] is None for r in wide)
