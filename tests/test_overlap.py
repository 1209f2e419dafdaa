"""Assignment by overlap: the same as by trying every region, with few looks a text."""

import numpy as np
import pytest

from cellarium.operators import classify


def area(t, r, w, h):
    return max(0.0, min(t[0], r[0]) + w - max(t[0], r[0])) * max(0.0, min(t[1], r[1]) + h - max(t[1], r[1]))


@pytest.mark.parametrize("kind", ["rows", "anywhere", "same"])
def test_overlap_is_that_of_every_region_tried(kind):
    rng = np.random.default_rng(1)
    make = {"rows": lambda n: (rng.integers(-9000, 9000, n) / 100 % 100, rng.integers(0, 50, n) * 1.0), "anywhere": lambda n: (rng.uniform(-50, 50, n), rng.uniform(-30, 30, n)), "same": lambda n: (np.full(n, 3.0), np.full(n, 4.0))}[kind]
    (x, y), (rx, ry), k = make(300), make(200), rng.permutation(200)
    best, which = classify.most_overlap(x, y, rx, ry, k, 20.0, 10.0)
    for i in range(300):
        all_ = [(-area((x[i], y[i]), (rx[j], ry[j]), 20.0, 10.0), k[j]) for j in range(200)]
        a, n = min(all_)
        assert best[i] == -a and (a == 0 or which[i] == n)


def test_a_crowded_cell_is_searched_not_paired(spark, monkeypatch):
    """100,000 texts and 20,000 regions in one cell are 2 * 10^9 pairs, and several blocks."""
    monkeypatch.setattr(classify, "BLOCK", 30_000)
    t = spark.range(100_000).selectExpr("id t", "(id * 7919 % 100003) / 100003D * 20 x", "(id % 10) * 1D y")
    r = spark.range(20_000).selectExpr("id k", "(id * 104729 % 20011) / 20011D * 20 x", "(id % 10) * 1D y")
    got = classify.overlap_argmax(t, r, 20.0, 10.0).toPandas()
    assert len(got) == 100_000 and got["t"].is_unique and (got["a"] > 190).all()
