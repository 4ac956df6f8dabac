"""Random class sizes drawn on the histogram."""

import time
from collections import Counter
from itertools import product
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagwise.operators import resample


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (1, 1, 1), (30, 3, 20), (3, 40, 11), (9, 9, 18), (6, 0, 3), (4, 9, 0)])
def test_hypergeometric_inverts_its_law(good, bad, draws):
    n = 20_000
    got = Counter(resample.hypergeometric(good, bad, draws, (i + 0.5) / n) for i in range(n))
    for k in range(max(0, draws - bad), min(good, draws) + 1):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(got[k] / n - p) <= 1.01 / n
    assert set(got) <= set(range(max(0, draws - bad), min(good, draws) + 1))


def test_hypergeometric_of_large_pools():
    rng = np.random.default_rng(4)
    good, bad, draws = 40_000_000, 260_000_000, 90_000_000
    mine = np.array([resample.hypergeometric(good, bad, draws, x) for x in rng.random(400)])
    theirs = rng.hypergeometric(good, bad, draws, 4000)
    assert abs(mine.mean() - theirs.mean()) < 5 * theirs.std() / 20
    assert 0.85 < mine.std() / theirs.std() < 1.15
    start = time.time()
    middle = resample.hypergeometric(10 ** 12, 3 * 10 ** 12, 10 ** 12, 0.5)
    assert abs(middle - 25 * 10 ** 10) < 10 and time.time() - start < 20


def test_counts_follow_the_pool(spark):
    """Bags' counts of three classes against all draws of their tokens."""
    sizes, total, bags = [3, 2, 4], 5, 3000
    rows = [(b, label, s, 100, 0, "cut") for b in range(bags) for label, s in enumerate(sizes)]
    drawn = spark.createDataFrame(rows, "bag_id int, label int, s long, n long, cut int, mode string")
    out = resample._draw_large(drawn, total, 7).groupBy("bag_id").agg(
        F.sort_array(F.collect_list(F.struct("label", "_k"))).alias("x")).collect()
    got = Counter(tuple(k for _, k in r.x) for r in out)
    law = {ks: comb(3, ks[0]) * comb(2, ks[1]) * comb(4, ks[2]) / comb(9, total)
           for ks in product(range(4), range(3), range(5)) if sum(ks) == total}
    assert set(got) <= set(law)
    chi = sum((got[ks] - bags * p) ** 2 / (bags * p) for ks, p in law.items())
    assert chi < len(law) - 1 + 5 * (2 * (len(law) - 1)) ** 0.5


def test_sizes_reach_the_total_without_tokens(spark, monkeypatch):
    train = spark.createDataFrame([(i, i % 9) for i in range(900)], "id long, label int")
    monkeypatch.setattr(resample, "rank_by_key", None)      # the token pool's rank
    out = resample.random_bag_sizes(train, 3, 250, seed=2, cut_std=60, draw="histogram")
    rows = out.collect()
    assert Counter(r.bag_id for r in rows) == {0: 9, 1: 9, 2: 9}
    assert all(0 <= r["_k"] <= r.n for r in rows)
    assert {b: sum(r["_k"] for r in rows if r.bag_id == b) for b in range(3)} == {0: 250, 1: 250, 2: 250}
    with pytest.raises(ValueError):
        resample.random_bag_sizes(train, 3, 250, draw="other")
