"""The exact delayed count against brute-force convolution and simulation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import count_distribution as cd
from keelson.operators import exposure as ex


def brute_force(ps):
    mass = np.ones(1)
    for p in ps:
        mass = np.convolve(mass, [1 - p, p])
    return mass


@pytest.mark.parametrize("direct", [0, 1 << 22])
def test_counts_equal_a_draw_by_draw_convolution(monkeypatch, direct):
    monkeypatch.setattr(cd, "DIRECT", direct)
    rng = random.Random(9)
    groups = [(rng.choice([0.0, 0.03, 0.25, 0.5, 0.93, 1.0, rng.random()]), rng.randint(1, 60)) for _ in range(25)]
    got, want = cd.convolve(groups), brute_force([p for p, n in groups for _ in range(n)])
    full = np.zeros(len(want))
    full[got.first:got.first + len(got.mass)] = got.mass
    assert np.abs(full - want).max() < 1e-12
    for q in (0.01, 0.5, 0.95, 0.99):
        assert got.quantile(q) == int(np.searchsorted(np.cumsum(want), q * want.sum()))
    mean, dev = got.moments()
    assert abs(mean - sum(p * n for p, n in groups)) < 1e-9 and abs(dev ** 2 - sum(p * (1 - p) * n for p, n in groups)) < 1e-7


def test_length_follows_the_square_root():
    c = cd.convolve([(0.2, 10 ** 9), (0.6, 10 ** 9)])
    mean, dev = c.moments()
    assert len(c.mass) < 2_000_000 and abs(mean / 8e8 - 1) < 1e-9 and abs(dev ** 2 / 4e8 - 1) < 1e-6


def test_summary_of_odd_tables(spark):
    df = spark.createDataFrame([(i, 0.5 if i % 2 else None) for i in range(11)], "Order_ID long, Predicted_Delay_Probability double")
    r = cd.delayed_count_summary(df, {"p95": 0.95}).first()
    assert (r.groups, r.mean, r.p95) == (1, 2.5, 4)
    assert tuple(cd.delayed_count_summary(df.limit(0), {"p95": 0.95}).first()) == (0, 0.0, 0.0, 0)


def test_thresholds_decide_as_numbers_do(spark):
    rows = [(p, h) for p in (0.0, 1e-12, 0.25, 1 / 3, 0.9999999999, 1.0) for h in ("00000000", "00000001", "3fffffff", "40000000", "55555555", "55555556", "ffffffff")]
    got = spark.createDataFrame(rows, "p double, h string").select("p", "h", (F.col("h") < ex.hex_threshold(F.col("p"))).alias("hit")).collect()
    assert all(r.hit == (int(r.h, 16) / 2 ** 32 < r.p) for r in got)
