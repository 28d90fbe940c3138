"""The hashed draws against hashlib, row by row, and the md5 a draw that the queries promise."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from keelson.operators import exposure as ex
from keelson.operators import hashed_draws as hd


@pytest.mark.parametrize("length", [0, 1, 3, 4, 7, 8, 20, 47, 52, 60])
def test_digest_numbers_are_the_digest(length):
    keys = np.random.default_rng(length).integers(0, 256, (9, length), dtype=np.uint8)
    for tail in (b"7|42", b"1234|42"):
        got = np.stack(hd.digest_numbers(keys, tail), axis=1)
        assert ["".join(f"{n:08x}" for n in row) for row in got] == [hashlib.md5(k.tobytes() + tail).hexdigest() for k in keys]


ROWS = [(1, 0.5, 10.0), (22, 0.25, 1.25), (22, 0.25, 1.25), (333, 1.0, 7.0), (4444, 0.0, 9.0), (55555, 1e-9, 1.0), (666666, 0.75, None),
        (7777777, None, 3.0), (None, 0.5, 2.0), (-8, 0.5, 4.0), (10 ** 17, 0.9, 0.005), (5, -0.5, 6.0), (6, 1.5, 0.5)]


def _by_rows(n_sims, seed, parts):
    """Every draw of every row from its text, as the SQL of the queries has it."""
    n, cents = defaultdict(int), defaultdict(int)
    for key, p, cost in ROWS:
        for d in range(n_sims):
            text = "|".join([*([] if key is None else [str(key)]), str(d // parts), str(seed)])
            k = d % parts
            if p is not None and int(hashlib.md5(text.encode()).hexdigest()[8 * k:8 * k + 8], 16) / 2 ** 32 < p:
                n[d] += 1
                cents[d] += 0 if cost is None else int(np.floor(cost * 100 + 0.5))
    return [(d, n[d], cents[d] / 100) for d in range(n_sims)]


@pytest.mark.parametrize("uniform,parts", [("md5_each", 1), ("md5", 4)])
def test_simulations_follow_every_draw(spark, uniform, parts):
    df = spark.createDataFrame(ROWS, "Order_ID long, Predicted_Delay_Probability double, Shipping_Cost_USD double")
    got = sorted(tuple(r) for r in ex.simulate(df, 500, 42, uniform=uniform).collect())
    assert got == _by_rows(500, 42, parts)
    assert ex.simulate(df.limit(0), 500, 42, uniform=uniform).count() == 0


def test_the_draws_are_spread_over_the_tasks(spark):
    """A table of one file does not leave all its draws to one task."""
    rows = spark.range(2000).selectExpr("id AS Order_ID", "0.5D AS Predicted_Delay_Probability", "1D AS _cents").coalesce(1)
    assert ex.md5_hits(rows, 500, 42, "Predicted_Delay_Probability", "Order_ID", 1, 7).rdd.getNumPartitions() == 7


def test_the_five_queries_take_an_md5_for_each_draw():
    import __spark_entry__ as entry
    for name in ("exposure_simulations", "exposure_tail", "exposure_markers", "exposure_tail_filtered", "board_exposure"):
        assert "CAST(sim_id AS VARCHAR) || '|42'" in entry.oracle_sql()[name], name
