"""Tabled leaf contributions against Shapley values over all orders of the features."""

import itertools
import math

import numpy as np
import pytest

from keelson.operators.tree_shap import leaf_contributions, mask_table


def by_orders(value, cover, met):
    """Mean marginal change over all orders in which the features become known."""
    m = len(cover)

    def worth(known):
        return value * math.prod(met[i] if i in known else cover[i] for i in range(m))
    phi = [0.0] * m
    for order in itertools.permutations(range(m)):
        for at, j in enumerate(order):
            phi[j] += worth(set(order[:at + 1])) - worth(set(order[:at]))
    return [x / math.factorial(m) for x in phi]


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_mask_table_is_the_shapley_value(m):
    rng = np.random.default_rng(m)
    cover, value = rng.uniform(0.05, 0.95, m).tolist(), float(rng.normal())
    table = mask_table(value, cover)
    for mask in range(1 << m):
        met = [mask >> i & 1 for i in range(m)]
        assert table[:, mask] == pytest.approx(by_orders(value, cover, met), abs=1e-12)
        assert table[:, mask].sum() == pytest.approx(value * (all(met) - math.prod(cover)), abs=1e-12)


def test_rows_look_up_their_masks():
    """Bounds are open below and closed above; a missing value meets no condition; no rows give no rows."""
    rng = np.random.default_rng(7)
    leaves = []
    for _ in range(40):
        feats = rng.choice(6, rng.integers(1, 5), replace=False)
        leaves.append(([(int(f), *sorted(rng.integers(-3, 4, 2).astype(float) + [0, 0.5])) for f in feats], float(rng.normal()), rng.uniform(0.1, 0.9, len(feats)).tolist()))
    x = rng.integers(-3, 4, (50, 6)).astype(float)
    x[0, :] = np.nan
    got = leaf_contributions(x, [(c, mask_table(v, cover)) for c, v, cover in leaves])
    want = np.zeros_like(got)
    for r in range(len(x)):
        for conditions, value, cover in leaves:
            for (f, _, _), phi in zip(conditions, by_orders(value, cover, [int(lo < x[r, f] <= hi) for f, lo, hi in conditions])):
                want[r, f] += phi
    assert np.allclose(got, want, atol=1e-12)
    assert leaf_contributions(np.zeros((0, 6)), [(c, mask_table(v, cover)) for c, v, cover in leaves]).shape == (0, 6)
