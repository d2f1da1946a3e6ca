import math

import numpy as np
import pytest
from sedge.llm import seating


def numbers(n, d):
    """log S(n, t) for t = 0..n, by the recursion."""
    out = np.full(n + 2, -np.inf)
    out[0] = 0.0
    t = np.arange(n + 2)
    with np.errstate(all="ignore"):
        for c in range(n):
            out = np.logaddexp(np.where(c > d * t, np.log(c - d * t), -np.inf) + out, np.r_[-np.inf, out[:-1]])
    return out[: n + 1]


def test_gamma():
    x = np.array([1e-3, 0.2, 1, 1.5, 7.3, 20, 1e5, 1e9])
    assert np.allclose(seating.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("n", [7, 300, 600, 2500])
def test_numbers_against_the_recursion(n):
    want, t = numbers(n, 0.8), np.unique(np.r_[1, 2, 3, np.linspace(1, n, 60).astype(int), n - 1, n])
    got = seating.log_stirling(np.full(len(t), n), t, 0.8)
    assert np.abs(got - want[t]).max() < 6e-3


@pytest.mark.parametrize("n", [1, 2, 3, 9, 24, 25, 60, 500, 2500])
@pytest.mark.parametrize("w", [1e-4, 0.3, 20.0, 3000.0])
def test_draws_have_the_exact_law(n, w):
    """Mean and spread of many draws are those of the law itself."""
    p = numbers(n, 0.8)[1:] + np.arange(1, n + 1) * math.log(w)
    p = np.exp(p - p.max())
    p /= p.sum()
    t = np.arange(1, n + 1)
    mean = (p * t).sum()
    sd = math.sqrt((p * (t - mean) ** 2).sum())
    k = 6000
    got = seating.tables(np.full(k, n), np.full(k, w), 0.8, np.random.default_rng(5))
    assert got.min() >= 1 and got.max() <= n
    assert abs(got.mean() - mean) < 5 * sd / math.sqrt(k) + 2e-3 * sd + 1e-9 and abs(got.std() - sd) < 0.06 * sd + 0.02


def test_huge_restaurants():
    got = seating.tables(np.array([10**6, 10**9, 10**11]), np.array([5.0, 1e4, 1e-3]), 0.8, np.random.default_rng(1))
    assert (got >= 1).all() and (got <= [10**6, 10**9, 10**11]).all()
