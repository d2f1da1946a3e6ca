"""How many tables the customers of one dish take in a Pitman-Yor restaurant, drawn from the exact law.

Given the weight w of opening a table for the dish, seatings of its c customers have probabilities in proportion to
w ** tables times the product over tables of (1 - d)(2 - d)..(size - 1 - d). Summed over seatings with t tables that is
S(c, t) w ** t, where S are generalised Stirling numbers: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t). The law is
log-concave in t, so a draw costs the same for ten customers and for ten milliards.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Up to so many customers the numbers come from the recursion itself; beyond, from a series or a saddle point.
EXACT, TERMS = 512, 120
#: Up to so many customers all numbers of tables are weighed at once.
DENSE = 24


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0."""
    x = np.asarray(x, float)
    shift = np.maximum(0, np.ceil(10 - x))
    low = np.zeros_like(x)
    for k in range(int(shift.max(initial=0))):
        low += np.where(k < shift, np.log(np.where(k < shift, x + k, 1)), 0)
    y = x + shift
    z = 1 / (y * y)
    tail = (1 / 12 + z * (-1 / 360 + z * (1 / 1260 + z * (-1 / 1680 + z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail - low


@cache
def table(d: float) -> np.ndarray:
    """log S(c, t) for c, t up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(EXACT):
            stay = np.where(c - d * t > 0, np.log(c - d * t), -np.inf) + out[c]
            out[c + 1] = np.logaddexp(stay, np.r_[-np.inf, out[c, :-1]])
    return out


def _series(c: np.ndarray, t: np.ndarray, d: float, terms: int = TERMS) -> np.ndarray:
    """log of [x ** c] (1 - (1 - x) ** d) ** t by the binomial series; for t well under c ** d, where its terms fall fast."""
    j = np.arange(1, terms + 1)
    j = j[np.abs(np.sin(np.pi * d * j)) > 1e-9]
    c, t = c[:, None].astype(float), t[:, None].astype(float)
    alive = j <= t
    choose = np.where(alive, log_gamma(t + 1) - log_gamma(j + 1.0) - log_gamma(np.where(alive, t - j + 1, 1)), -np.inf)
    size = choose + log_gamma(c - d * j) + log_gamma(d * j + 1) - log_gamma(c + 1)
    sign = -((-1.0) ** j) * np.sin(np.pi * d * j) / np.pi
    top = size.max(axis=1, keepdims=True)
    return np.log((np.exp(size - top) * sign).sum(axis=1)) + top[:, 0]


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same by a saddle point with its first correction; for many tables."""
    # tilt: d (1 - y) y ** (d - 1) / (1 - y ** d) = c / t, for y = exp(u) in (0, 1), falling in y
    want = np.log(c / t)
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)
    for _ in range(80):
        u = (low + high) / 2
        got = np.log(d) + np.log(-np.expm1(u)) + (d - 1) * u - np.log(-np.expm1(d * u))
        low, high = np.where(got > want, u, low), np.where(got > want, high, u)
    u = (low + high) / 2
    y, x = np.exp(u), -np.expm1(u)
    # cumulants of one table's size under the tilt, by the derivatives of log G along log x
    g = -np.expm1(d * u)
    g1 = d * y ** (d - 1)
    g2 = -d * (d - 1) * y ** (d - 2)
    g3 = d * (d - 1) * (d - 2) * y ** (d - 3)
    g4 = -d * (d - 1) * (d - 2) * (d - 3) * y ** (d - 4)
    m1 = x * g1 / g
    m2 = (x * g1 + x**2 * g2) / g
    m3 = (x * g1 + 3 * x**2 * g2 + x**3 * g3) / g
    m4 = (x * g1 + 7 * x**2 * g2 + 6 * x**3 * g3 + x**4 * g4) / g
    k2 = m2 - m1**2
    k3 = m3 - 3 * m2 * m1 + 2 * m1**3
    k4 = m4 - 4 * m3 * m1 - 3 * m2**2 + 12 * m2 * m1**2 - 6 * m1**4
    more = (k4 / k2**2 / 8 - 5 * k3**2 / k2**3 / 24) / t
    return t * np.log(g) - c * np.log(x) - 0.5 * np.log(2 * np.pi * t * k2) + np.log1p(np.clip(more, -0.5, 0.5))


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) for 1 <= t <= c."""
    c, t = np.broadcast_arrays(np.asarray(c, np.int64), np.asarray(t, np.int64))
    out = np.empty(c.shape)
    near = c <= EXACT
    out[near] = table(d)[c[near], t[near]]
    share = t / c.astype(float) ** d  # the ratio of the series' terms, roughly
    fast, slow = ~near & (share <= 0.25), ~near & (share > 0.25) & (share <= 1.9)
    for part, f in ((fast, lambda a, b, d: _series(a, b, d, 20)), (slow, _series), (~near & (share > 1.9), _saddle)):
        if part.any():
            a, b = c[part].astype(float), t[part].astype(float)
            full = a == b  # a table each: one way
            got = f(a, b, d) + log_gamma(a + 1) - log_gamma(b + 1) - b * np.log(d)
            out[part] = np.where(full, 0.0, got)
    return out


def _dense(c: np.ndarray, log_w: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    out = np.ones(len(c), np.int64)
    t = np.arange(1, DENSE + 1)
    for at in range(0, len(c), 1 << 16):
        part = slice(at, at + (1 << 16))
        f = table(d)[c[part], 1 : DENSE + 1] + log_w[part, None] * t
        p = np.cumsum(np.exp(f - f.max(axis=1, keepdims=True)), axis=1)
        out[part] = 1 + (p < rng.random((len(p), 1)) * p[:, -1:]).sum(axis=1)
    return out


def _rejected(c: np.ndarray, log_w: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Draws from the log-concave law under a flat top with geometric tails."""

    def f(t, k):
        inside = (t >= 1) & (t <= c[k])
        return np.where(inside, log_stirling(c[k], np.clip(t, 1, c[k]), d) + t * log_w[k], -np.inf)

    every = np.arange(len(c))
    low, high = np.ones(len(c), np.int64), c.copy()  # the mode, by halving
    while (low < high).any():
        mid = (low + high) // 2
        up = f(np.minimum(mid + 1, c), every) > f(mid, every)
        open_ = low < high
        low, high = np.where(open_ & up, mid + 1, low), np.where(open_ & ~up, mid, high)
    mode = low
    top = f(mode, every)
    bend = np.clip(2 * top - f(mode - 1, every) - f(mode + 1, every), 1e-12, 1.0)  # outside: infinite
    step = np.maximum(1, np.round(1 / np.sqrt(bend))).astype(np.int64)
    right, left = mode + step, mode - step
    a, b = f(right, every) - top, f(left, every) - top
    fall_a = np.where(right < c, f(np.minimum(right + 1, c), every) - top - a, -50.0)
    fall_b = np.where(left > 1, f(np.maximum(left - 1, 1), every) - top - b, -50.0)
    fall_a, fall_b = np.minimum(np.where(np.isfinite(a), fall_a, -50.0), -1e-9), np.minimum(np.where(np.isfinite(b), fall_b, -50.0), -1e-9)
    tail_a, tail_b = np.exp(a) / -np.expm1(fall_a), np.exp(b) / -np.expm1(fall_b)
    middle = (right - left - 1).astype(float)
    out = np.zeros(len(c), np.int64)
    wait = every
    while len(wait):
        u = rng.random(len(wait)) * (middle + tail_a + tail_b)[wait]
        g = np.log(rng.random(len(wait)))
        in_middle, in_right = u < middle[wait], u < (middle + tail_a)[wait]
        x_right, x_left = right[wait] + np.floor(g / fall_a[wait]), left[wait] - np.floor(g / fall_b[wait])
        x = np.where(in_middle, left[wait] + 1 + np.floor(u), np.where(in_right, x_right, x_left))
        x = np.clip(x, 0, c[wait] + 1).astype(np.int64)
        over = np.where(in_middle, 0.0, np.where(in_right, a[wait] + fall_a[wait] * (x - right[wait]), b[wait] + fall_b[wait] * (left[wait] - x)))
        good = np.log(rng.random(len(wait))) < f(x, wait) - top[wait] - over
        out[wait[good]] = x[good]
        wait = wait[~good]
    return out


def tables(c: np.ndarray, w: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of c >= 1 customers each, where a table weighs w: each dish's customers are all seated anew."""
    c, log_w = np.asarray(c, np.int64), np.log(np.maximum(np.asarray(w, float), 1e-300))
    out = np.ones(len(c), np.int64)
    few = c <= DENSE
    out[few] = _dense(c[few], log_w[few], d, rng)
    out[~few] = _rejected(c[~few], log_w[~few], d, rng)
    return out
