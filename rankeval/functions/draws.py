"""Random draws that depend on named counters only: whoever asks again, in whatever task, gets the same numbers.

``uniforms`` hashes a key and a counter.  ``hypergeometric`` draws by rejection from the exact law at any size: the law is
log-concave, so its value at the mode gives an envelope that accepts every fifth attempt or more, and its values come
from saddle-point expansions that keep their accuracy where factorials have lost theirs.
"""

from __future__ import annotations

import math

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SMALL = 16
# error of Stirling's formula without corrections, for numbers below _SMALL
_ERRORS = np.array([0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, _SMALL)])


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(*parts: int | np.ndarray) -> np.ndarray:
    """A key for each combination of the parts (integers or arrays of them, broadcast)."""
    key = np.zeros((), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            value = np.asarray(p, np.int64).astype(np.uint64)
            key = _scramble((key ^ value) * np.uint64(0xD1342543DE82EF95) + _STEP)
    return key


def uniforms(key: np.ndarray, counter: int) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    with np.errstate(over="ignore"):
        bits = _scramble(key + _STEP * np.uint64(counter + 1))
    return ((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """ln n! less Stirling's formula."""
    big = np.maximum(n, _SMALL)
    r = 1 / (big * big)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / big
    return np.where(n < _SMALL, _ERRORS[np.minimum(n, _SMALL - 1).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x, without cancellation where the two are close."""
    v = (x - mean) / (x + mean)
    total, power = (x - mean) * v, 2 * x * v
    for j in range(1, 12):
        power = power * v * v
        total = total + power / (2 * j + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / mean), 0.0) + mean - x
    return np.where(np.abs(v) < 0.1, total, plain)


def _log_binomial(k: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Log of the binomial law, for 0 <= k <= n and 0 < p, q < 1 with p + q = 1."""
    inner = (k > 0) & (k < n)
    x, m = np.where(inner, k, 1.0), np.where(inner, n, 2.0)
    core = _stirling_error(m) - _stirling_error(x) - _stirling_error(m - x) - _deviance(x, m * p) - _deviance(m - x, m * q)
    core = core + 0.5 * np.log(m / (2 * np.pi * x * (m - x)))
    return np.where(inner, core, np.where(k > 0, n * np.log(p), n * np.log1p(-p)))


def log_hypergeometric(k: np.ndarray, good: np.ndarray, bad: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Log of the chance of ``k`` good ones among ``take`` drawn without replacement; 0 < take < good + bad, ``k`` in reach."""
    k, good, bad, take = (np.asarray(a, float) for a in (k, good, bad, take))
    n = good + bad
    p, q = take / n, (n - take) / n
    return _log_binomial(k, good, p, q) + _log_binomial(take - k, bad, p, q) - _log_binomial(take, n, p, q)


def hypergeometric(good: np.ndarray, bad: np.ndarray, take: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many of ``take`` drawn without replacement are good, one exact draw per element; counts below 2^53."""
    good, bad, take, key = (a.ravel() for a in np.broadcast_arrays(good, bad, take, key))
    lo, hi = np.maximum(0, take - bad), np.minimum(take, good)
    out = lo.copy()
    open_ = np.flatnonzero(lo < hi)
    if not len(open_):
        return out
    g, b, t, key, lo, hi = good[open_], bad[open_], take[open_], key[open_], lo[open_], hi[open_]
    mode = np.clip(np.floor((t + 1.0) * (g + 1.0) / (g + b + 2.0)).astype(np.int64), lo, hi)
    top = log_hypergeometric(mode, g, b, t)
    peak = np.exp(top)
    w = 1 + peak / 2
    at = np.arange(len(open_))
    attempt = 0
    while len(at):
        u, v, side, accept = (uniforms(key[at], 4 * attempt + i) for i in range(4))
        away = np.where(u <= w[at] / (1 + w[at]), v * w[at], w[at] - np.log(v)) / peak[at]
        step = np.floor(np.minimum(away, 2.0**53) + 0.5).astype(np.int64)
        x = mode[at] + np.where(side < 0.5, -step, step)
        inside = (x >= lo[at]) & (x <= hi[at])
        held = np.where(inside, x, mode[at])
        ratio = np.exp(log_hypergeometric(held, g[at], b[at], t[at]) - top[at])
        taken = inside & (accept * np.minimum(1.0, np.exp(w[at] - peak[at] * away)) <= ratio)
        out[open_[at[taken]]] = x[taken]
        at = at[~taken]
        attempt += 1
    return out


def share_out(pool: np.ndarray, take: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What ``take`` items drawn without replacement hold of each kind: ``pool`` has the counts of the kinds along its last axis,
    ``take`` and ``key`` its other axes."""
    out = np.zeros_like(pool)
    take = np.broadcast_to(take, pool.shape[:-1]).copy()
    rest = pool.sum(-1)
    for kind in range(pool.shape[-1]):
        rest = rest - pool[..., kind]
        got = hypergeometric(pool[..., kind], rest, take, stream(kind, key.view(np.int64))).reshape(take.shape)
        out[..., kind] = got
        take = take - got
    return out
