"""Incomplete gamma and beta functions on whole batches, for exact tails of counts of any size."""
from __future__ import annotations

import math

import numpy as np

ROUNDS = 200_000
EPS = 1e-16
TINY = 1e-300
lgamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x) for a > 0, x >= 0: a series below a + 1, a continued fraction above."""
    out = np.zeros_like(a)
    scale = np.where(x > 0, np.exp(a * np.log(np.maximum(x, TINY)) - x - lgamma(a)), 0.0)
    low = (x < a + 1) & (x > 0)
    if low.any():
        aa, xx = a[low], x[low]
        term = 1 / aa
        total, n = term.copy(), 0
        while n < ROUNDS and (term > total * EPS).any():
            n += 1
            term = term * xx / (aa + n)
            total += term
        out[low] = total * scale[low]
    high = x >= a + 1
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1 - aa
        c, d = np.full_like(b, 1 / TINY), 1 / b
        h, n = d.copy(), 0
        while n < ROUNDS:
            n += 1
            an = -n * (n - aa)
            b = b + 2
            d = 1 / _away(an * d + b)
            c = _away(b + an / c)
            step = c * d
            h *= step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - h * scale[high]
    return np.clip(out, 0.0, 1.0)


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) for a, b > 0 and 0 < x < 1, by its continued fraction on the side where that is quick."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c, d = np.ones_like(p), 1 / _away(1 - (p + q) * y / (p + 1))
    h, m = d.copy(), 0
    while m < ROUNDS:
        m += 1
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / _away(1 + even * d), _away(1 + even / c)
        h *= d * c
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / _away(1 + odd * d), _away(1 + odd / c)
        h *= d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return np.clip(np.where(swap, 1 - front * h, front * h), 0.0, 1.0)


def _away(v: np.ndarray) -> np.ndarray:
    """v, kept away from zero."""
    return np.where(np.abs(v) < TINY, TINY, v)
