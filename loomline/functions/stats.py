"""Distribution functions that the image has no library for, as small numpy-free helpers."""

from __future__ import annotations

import math
from statistics import NormalDist

norm_cdf, norm_ppf, norm_pdf = NormalDist().cdf, NormalDist().inv_cdf, NormalDist().pdf


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1), key=abs)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = out = 1 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            out += term
            if term < out * 1e-16:
                break
        return front * out
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for n in range(1, 2000):
        num, b = -n * (n - a), b + 2
        d, c = 1 / (num * d + b or 1e-300), b + num / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * out


def chi2_sf(x: float, k: float) -> float:
    return 1 - gamma_inc(k / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))
