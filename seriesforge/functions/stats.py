"""Tail probabilities without outside libraries, in plain Python for a few numbers at a time."""

from __future__ import annotations

import math


def chi2_sf(x: float, df: int) -> float:
    """P(X > x) of the chi-squared distribution: the regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:  # series for the lower part
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)  # continued fraction for the upper part
    h = d
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's distribution."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def pearson_p(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3:
        return 1.0
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
