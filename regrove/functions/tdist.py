"""Student's t and the normal law: distribution function and quantiles, without scipy."""

from __future__ import annotations

import math

#: Beyond so many degrees of freedom the normal law is closer than lgamma's rounding.
NORMAL_DF = 1e7


def _continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz's method for the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 20_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _continued_fraction(a, b, x) / a
    return 1.0 - front * _continued_fraction(b, a, 1.0 - x) / b


def p_two_sided(t: float, df: float) -> float:
    """The probability that |T| is at least |t|."""
    if math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    if df > NORMAL_DF:
        return math.erfc(abs(t) / math.sqrt(2.0))
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection on the distribution function."""
    if not 0.0 < p < 1.0:
        return math.inf if p >= 1.0 else -math.inf
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    tail, low, high = 2.0 * (1.0 - p), 0.0, 1.0
    while p_two_sided(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if p_two_sided(middle, df) > tail else (low, middle)
    return (low + high) / 2.0
