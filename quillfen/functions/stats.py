"""Student-t probabilities and two-sample power on driver scalars."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def t_critical(alpha: float, df: float) -> float:
    """Two-sided critical value."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > alpha:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if t_two_sided(middle, df) > alpha else (low, middle)
    return (low + high) / 2.0


def correlation_p_value(r: float | None, n: int) -> float:
    if r is None or r != r or n < 3:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def _normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def two_sample_power(effect: float, n1: int, n2: int, alpha: float = 0.05) -> float:
    """Power of the two-sided two-sample t test: a noncentral t integrated over the pooled deviation."""
    df = n1 + n2 - 2
    shift = effect * math.sqrt(n1 * n2 / (n1 + n2))
    limit = t_critical(alpha, df)
    half = df / 2.0
    log_scale = math.log(2.0) + half * math.log(half) - math.lgamma(half)
    width = 12.0 / math.sqrt(2.0 * df)
    low, high = max(1e-9, 1.0 - width), 1.0 + width
    steps = 4000
    step = (high - low) / steps
    total = 0.0
    for i in range(steps + 1):
        s = low + i * step
        density = math.exp(log_scale + (df - 1) * math.log(s) - half * s * s)
        tails = _normal_cdf(shift - limit * s) + _normal_cdf(-limit * s - shift)
        total += density * tails * (1 if i in (0, steps) else 4 if i % 2 else 2)
    return min(1.0, total * step / 3.0)
