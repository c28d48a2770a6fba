"""Distribution functions behind p-values: incomplete gamma and beta, Kolmogorov, normal."""

from __future__ import annotations

import math

#: Half the width of a 95 % interval of the standard normal distribution.
NORMAL_95 = 1.959963984540054


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: int) -> float:
    return gamma_upper(df / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_sf(x: float) -> float:
    """Limit distribution of sqrt(n) D; the asymptotic p-value of the two-sample test."""
    if x < 1e-3:
        return 1.0
    if x < 1.18:
        y = math.exp(-(math.pi**2) / (8 * x * x))
        return 1 - math.sqrt(2 * math.pi) / x * sum(y ** ((2 * k - 1) ** 2) for k in range(1, 6))
    return 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 60))


def correlation_p(rho: float | None, n: int) -> float | None:
    if rho is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    return t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
