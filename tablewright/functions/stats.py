"""Tails of distributions and small solvers, for statistics that were aggregated in Spark."""

from __future__ import annotations

import math

import numpy as np


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series below a + 1 and continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_tail(x: float, dof: int) -> float:
    return 1.0 if dof <= 0 else gamma_tail(dof / 2, x / 2)


def ks_tail(d: float, n: int, m: int) -> float:
    """The asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    t = d * math.sqrt(n * m / (n + m))
    if t < 1e-3:
        return 1.0
    if t < 1.18:  # the form that converges fast for small t
        v = math.exp(-math.pi**2 / (8 * t * t))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / t * sum(v ** ((2 * k - 1) ** 2) for k in range(1, 20))))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def f_tail(x: float, a: float, b: float) -> float:
    """The upper tail of the F distribution, by the incomplete beta function's continued fraction."""
    if x <= 0 or not math.isfinite(x):
        return 1.0 if x <= 0 else 0.0
    return _beta(b / 2, a / 2, b / (b + a * x))


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def assignment(cost: np.ndarray) -> list[int]:
    """The columns of a minimum-cost assignment of all rows, by shortest augmenting paths with potentials; for small
    square tables on the driver."""
    n = len(cost)
    if n == 0:
        return []
    up, vp = np.zeros(n + 1), np.zeros(n + 1)
    owner, way = np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool)
        while True:
            used[j0] = True
            free = ~used
            free[0] = False
            slack = cost[owner[j0] - 1] - up[owner[j0]] - vp[1:]
            better = free[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.where(free, least, np.inf).argmin())
            step = least[j1]
            up[owner[used]] += step
            vp[used] -= step
            least[free] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out
