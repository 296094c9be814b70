"""Differentially private mechanisms, on the driver, from the system's secure source."""

from __future__ import annotations

import math
import secrets
from collections.abc import Sequence

_RNG = secrets.SystemRandom()


def laplace_noise(scale: float) -> float:
    """The difference of two exponentials."""
    if scale <= 0 or not math.isfinite(scale):
        return 0.0
    return scale * (_RNG.expovariate(1.0) - _RNG.expovariate(1.0))


def laplace_variance(scale: float) -> float:
    return 2 * scale * scale


def exponential_choice(quality: Sequence[float], epsilon: float, sensitivity: float) -> int:
    """An index with weight exp(epsilon / (2 sensitivity) (q - max q))."""
    top = max(quality)
    weights = [math.exp(epsilon / (2 * sensitivity) * (q - top)) for q in quality]
    u = _RNG.random() * sum(weights)
    for k, w in enumerate(weights):
        u -= w
        if u < 0:
            return k
    return len(weights) - 1


class Accountant:
    """Pure epsilons, added."""

    def __init__(self):
        self.spent: list[tuple[str, float]] = []

    def spend(self, what: str, epsilon: float) -> None:
        self.spent.append((what, epsilon))

    @property
    def total(self) -> float:
        return math.fsum(e for _, e in self.spent)


def laplace(value: float, epsilon: float, sensitivity: float, accountant: Accountant | None = None, what: str = "") -> dict:
    """The noisy value with what describes its noise."""
    scale = sensitivity / epsilon
    if accountant is not None:
        accountant.spend(what, epsilon)
    return {"actual": value + laplace_noise(scale), "var": laplace_variance(scale), "epsilon": epsilon, "sensitivity": sensitivity, "mech": "laplace"}
