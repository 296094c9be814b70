"""Generative models by name: fit on a coded table, draw a coded table."""

from __future__ import annotations

import math
from collections.abc import Iterable
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from .bayesnet import BayesNet, Domain
from .privacy import sample

#: Models that need a library for neural networks or query optimisation.
UNAVAILABLE = ("PEP", "CTGAN", "DPGAN", "PATEGAN", "DPCTGAN", "PATECTGAN")


def assert_keys(d: dict, optional: Iterable[str], must: Iterable[str] = ()) -> None:
    unknown, missing = set(d) - set(optional) - set(must), set(must) - set(d)
    if unknown or missing:
        raise ValueError(f"unknown parameters {sorted(unknown)}, missing {sorted(missing)}")


def fit_sample(df: DataFrame, bounds: dict[str, tuple[int, int]], model: str, epsilon: float, delta: float = 0.0, hparams: dict | None = None, categories: Iterable[str] = (), n: int | None = None, seed: int = 0) -> tuple[DataFrame, object]:
    """n rows (as many as df has, by default) and the model. ValueError for an unknown model or parameter, or a delta
    above n^-1.5."""
    hparams = dict(hparams or {})
    size = df.count()
    n = size if n is None else n
    if size and delta > size**-1.5 + 1e-12:
        raise ValueError(f"delta {delta} is above {size**-1.5}")
    if model == "ID":
        assert_keys(hparams, ())
        return (df if n == size else sample(df, n, seed, n > size)), None
    if model == "GC":
        assert_keys(hparams, ("field_distributions",))
        return gaussian_copula(df, n, seed), None
    if model == "DPGC":
        raise NotImplementedError(model)
    if model.startswith("PBN"):
        assert_keys(hparams, ("theta", "degree", "epsilon_split"))
        missing = set(df.columns) - set(categories)
        if missing:
            raise ValueError(f"columns of codes only; {sorted(missing)} are continuous")
        domain = Domain(df.columns, [int(bounds[c][1]) + 1 for c in df.columns])
        net = BayesNet(epsilon, hparams.get("epsilon_split", 0.3), hparams.get("theta"), hparams.get("degree")).fit(df, domain)
        return net.sample(df.sparkSession, n, seed), net
    if model == "MWEM":
        assert_keys(hparams, ("q_count", "iterations", "mult_weights_iterations"))
        return mwem(df, bounds, epsilon, n, seed, **hparams), None
    if model in UNAVAILABLE:
        raise NotImplementedError(f"{model} needs a library that is not there")
    raise ValueError(f"unknown model {model!r}")


def gaussian_copula(df: DataFrame, n: int, seed: int = 0, knots: int = 200) -> DataFrame:
    """Without privacy: normal scores of quantiles, their correlations, and normal draws mapped back by quantiles.

    Two jobs: the quantiles of all columns, then all products of scores; draws are made in tasks.
    """
    columns, normal = df.columns, NormalDist()
    probs = [(k + 0.5) / knots for k in range(knots)]
    row = df.agg(*(F.percentile_approx(c, F.array(*map(F.lit, probs)), 10_000).alias(c) for c in columns)).first()
    scores = [F.lit(normal.inv_cdf(p)) for p in probs]

    def score(c: str):
        below = F.size(F.filter(F.array(*(F.lit(float(q)) for q in row[c])), lambda q: q < F.col(c)))
        return F.element_at(F.array(*scores), F.least(below + 1, F.lit(knots)))

    z = df.select(*(score(c).alias(c) for c in columns))
    k = len(columns)
    got = z.agg(*(F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b) for a in columns for b in columns)).first()
    cov = np.array([v or 0.0 for v in got]).reshape(k, k)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    root = np.linalg.cholesky(cov / np.outer(scale, scale) + 1e-9 * np.eye(k))
    draws = staged(df.sparkSession.range(n).select(*(F.randn(seed + i).alias(f"z{i}") for i in range(k))))
    out = []
    for i, c in enumerate(columns):
        v = sum((F.lit(float(root[i, j])) * F.col(f"z{j}") for j in range(i + 1)), F.lit(0.0))
        # The place of the draw among the knots' scores picks the quantile.
        at = F.size(F.filter(F.array(*scores), lambda s: s < v))
        out.append(F.element_at(F.array(*(F.lit(q) for q in row[c])), F.least(at + 1, F.lit(knots))).cast(df.schema[c].dataType).alias(c))
    return draws.select(*out)


def mwem(df: DataFrame, bounds: dict, epsilon: float, n: int, seed: int = 0, q_count: int = 128, iterations: int = 10, mult_weights_iterations: int = 20, most_cells: int = 1_000_000) -> DataFrame:
    """Multiplicative weights over the domain's histogram: in turn the worst of q_count random marginal cells is chosen
    privately, measured with noise, and the histogram updated. The domain must be small: it is on the driver."""
    from . import mechanisms as dp

    sizes = {c: int(bounds[c][1]) + 1 for c in df.columns}
    total_cells = math.prod(sizes.values())
    if total_cells > most_cells:
        raise ValueError(f"the domain has {total_cells} cells")
    counts = np.zeros(list(sizes.values()))
    for r in df.groupBy(*df.columns).count().toLocalIterator():
        counts[tuple(int(v) for v in r[:-1])] = r[-1]
    size, rng = counts.sum(), np.random.default_rng(seed)
    model = np.full(counts.shape, size / counts.size)
    queries = []
    for _ in range(q_count):
        axes = rng.choice(counts.ndim, size=min(2, counts.ndim), replace=False)
        index = [slice(None)] * counts.ndim
        for a in axes:
            index[a] = int(rng.integers(counts.shape[a]))
        queries.append(tuple(index))
    measured: list[tuple[tuple, float]] = []
    for _ in range(min(iterations, q_count)):
        errors = [abs(counts[q].sum() - model[q].sum()) for q in queries]
        q = queries.pop(dp.exponential_choice(errors, epsilon / (2 * iterations), 1.0))
        measured.append((q, counts[q].sum() + dp.laplace_noise(2 * iterations / epsilon)))
        for _ in range(mult_weights_iterations):
            for index, value in measured:
                factor = np.ones_like(model)
                factor[index] = np.exp(np.clip((value - model[index].sum()) / (2 * max(size, 1)), -5, 5))
                model *= factor
                model *= size / model.sum()
    places = rng.choice(model.size, size=n, p=(model / model.sum()).ravel())
    rows = np.stack(np.unravel_index(places, model.shape), axis=1).tolist()
    return df.sparkSession.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"`{c}` int" for c in df.columns))
