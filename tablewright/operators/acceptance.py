"""Acceptance checks, and their differentially private release."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import numerify
from . import mechanisms as dp
from .metrics import Linear, linear_regression, moments, scaler
from .profile import min_marginal

SCHEMA = "name string, expected double, actual double, `check` boolean"
RELEASE = f"{SCHEMA}, lower double, upper double, epsilon double, var double, sensitivity double, mech string, extra array<double>"


@dataclass(frozen=True)
class Criterion:
    """What is looked up, in which table, and the value that it must stay below. `single` demands one row."""

    name: str
    table: str
    where: str
    value: str
    expected: float
    single: bool = True

    def actual(self, tables: dict[str, DataFrame | None]) -> float:
        """NaN if the table is missing, or no row, or not one row where one is needed."""
        df = tables.get(self.table)
        if df is None:
            return math.nan
        r = df.filter(self.where).agg(F.count(F.lit(1)), F.max(F.col(f"`{self.value}`").cast("double"))).first()
        return math.nan if r[1] is None or self.single and r[0] != 1 else r[1]


def check(spark: SparkSession, criteria: Sequence[Criterion], tables: dict[str, DataFrame | None]) -> DataFrame:
    """name, expected, actual, check of each criterion, passed if strictly below; then the row `all`."""
    rows = []
    for c in criteria:
        a = c.actual(tables)
        rows.append((c.name, float(c.expected), None if math.isnan(a) else a, bool(a < c.expected)))
    every = all(r[3] for r in rows)
    return spark.createDataFrame([*rows, ("all", None, float(every), every)], SCHEMA)


def checks(values: DataFrame, name: Column, actual: Column, expected: Column) -> DataFrame:
    """The same for a table of values: one row each, and `all`. A missing value fails."""
    each = values.select(name.alias("name"), expected.cast("double").alias("expected"), actual.cast("double").alias("actual"), F.coalesce(actual < expected, F.lit(False)).alias("check"))
    every = each.agg(F.lit("all").alias("name"), F.lit(None).cast("double").alias("expected"), F.bool_and("check").cast("int").cast("double").alias("actual"), F.bool_and("check").alias("check"))
    return each.unionByName(every)


def ratio_sensitivities(min_count: float, clip: float) -> tuple[float, float]:
    """Of the largest ratio of real to synthetic counts, and of its inverse clipped to [1 / clip, clip], when a record of
    the real table changes and every synthetic count is at least min_count."""
    return 1 / min_count, clip - 1 / (1 / clip + 1 / min_count)


def pseudo_threshold(prob_pass: float, min_count: float, threshold: float, epsilon: float) -> tuple[float, float, float, float]:
    """The value that noise lifts below the threshold with probability prob_pass; clip, sensitivity, noise scale."""
    sensitivity = max(ratio_sensitivities(min_count, threshold))
    scale = sensitivity / epsilon
    quantile = -scale * math.log(2 * prob_pass) if prob_pass <= 0.5 else scale * math.log(2 * (1 - prob_pass))
    return threshold - quantile, threshold, sensitivity, scale


def noisy_ols(sums: np.ndarray, mean: np.ndarray, std: np.ndarray, low: np.ndarray, high: np.ndarray, target: tuple[float, float], epsilon: float) -> Linear:
    """Least squares by perturbed sums of squares: regressors are clipped to [low, high] after scaling, so each entry of the
    sums changes by a bounded amount, and the budget is shared over the entries."""
    k = len(mean)
    t = np.eye(k + 2)
    for i in range(k):
        t[i + 1, 0], t[i + 1, i + 1] = -mean[i] / std[i], 1 / std[i]
    s = t @ sums @ t.T
    reach = np.r_[1.0, np.maximum(np.abs(low), np.abs(high)), max(abs(target[0]), abs(target[1]))]
    entries = [(i, j) for i in range(k + 2) for j in range(i, k + 2) if (i, j) not in ((0, 0), (k + 1, k + 1))]
    for i, j in entries:
        noise = dp.laplace_noise(2 * reach[i] * reach[j] * len(entries) / epsilon)
        s[i, j] += noise
        s[j, i] = s[i, j]
    a = s[: k + 1, : k + 1] + 1e-6 * np.eye(k + 1)
    beta, *_ = np.linalg.lstsq(a, s[: k + 1, k + 1], rcond=None)
    return Linear(beta[1:], float(beta[0]), mean, std)


@dataclass(frozen=True)
class Budget:
    high_sensitivity: float
    low_sensitivity: float
    conditional_mean: dict[str, float]
    fit: float
    evaluation: float
    ratio_clip: float

    @property
    def total(self) -> float:
        return math.fsum([self.high_sensitivity, self.low_sensitivity, *self.conditional_mean.values(), self.fit, self.evaluation])


def release(accepted: DataFrame, utility: DataFrame, real: DataFrame, synth: DataFrame, bounds: dict[str, tuple[float, float]], budget: Budget, comparison: str = "val_pr_s") -> tuple[DataFrame, dp.Accountant]:
    """The acceptance table with noise on all that reads the real table; checks redone; AssertionError unless the budget
    spent is the budget planned. Sensitivities come from the synthetic table and declared bounds only.

    The scalars are few and on the driver; each of the aggregates behind them is a Spark job.
    """
    n, book = real.count(), dp.Accountant()
    blank = {"lower": None, "upper": None, "epsilon": None, "var": None, "sensitivity": None, "mech": None, "extra": None}
    rows = [{**r.asDict(), **blank} for r in accepted.collect()]
    named = {r["name"]: r for r in rows}

    def noise(r: dict, lower: float, upper: float, epsilon: float, sensitivity: float) -> None:
        # A missing value gets none, but its share of the plan is spent all the same.
        value = r["actual"] if r["actual"] is not None else math.nan
        got = dp.laplace(value, epsilon, sensitivity, book, r["name"])
        r.update(got, lower=lower, upper=upper)

    ratio = named.get(f"utility/1way/max/frequencies/ratio/raw/{comparison}")
    if ratio:
        clip = budget.ratio_clip
        best = utility.filter("name = 'frequencies/ratio/max' AND NOT binning AND size(targets) = 1").agg(F.max(comparison)).first()[0]
        ratio["actual"] = None if best is None else min(max(best, 1 / clip), clip)
        noise(ratio, 1, clip, budget.high_sensitivity, max(ratio_sensitivities(min_marginal(synth), clip)))
    unit = [r for r in rows if "frequencies/diff" in r["name"] or "faithfulness/β" in r["name"]]
    for r in unit:
        noise(r, 0, 1, budget.low_sensitivity / len(unit), 1 / n)
    for r in (r for r in rows if "mean" in r["name"]):
        column = r["name"].split("/")[2]
        sizes = [x[0] for x in utility.filter(F.col("name") == "mean-resize-by-second/min/size_by_second").filter(F.col("target") == column).select(comparison).collect()]
        low, high = bounds[column]
        noise(r, low, high, budget.conditional_mean[column], (high - low) / min(sizes))
        r["extra"] = [float(s) for s in sizes]
    coef, cross = named.get(f"utility/lr/coef/error/diff/total/{comparison}"), named.get(f"utility/lr/MAE/cross/1-by-2/{comparison}")
    if coef and cross:
        a, b = numerify(real), numerify(synth).select(*real.columns)
        mean, std = scaler(moments(b)[0])
        edges = b.agg(*(f(c).alias(f"{k}_{c}") for c in b.columns[:-1] for k, f in (("lo", F.min), ("hi", F.max)))).first()
        low = np.array([(edges[f"lo_{c}"] - m) / s for c, m, s in zip(b.columns, mean, std)])
        high = np.array([(edges[f"hi_{c}"] - m) / s for c, m, s in zip(b.columns, mean, std)])
        target = bounds[real.columns[-1]]
        clipped = a.select(*(F.least(F.greatest(F.col(c), F.lit(edges[f"lo_{c}"])), F.lit(edges[f"hi_{c}"])).alias(c) for c in a.columns[:-1]), F.least(F.greatest(F.col(a.columns[-1]), F.lit(float(target[0]))), F.lit(float(target[1]))).alias(a.columns[-1]))
        fitted: list[Linear] = []

        def private_fit(_, mean_, std_):
            fitted.append(noisy_ols(moments(clipped)[0], mean_, std_, low, high, target, budget.fit))
            book.spend(coef["name"], budget.fit)
            return fitted[0]

        found = linear_regression(a, b, target, True, private_fit)
        coef.update(actual=found["coef/error/diff/total"], epsilon=budget.fit, mech="lr", extra=[*map(float, fitted[0].coef), fitted[0].intercept])
        cross["actual"] = found["MAE/cross/1-by-2"]
        noise(cross, target[0], target[1], budget.evaluation, 2 * (target[1] - target[0]) / n)
    for r in rows:
        if r["actual"] is not None and math.isnan(r["actual"]):
            r["actual"] = None
        if r["name"] != "all":
            r["check"] = r["actual"] is not None and r["actual"] < r["expected"]
    whole = named["all"]
    whole["check"] = all(r["check"] for r in rows if r is not whole)
    whole["actual"], whole["epsilon"] = float(whole["check"]), math.fsum(r["epsilon"] or 0.0 for r in rows if r is not whole)
    if not math.isclose(book.total, budget.total, rel_tol=1e-9):
        raise AssertionError(f"spent {book.total}, planned {budget.total}")
    order = ["name", "expected", "actual", "check", "lower", "upper", "epsilon", "var", "sensitivity", "mech", "extra"]
    cast = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return accepted.sparkSession.createDataFrame([tuple(cast(r[k]) for k in order) for r in rows], RELEASE), book
