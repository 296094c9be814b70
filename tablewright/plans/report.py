"""Reports: named tables over evaluated data sets and over the run store."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.binning import cut, numerify
from ..functions.names import part
from ..operators import metrics
from ..operators.acceptance import noisy_ols, pseudo_threshold
from ..operators.profile import contingency, describe, ecdf, histogram, n_histograms, pass_rates, tagged, to_wide, venn
from ..sources.tables import staged


def stacked(tables: dict[str, DataFrame], bins: dict[str, Sequence[float]]) -> DataFrame:
    """All tables as numbers, with their names, and binned copies of the columns that have bins as `<column>_bin`."""
    both = tagged({k: numerify(v) for k, v in tables.items()})
    return both.select("*", *(cut(F.col(c), e).alias(f"{c}_bin") for c, e in bins.items() if c in both.columns))


def marginal_summary(utility: DataFrame, comparison: str = "val_pr_s") -> DataFrame:
    """ways, func, binning and the diff and ratio of the rolled-up frequencies."""
    rows = utility.filter(F.col("name").rlike(r"^\d+way/")).select(part(F.col("name"), 0).alias("ways"), part(F.col("name"), 1).alias("func"), part(F.col("name"), 3).alias("mode"), part(F.col("name"), 4).alias("cells"), F.col(comparison).alias("v"))
    return to_wide(rows, ["ways", "func", "cells"], "mode", "v", ["diff", "ratio"])


def column_profiles(stack: DataFrame, columns: Sequence[str]) -> DataFrame:
    return describe(stack.select("name", *columns), ["name"])


def column_ecdfs(stack: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    return {c: ecdf(stack, c) for c in columns}


def crosstabs(stack: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], DataFrame]:
    return {(a, b): contingency(stack, a, b, "all") for a, b in combinations(columns, 2)}


def group_means(stack: DataFrame, target: str, by: str) -> DataFrame:
    return stack.groupBy("name", by).agg(F.avg(target).alias("mean"), F.median(target).alias("median"), F.count(target).alias("n"))


def regressions(tables: dict[str, DataFrame]) -> DataFrame:
    """name, R2, F, p and MAE of the last column on the others, z-scored."""
    rows, spark = [], None
    for name, df in tables.items():
        x, spark = numerify(df), df.sparkSession
        sums, n = metrics.moments(x)
        model = metrics.ols(sums, *metrics.scaler(sums))
        e = F.col(x.columns[-1]) - model.predict(x.columns[:-1])
        r = x.agg(F.sum(e * e), F.var_pop(x.columns[-1]) * F.count(F.lit(1)), F.avg(F.abs(e))).first()
        k, r2 = len(x.columns) - 1, 1 - r[0] / r[1] if r[1] else 0.0
        f = (r2 / k) / ((1 - r2) / max(1.0, n - k - 1)) if r2 < 1 else float("inf")
        rows.append((name, float(r2), float(f), float(stats.f_tail(f, k, n - k - 1)), r[2], [float(c) for c in model.coef], model.intercept))
    return spark.createDataFrame(rows, "name string, r2 double, f double, p double, mae double, coef array<double>, intercept double")


def unseen_pairs(processed: DataFrame, synth: DataFrame, rejected: DataFrame, a: str, b: str) -> DataFrame:
    """Value pairs that the processed table lacks, with their counts in the synthetic and rejected rows."""
    return n_histograms({"processed": processed, "synth": synth, "rejected": rejected}, [a, b]).filter("processed = 0")


def run_table(runs: DataFrame, metrics_: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Runs with fields of their configuration and chosen metrics as columns, and whether all flags are set."""
    fields = [F.get_json_object("config", f"$.{k}").alias(k) for k in keys]
    wide = to_wide(metrics_.filter(F.col("key").isin(*flags)), ["run_id"], "key", "value", flags)
    every = F.lit(True)
    for f in flags:
        every &= F.coalesce(F.col(f"`{f}`") > 0, F.lit(False))
    return runs.select("run_id", "state", *fields).join(wide, "run_id", "left").withColumn("passed", every)


def accepted_rates(run_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return pass_rates(run_rows, ["passed"], by)


def dp_against_plain(run_rows: DataFrame, plain: str, private: str) -> DataFrame:
    return histogram(run_rows, [plain, private])


def venn_sizes(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    return venn(rows, flags)


def noisy_fit_errors(df: DataFrame, low: np.ndarray, high: np.ndarray, target: tuple[float, float], epsilons: Sequence[float], fits: int = 100) -> DataFrame:
    """epsilon, error: relative coefficient errors of private fits, all from one aggregate."""
    sums, _ = metrics.moments(df)
    scale = metrics.scaler(sums)
    exact = metrics.ols(sums, *scale)
    size = float(np.linalg.norm(exact.coef)) or 1.0
    rows = [(float(e), float(np.linalg.norm(noisy_ols(sums, *scale, low, high, target, e).coef - exact.coef)) / size) for e in epsilons for _ in range(fits)]
    return df.sparkSession.createDataFrame(rows, "epsilon double, error double")


def resize_study(x: DataFrame, y: DataFrame, target: str, by: str, edges, midpoint: float, repeats: int = 100, epsilon: float = 0.1, bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """seed, max_diff, min_size and the variance that a private release of the mean would have."""
    rows = []
    for seed in range(repeats):
        r = metrics.mean_resized(x, y, target, by, edges, midpoint, seed=seed)
        scale = (bounds[1] - bounds[0]) / r["min/size_by_second"] / epsilon
        rows.append((seed, r["max/diff"], r["min/size_by_second"], 2 * scale * scale))
    return x.sparkSession.createDataFrame(rows, "seed int, max_diff double, min_size double, noise_var double")


def ratio_budgets(spark, epsilons: Sequence[float], min_counts: Sequence[int], threshold: float, prob_pass: float = 0.05) -> DataFrame:
    rows = [(float(e), m, *map(float, pseudo_threshold(prob_pass, m, threshold, e))) for e in epsilons for m in min_counts]
    return spark.createDataFrame(rows, "epsilon double, min_count int, pseudo_threshold double, clip double, sensitivity double, scale double")


def full(tables: dict[str, DataFrame], utility: DataFrame, bins: dict[str, Sequence[float]], rejected: DataFrame | None = None, runs: DataFrame | None = None, run_metrics: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a report by name: processed and synth side by side, in all columns, pairs of binned columns and pairs
    that one lacks, and all runs with what they passed."""
    stack = staged(stacked(tables, bins))
    binned = [c for c in stack.columns if c.endswith("_bin")]
    columns = [c for c in stack.columns if c != "name" and c not in binned]
    out = {"marginals": marginal_summary(utility), "profiles": column_profiles(stack, columns), "regressions": regressions(tables)}
    out |= {f"ecdf-{c}": d for c, d in column_ecdfs(stack, columns).items()}
    out |= {f"crosstab-{a}-{b}": d for (a, b), d in crosstabs(stack, binned).items()}
    out |= {f"means-{c}-{b}": group_means(stack, c, b) for b in binned for c in columns if b != f"{c}_bin"}
    if rejected is not None:
        both = [c for c in tables["processed"].columns if c in rejected.columns and c in tables["synth"].columns]
        out |= {f"unseen-{a}-{b}": unseen_pairs(tables["processed"], tables["synth"], rejected, a, b) for a, b in combinations(both, 2)}
    if runs is not None and run_metrics is not None:
        flags = sorted(r.key for r in run_metrics.select("key").distinct().collect())
        rows = staged(run_table(runs, run_metrics, ["model", "tier", "num_categorical", "num_cat_cells"], flags))
        out |= {"runs": rows, "accepted": accepted_rates(rows, ["model"]), "flags": venn_sizes(rows.select(*((F.col(f"`{f}`") > 0).alias(f) for f in flags)).toDF(*(f"flag_{k}" for k in range(len(flags)))), [f"flag_{k}" for k in range(len(flags))])}
    return out
