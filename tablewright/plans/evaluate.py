"""Evaluation of a synthetic table: utility in several comparisons, privacy, faithfulness, acceptance, release."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import numerify, reconcile_weights
from ..operators import acceptance, faithfulness, metrics, privacy
from ..operators.metrics import RESULT, TwoWay
from ..operators.profile import binned, merge_comparisons, roll_up, subset_frequencies
from ..sources.tables import staged

KEYS = ["name", "metric", "target", "binning", "by", "targets"]
#: Result column: first and second table of the comparison.
COMPARISONS = {"val_r_s": ("real", "synth"), "val_r_sr": ("real", "subsample"), "val_pr_r": ("processed", "real"), "val_pr_s": ("processed", "synth"), "val_spr_r": ("subsampled_processed", "real")}


@dataclass(frozen=True)
class Domain:
    bins: dict[str, Sequence[float]]
    midpoints: dict[str, float] = field(default_factory=dict)
    margin_share: float = 0.01
    running_max: bool = True
    strict_frequencies: bool = False


#: Jobs of one evaluation that run at a time; most are small, and wait for each other otherwise.
JOBS = 8


def _scalars(do: Callable, x: DataFrame, y: DataFrame, correlations: tuple[dict, dict], domain: Domain, minimal: bool, analyses: Sequence[TwoWay], seed: int) -> list[Callable[[], list[tuple]]]:
    """The result rows of one comparison that are not frequencies, in order, as they come. do(f, ...) starts a job and gives what
    to call for its result; correlations are such calls."""
    out, groups = [do(metrics.one_way, x, y, domain.bins)], {}
    for an in analyses:
        edges = domain.bins[an.by] if an.binning else None
        if an.metric == "mean-resize-by-second":
            got = do(metrics.mean_resized, x, y, an.target, an.by, edges, domain.midpoints[an.target], domain.margin_share, seed)
            out.append(lambda an=an, got=got: [(float(v), f"{an.metric}/{k}", an.metric, an.target, an.binning, an.by, None) for k, v in got().items()])
        elif an.metric in ("mean", "median"):
            key = (an.target, an.by, an.binning)
            if key not in groups:
                groups[key] = do(_two_ways, x, y, an.target, an.by, edges)
            out.append(lambda an=an, got=groups[key]: [(float(got()[an.metric]), an.metric, an.metric, an.target, an.binning, an.by, None)])
        else:
            raise TypeError(f"unknown metric {an.metric!r}")
    joint = {"lr": do(metrics.linear_regression, x, y), "corr": lambda: metrics.correlation_differences(*({m: f() for m, f in c.items()} for c in correlations), domain.running_max)}
    if not minimal:
        joint["pMSE"] = do(metrics.propensity, x, y, seed)
    for m, got in joint.items():
        out.append(lambda m=m, got=got: [(None if v is None or v != v else float(v), f"{m}/{k}", m, None, False, None, None) for k, v in got().items()])
    return out


def _two_ways(x: DataFrame, y: DataFrame, target: str, by: str, edges) -> dict[str, float]:
    groups = staged(metrics.by_groups(x, y, target, by, edges))
    return {m: metrics.two_way(groups, m) for m in ("mean", "median")}


def compare(tables: dict[str, DataFrame], pairs: dict[str, tuple[str, str]], domain: Domain, minimal: bool = False, analyses: Sequence[TwoWay] = (), seed: int = 0) -> DataFrame:
    """One row for each metric, one column for each comparison. Tables are numeric and have the same columns.

    The frequencies of all subsets, raw and binned, and of all comparisons, are two jobs in all.
    """
    spark, columns = next(iter(tables.values())).sparkSession, next(iter(tables.values())).columns
    used = {t for p in pairs.values() for t in p}
    with ThreadPoolExecutor(JOBS) as pool:
        do = lambda f, *args: pool.submit(f, *args).result
        tables = {k: do(staged, v.select(*columns)) for k, v in tables.items() if k in used}
        tables = {k: v() for k, v in tables.items()}
        # Correlations are a table's own: each table's once, however many comparisons it is in.
        of = {k: {m: do(metrics.correlations, v, m) for m in metrics.METHODS} for k, v in tables.items()}
        scalars = {label: _scalars(do, tables[a], tables[b], (of[a], of[b]), domain, minimal, analyses, seed) for label, (a, b) in pairs.items()}
        sizes, parts = {k: v.count() for k, v in tables.items()}, []
        for binning in (False, True):
            source = {k: binned(v, domain.bins) if binning else v for k, v in tables.items()}
            parts.append(subset_frequencies(source, columns, pairs, sizes, domain.strict_frequencies).withColumn("binning", F.lit(binning)))
        frequencies = staged(parts[0].unionByName(parts[1]))
        rows = [(label, *r) for label, calls in scalars.items() for call in calls for r in call()]
    null = F.lit(None).cast("string")
    freq = frequencies.select("comparison", "val", "name", F.lit("frequencies").alias("metric"), null.alias("target"), "binning", null.alias("by"), "targets")
    rolled = roll_up(frequencies, len(columns)).select("comparison", "val", "name", "metric", null.alias("target"), "binning", null.alias("by"), F.lit(None).cast("array<string>").alias("targets"))
    scalars = spark.createDataFrame(rows, f"comparison string, {RESULT}")
    every = reduce(DataFrame.unionByName, (freq, rolled, scalars))
    return merge_comparisons({k: every.filter(F.col("comparison") == k).drop("comparison") for k in pairs}, KEYS)


def subsample_ids(n: int, fraction: float, seed: int, spark) -> DataFrame:
    """int(n * fraction) of the row numbers, without replacement."""
    return privacy.sample(spark.range(n).withColumnRenamed("id", "row_id"), int(n * fraction), seed)


def utility(real: DataFrame, synth: DataFrame, processed: DataFrame, domain: Domain, fraction: float, seed: int = 0, minimal: bool = False, analyses: Sequence[TwoWay] = (), comparisons: Sequence[str] = tuple(COMPARISONS)) -> DataFrame:
    """All five comparisons, or those asked for. real and processed have a row_id, from 0, that says which rows belong together."""
    drop = lambda d: numerify(d.drop("row_id"))
    ids = subsample_ids(real.count(), fraction, seed, real.sparkSession)
    pick = lambda d: drop(d.join(ids, "row_id", "left_semi"))
    tables = {"real": drop(real), "synth": numerify(synth), "processed": drop(processed), "subsample": pick(real), "subsampled_processed": pick(processed)}
    return compare(tables, {k: COMPARISONS[k] for k in comparisons}, domain, minimal, analyses, seed)


def faithfulness_table(real: DataFrame, synth: DataFrame, processed: DataFrame, weights: dict, alphas: Sequence[float], binnings: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """ɑ, β, density, algorithm, duration, comparison for real and processed against synthetic."""
    weights = reconcile_weights(weights, binnings or {})
    rows = []
    for label, table in (("val_r_s", real), ("val_pr_s", processed)):
        x, y = numerify(table.drop("row_id")), numerify(synth)
        for r in faithfulness.evaluate(x, y.select(*x.columns), weights, alphas):
            rows.append((float(r["alpha"]), float(r["beta"]), float(r["density"]), r["algorithm"], float(r["duration"]), label))
    return synth.sparkSession.createDataFrame(rows, "`ɑ` double, `β` double, `E/½V²` double, algorithm string, duration double, comparison string")


@dataclass
class Evaluation:
    utility: DataFrame
    privacy: DataFrame | None
    faithfulness: DataFrame | None
    acceptance: DataFrame
    release: DataFrame | None = None
    accountant: object = None


def evaluate(real: DataFrame, synth: DataFrame, processed: DataFrame, domain: Domain, weights: dict, alphas: Sequence[float], face_up_to: int, criteria: Sequence, fraction: float, seed: int = 0, minimal: bool = False, analyses: Sequence[TwoWay] = (), pairs: Sequence = (), binnings: dict | None = None, budget=None, bounds: dict | None = None, comparisons: Sequence[str] = tuple(COMPARISONS)) -> Evaluation:
    """Everything; the minimal form leaves out privacy and faithfulness, whose criteria then fail. With a budget the
    acceptance table is also released privately."""
    spark = real.sparkSession
    u = staged(utility(real, synth, processed, domain, fraction, seed, minimal, analyses, comparisons))
    p = f = None
    if not minimal:
        p = staged(privacy.face_table(synth, face_up_to, pairs))
        f = faithfulness_table(real, synth, processed, weights, alphas, binnings)
    a = acceptance.check(spark, criteria, {"utility": u, "privacy": p, "faithfulness": f})
    out = Evaluation(u, p, f, a)
    if budget is not None:
        out.release, out.accountant = acceptance.release(a, u, processed.drop("row_id"), synth, bounds, budget)
    return out
