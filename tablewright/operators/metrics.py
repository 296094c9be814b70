"""Table-against-table metrics as aggregates of one tagged scan.

Functions take x and y, numeric tables with the same columns. Results are long: metric, name, target, by, binning,
targets, val. Scalars that need a tail function or a solver are finished on the driver from one row of sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.binning import cut
from ..sources.tables import staged
from .profile import average_ranks, ordered, paired_histogram, tagged

RESULT = "val double, name string, metric string, target string, binning boolean, `by` string, targets array<string>"
ONE_WAY = ("nan", "mean", "median", "std", "max", "min", "q1", "q3", "cdf", "chi2", "wasserstein")
TWO_WAY = ("mean", "median", "mean-resize-by-second")
JOINT = ("frequencies", "lr", "corr", "pMSE")


@dataclass(frozen=True)
class OneWay:
    metric: str
    target: str
    binning: bool = False


@dataclass(frozen=True)
class TwoWay:
    metric: str
    target: str
    by: str
    binning: bool = True


@dataclass(frozen=True)
class Joint:
    metric: str
    binning: bool = False
    targets: tuple[str, ...] | None = None


def _is(tag: str, c: Column) -> Column:
    return F.when(F.col("_tag") == tag, c)


def summary_row(x: DataFrame, y: DataFrame) -> dict:
    """All one-way aggregates of all columns of both tables, as `statistic|x or y|column`: one job, in which the three
    quartiles of a column share one table of counts."""
    aggs, quarters = [], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    for c in x.columns:
        v = F.nanvl(F.col(c), F.lit(None).cast("double"))
        for t in "xy":
            w = _is(t, v)
            aggs += [a.alias(f"{n}|{t}|{c}") for n, a in (("nan", F.count_if((F.col("_tag") == t) & v.isNull())), ("mean", F.avg(w)), ("std", F.stddev_pop(w)), ("max", F.max(w)), ("min", F.min(w)), ("quartiles", F.percentile(w, quarters)), ("n", F.count(w)))]
    row = tagged({"x": x, "y": y.select(*x.columns)}, "_tag").agg(*aggs).first().asDict()
    for c in x.columns:
        for t in "xy":
            q = row[f"quartiles|{t}|{c}"] or [None] * 3
            row |= {f"{n}|{t}|{c}": v for n, v in zip(("q1", "median", "q3"), q)}
    return row


def ratio_or_inf(a: float | None, b: float | None) -> float | None:
    if a is None or b is None:
        return None
    if b == 0:
        return None if a == 0 else math.inf
    return a / b


def value_cells(x: DataFrame, y: DataFrame, column: str) -> DataFrame:
    """value, nx, ny of one column, nulls left out."""
    return paired_histogram(x.select(column).filter(F.col(column).isNotNull()), y.select(column).filter(F.col(column).isNotNull())).withColumnRenamed(column, "value")


def cdf_gaps(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """value, gap between the two distribution functions from it on, width to the next value."""
    gap = F.abs(F.col("upto_nx") / F.lit(float(nx)) - F.col("upto_ny") / F.lit(float(ny)))
    return ordered(cells, "value", ["nx", "ny"]).select("value", gap.alias("gap"), (F.col("next") - F.col("value")).alias("width"))


def column_cells(x: DataFrame, y: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, nx, ny of all columns, nulls left out: one aggregate over the distinct rows of both tables."""
    rows = paired_histogram(x, y, list(columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    cells = rows.select("nx", "ny", F.explode(pairs).alias("p")).filter("p.value IS NOT NULL AND NOT isnan(p.value)")
    return cells.groupBy("p.column", "p.value").agg(F.sum("nx").alias("nx"), F.sum("ny").alias("ny"))


def distances(x: DataFrame, y: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Of each column the Kolmogorov-Smirnov statistic and its p-value, and the transport distance of the values cut to
    integers times n: all columns together, over their distinct values in order."""
    cells = column_cells(x, y, columns)
    whole = cells.withColumn("value", F.col("value").cast("long").cast("double")).groupBy("column", "value").agg(F.sum("nx").alias("nx"), F.sum("ny").alias("ny"))
    both = staged(cells.withColumn("kind", F.lit("ks")).unionByName(whole.withColumn("kind", F.lit("w"))))
    totals = both.groupBy(F.col("kind").alias("k"), F.col("column").alias("c")).agg(F.sum("nx").alias("tx"), F.sum("ny").alias("ty"))
    sums = ordered(both, "value", ["nx", "ny"], ["kind", "column"]).join(F.broadcast(totals), (F.col("kind") == F.col("k")) & (F.col("column") == F.col("c")))
    gap = F.abs(F.try_divide("upto_nx", "tx") - F.try_divide("upto_ny", "ty"))
    gaps = sums.select("kind", "column", gap.alias("gap"), (F.col("next") - F.col("value")).alias("width"), "tx", "ty")
    rows = {(r.kind, r.column): r for r in gaps.groupBy("kind", "column").agg(F.max("gap").alias("d"), F.sum(F.col("gap") * F.col("width")).alias("w"), F.max("tx").alias("tx"), F.max("ty").alias("ty")).collect()}
    out = {}
    for c in columns:
        ks, w = rows.get(("ks", c)), rows.get(("w", c))
        out[c] = (math.nan,) * 3 if ks is None or ks.d is None else (ks.d, stats.ks_tail(ks.d, ks.tx, ks.ty), (w.w or 0.0) * w.tx)
    return out


def chi2_statistic(cells: DataFrame) -> DataFrame:
    """stat, dof, from value, nx, ny: homogeneity of two rows of counts; Yates' correction with one degree of freedom."""
    seen = cells.filter("nx + ny > 0")
    totals = seen.agg(F.sum("nx").alias("tx"), F.sum("ny").alias("ty"), F.count(F.lit(1)).alias("k"))
    both = seen.crossJoin(F.broadcast(totals))
    n = F.col("tx") + F.col("ty")

    def term(observed: str, total: str) -> Column:
        expected = (F.col("nx") + F.col("ny")) * F.col(total) / n
        off = F.abs(F.col(observed) - expected)
        off = F.when(F.col("k") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
        return F.try_divide(off * off, expected)

    return both.agg(F.sum(term("nx", "tx") + term("ny", "ty")).alias("stat"), (F.max("k") - 1).alias("dof"))


def chi2_p_values(x: DataFrame, y: DataFrame, bins: dict[str, Sequence[float]]) -> dict[str, float]:
    """Of each binned column; one job for the counts of all bins, which are few."""
    coded = [df.select(*(cut(F.col(c), e).alias(c) for c, e in bins.items())) for df in (x, y)]
    counts: dict[str, list[tuple[int, int]]] = {c: [] for c in bins}
    for r in column_cells(*coded, list(bins)).collect():
        counts[r.column].append((r.nx, r.ny))
    out = {}
    for c, rows in counts.items():
        n = np.array(rows, dtype=float).reshape(-1, 2)
        dof = len(n) - 1
        if dof < 1 or not n.sum(0).all():
            out[c] = 1.0
            continue
        expected = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / n.sum()
        off = np.abs(n - expected)
        off -= np.minimum(0.5, off) if dof == 1 else 0
        out[c] = stats.chi2_tail(float((off**2 / expected).sum()), dof)
    return out


def one_way(x: DataFrame, y: DataFrame, bins: dict[str, Sequence[float]]) -> list[tuple]:
    """The rows of all one-way metrics: three jobs for all columns."""
    row, out = summary_row(x, y), []
    far, chi2 = distances(x, y, x.columns), chi2_p_values(x, y, {c: e for c, e in bins.items() if c in x.columns})
    for c in x.columns:
        at = lambda n: (row[f"{n}|x|{c}"], row[f"{n}|y|{c}"])
        for metric in ONE_WAY:
            if metric == "std":
                val = ratio_or_inf(*at("std"))
            elif metric == "cdf":
                val = far[c][1]
            elif metric == "wasserstein":
                val = far[c][2]
            elif metric == "chi2":
                if c not in chi2:
                    continue
                val = chi2[c]
            else:
                a, b = at(metric)
                val = None if a is None or b is None else float(abs(a - b))
            out.append((val, metric, metric, c, metric == "chi2", None, None))
    return out


def by_groups(x: DataFrame, y: DataFrame, target: str, by: str, edges: Sequence[float] | None) -> DataFrame:
    """g (bin of `by`), and of each table the count, sum, mean and median of the target."""
    group = cut(F.col(by), edges) if edges is not None else F.col(by)
    both = tagged({"x": x, "y": y}, "_tag").select("_tag", group.alias("g"), F.col(target).alias("t")).filter("g IS NOT NULL")
    one = lambda n, f: [f(_is(t, F.col("t"))).alias(f"{n}_{t}") for t in "xy"]
    return both.groupBy("g").agg(*one("n", F.count), *one("sum", F.sum), *one("mean", F.avg), *one("median", F.median))


def two_way(groups: DataFrame, metric: str) -> float:
    """Largest absolute difference over the bins; a bin that one table lacks differs by 0."""
    return groups.agg(F.max(F.coalesce(F.abs(F.col(f"{metric}_x") - F.col(f"{metric}_y")), F.lit(0.0)))).first()[0] or 0.0


def resized(x: DataFrame, y: DataFrame, target: str, by: str, edges: Sequence[float] | None, midpoint: float, margin_share: float = 0.01, seed: int = 0) -> DataFrame:
    """g, size, resized mean of x, mean of y.

    A bin's size is y's count less a margin, 1 at least. A bin of x that is larger is cut to a random part of that size: the
    rows with the smallest of uniform numbers, found by a threshold and by the order of the few near it (about 12 times the
    root of the size), so no bin has to be sorted as a whole. A smaller bin is padded with the midpoint, by arithmetic.
    """
    groups = by_groups(x, y, target, by, edges)
    total = groups.agg(F.sum("n_y")).first()[0] or 0
    margin = math.ceil(total * margin_share) + 1
    size = F.greatest(F.col("n_y") - margin, F.lit(1))
    groups = groups.filter("n_x > 0 OR n_y > 0").withColumn("size", size)
    group = cut(F.col(by), edges) if edges is not None else F.col(by)
    rows = x.select(group.alias("g"), F.col(target).alias("t"), F.rand(seed).alias("u")).filter("g IS NOT NULL")
    large = groups.filter("n_x > size").select("g", "size", "n_x")
    # Nearly all rows are surely below the threshold or above; those within six sigma of it are put in order, in the sums.
    at, sigma = F.col("size") / F.col("n_x"), F.sqrt(F.col("size")) / F.col("n_x")
    met = rows.join(large if edges is None else F.broadcast(large), "g").withColumn("sure", F.col("u") < at - 6 * sigma).filter(F.col("u") <= at + 6 * sigma)
    sums = met.groupBy("g").agg(F.first("size").alias("most"), F.count_if("sure").alias("n"), F.sum(F.when(F.col("sure"), F.col("t").cast("double"))).alias("s"), F.collect_list(F.when(~F.col("sure"), F.struct("u", F.col("t").cast("double").alias("t")))).alias("near"))
    first = F.slice(F.sort_array("near"), 1, F.greatest(F.lit(0), F.col("most") - F.col("n")).cast("int"))
    taken = F.aggregate(first, F.coalesce("s", F.lit(0.0)), lambda s, v: s + v["t"])
    cut_mean = sums.select("g", (taken / F.least(F.col("most"), F.col("n") + F.size("near"))).alias("cut"))
    padded = (F.col("sum_x") + (F.col("size") - F.col("n_x")) * F.lit(midpoint)) / F.col("size")
    mean = F.when(F.col("n_x") == 0, F.lit(None)).when(F.col("n_x") > F.col("size"), F.col("cut")).otherwise(padded)
    return groups.join(cut_mean, "g", "left").select("g", "size", mean.alias("mean_x"), "mean_y", "n_y")


def mean_resized(x: DataFrame, y: DataFrame, target: str, by: str, edges, midpoint: float, margin_share: float = 0.01, seed: int = 0) -> dict[str, float]:
    r = resized(x, y, target, by, edges, midpoint, margin_share, seed).agg(F.max(F.coalesce(F.abs(F.col("mean_x") - F.col("mean_y")), F.lit(0.0))), F.min(F.when(F.col("n_y") > 0, F.col("size")))).first()
    return {"max/diff": r[0] or 0.0, "min/size_by_second": float(r[1] or 1)}


def pearson(a: Column, b: Column) -> Column:
    """Correlation, null for a constant column, where corr() divides by zero."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


#: Cells of a pair's grid in Kendall's tau; beyond, values of the first column share a row of the grid.
GRID = 2_000_000


def kendall(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Tau-b of all pairs of columns, in a fixed number of jobs.

    Rows become distinct (a, b) cells with counts. On a grid of a (or blocks of its values, in order) by b, running
    sums along both axes give for each cell the rows before it in a and below or above it in b. Pairs within a
    block of several values of a are counted per block. The work is cells of the grid, never pairs of rows.
    """
    names = F.array(*(F.struct(F.lit(k).alias("k"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for k, (a, b) in enumerate(pairs)))
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    cells = staged(rows.select("n", F.explode(names).alias("p")).filter("p.a IS NOT NULL AND p.b IS NOT NULL").groupBy("p.k", "p.a", "p.b").agg(F.sum("n").alias("n")))
    ties = lambda c: cells.groupBy("k", c).agg(F.sum("n").alias("n")).groupBy("k").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("t"), F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"))
    ta, tb = ({r.k: r for r in ties(c).collect()} for c in "ab")
    size = {k: max(1, -(-ta[k].v * tb[k].v // GRID)) for k in ta}
    if not size:
        return dict.fromkeys(pairs)
    sizes = F.create_map(*(F.lit(v) for kv in size.items() for v in kv))
    values = ordered(cells.select("k", "a").distinct().withColumn("one", F.lit(1)), "a", ["one"], ["k"])
    blocks = values.select("k", "a", F.floor((F.col("upto_one") - 1) / sizes[F.col("k")]).alias("block"))
    blocked = staged(cells.join(blocks, ["k", "a"]))
    known = blocked.groupBy("k", "block", "b").agg(F.sum("n").alias("n"))
    grid = known.select("k", "block").distinct().join(known.select("k", "b").distinct(), "k").join(known, ["k", "block", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = lambda by, order: Window.partitionBy("k", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("earlier", F.coalesce(F.sum("n").over(before("b", "block")), F.lit(0)))
    after = Window.partitionBy("k", "block").orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    grid = grid.withColumns({"below": F.coalesce(F.sum("earlier").over(before("block", "b")), F.lit(0)), "above": F.coalesce(F.sum("earlier").over(after), F.lit(0))})
    net = {r.k: r.net for r in grid.groupBy("k").agg(F.sum(F.col("n").cast("double") * (F.col("below") - F.col("above"))).alias("net")).collect()}
    if max(size.values()) > 1:
        for r in blocked.groupBy("k", "block").applyInPandas(_net_in_block, "k int, net double").groupBy("k").agg(F.sum("net").alias("net")).collect():
            net[r.k] += r.net
    out = {}
    for k, p in enumerate(pairs):
        out[p] = None
        if k in net:
            n = ta[k].n * (ta[k].n - 1) / 2
            scale = math.sqrt(max(0.0, (n - ta[k].t) * (n - tb[k].t)))
            out[p] = net[k] / scale if scale else None
    return out


def _net_in_block(block: pd.DataFrame) -> pd.DataFrame:
    """Concordant less discordant pairs among the cells of a block: one value of a after the other."""
    block = block.sort_values(["a", "b"])
    values, at = np.unique(block.b.to_numpy(), return_inverse=True)
    n, seen, net = block.n.to_numpy(dtype=float), np.zeros(len(values)), 0.0
    for group in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block.a.to_numpy())) + 1):
        upto = np.cumsum(seen)
        net += float((n[group] * (upto[at[group]] - seen[at[group]] - (upto[-1] - upto[at[group]]))).sum())
        np.add.at(seen, at[group], n[group])
    return pd.DataFrame({"k": [int(block.k.iloc[0])], "net": [net]})


def correlations(df: DataFrame, method: str) -> dict[tuple[str, str], float | None]:
    pairs = list(combinations(df.columns, 2))
    if method == "kendall":
        return kendall(df, pairs)
    source = average_ranks(df, df.columns) if method == "spearman" else df
    row = source.agg(*(pearson(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    return {p: row[i] for i, p in enumerate(pairs)}


METHODS = ("pearson", "kendall", "spearman")


def correlation_metrics(x: DataFrame, y: DataFrame, running_max: bool = True) -> dict[str, float]:
    return correlation_differences(*({m: correlations(t, m) for m in METHODS} for t in (x, y)), running_max)


def correlation_differences(of_x: dict, of_y: dict, running_max: bool = True) -> dict[str, float]:
    """Absolute differences by method and pair, and their maximum: of all results so far, or of the method alone."""
    out: dict[str, float] = {}
    for m in of_x:
        cx, cy = of_x[m], of_y[m]
        now = {f"{m}/diff/{a}/{b}": abs(cx[a, b] - cy[a, b]) if cx[a, b] is not None and cy[a, b] is not None else math.nan for a, b in cx}
        seen = [v for v in (list(out.values()) if running_max else []) + list(now.values()) if not math.isnan(v)]
        out |= now | {f"{m}/diff/max": max(seen, default=math.nan)}
    return out


@dataclass(frozen=True)
class Linear:
    """Coefficients on standardised regressors, and the intercept."""

    coef: np.ndarray
    intercept: float
    mean: np.ndarray
    std: np.ndarray

    def predict(self, regressors: Sequence[str], bounds: tuple[float, float] | None = None) -> Column:
        p = F.lit(float(self.intercept))
        for k, c in enumerate(regressors):
            p = p + F.lit(float(self.coef[k])) * (F.col(c) - F.lit(float(self.mean[k]))) / F.lit(float(self.std[k]))
        return p if bounds is None else F.least(F.greatest(p, F.lit(float(bounds[0]))), F.lit(float(bounds[1])))


def moments(df: DataFrame) -> tuple[np.ndarray, float]:
    """Sums of products of the columns and a one, in one aggregate, and the number of rows."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in df.columns)]
    k = len(cols)
    row = df.agg(*(F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k))).first()
    out, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[at] or 0.0
            at += 1
    return out, out[0, 0]


def ols(sums: np.ndarray, mean: np.ndarray, std: np.ndarray) -> Linear:
    """Least squares of the last column on the others, standardised by the given mean and std."""
    k = len(sums) - 1
    # Rows of t turn (1, x..., y) into (1, z..., y).
    t = np.eye(k + 1)
    for i in range(1, k):
        t[i, 0], t[i, i] = -mean[i - 1] / std[i - 1], 1 / std[i - 1]
    s = t @ sums @ t.T
    beta, *_ = np.linalg.lstsq(s[:k, :k], s[:k, k], rcond=None)
    return Linear(beta[1:], float(beta[0]), mean, std)


def scaler(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = sums[0, 0] or 1.0
    mean = sums[0, 1:-1] / n
    std = np.sqrt(np.maximum(0, np.diag(sums)[1:-1] / n - mean**2))
    return mean, np.where(std > 0, std, 1.0)


def linear_regression(x: DataFrame, y: DataFrame, bounds: tuple[float, float] | None = None, scale: bool = True, fit_x: Callable[[np.ndarray, np.ndarray, np.ndarray], Linear] | None = None) -> dict[str, float]:
    """Differences of two regressions of the last column: coefficients (the intercept under the target's name), R2, MAE, and
    the cross MAE. Two jobs: sums of both tables, then errors of both models on both."""
    y = y.select(*x.columns)
    sx, sy = moments(x)[0], moments(y)[0]
    mean, std = scaler(sy) if scale else (np.zeros(len(sy) - 2), np.ones(len(sy) - 2))
    mx, my = (fit_x or ols)(sx, mean, std), ols(sy, mean, std)
    regressors, target = x.columns[:-1], x.columns[-1]
    aggs = []
    for t, s in (("x", sx), ("y", sy)):
        centre = s[0, -1] / (s[0, 0] or 1.0)
        for k, m in enumerate((mx, my)):
            e = F.col(target) - m.predict(regressors, bounds)
            aggs += [F.avg(_is(t, F.abs(e))).alias(f"mae_{t}{k}"), F.sum(_is(t, e * e)).alias(f"sse_{t}{k}")]
        aggs.append(F.sum(_is(t, (F.col(target) - F.lit(float(centre))) ** 2)).alias(f"sst_{t}"))
    r = tagged({"x": x, "y": y}, "_tag").agg(*aggs).first()
    names = [*regressors, target]
    errors = np.abs(np.r_[mx.coef, mx.intercept] - np.r_[my.coef, my.intercept])
    r2 = lambda t, k: 1 - r[f"sse_{t}{k}"] / r[f"sst_{t}"] if r[f"sst_{t}"] else 0.0
    return {
        **{f"coef/error/diff/{c}": float(e) for c, e in zip(names, errors)},
        "coef/error/diff/max": float(errors.max()), "coef/error/diff/total": float(errors.sum()),
        "R2/diff": abs(r2("x", 0) - r2("y", 1)), "MAE/diff": abs(r.mae_x0 - r.mae_y1),
        "MAE/cross/1-by-2": abs(r.mae_x0 - r.mae_x1), "MAE/cross/2-by-1": abs(r.mae_y1 - r.mae_y0),
    }


def propensity(x: DataFrame, y: DataFrame, seed: int = 0, trees: int = 100, depth: int = 3) -> dict[str, float]:
    """Gradient-boosted trees tell the tables apart: mean squared distance of the probability from a half, accuracy."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    both = tagged({"x": x, "y": y.select(*x.columns)}, "_tag").withColumn("label", (F.col("_tag") == "y").cast("double"))
    rows = VectorAssembler(inputCols=x.columns, outputCol="features").transform(both)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(rows)
    p = vector_to_array("probability")[1]
    r = model.transform(rows).agg(F.avg((p - 0.5) ** 2), F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()
    return {"score": r[0], "acc": r[1]}
