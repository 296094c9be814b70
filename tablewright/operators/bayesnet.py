"""A differentially private Bayesian network: structure by the exponential mechanism, noisy marginals, sampling.

Columns hold codes from 0. A column's taxonomy has levels: level 0 is the codes, each further level merges them. What
touches the data is counting: all candidate pairs of a greedy step are counted in one job, over cells of
the full table that are counted once. Scores, noise and choices are on the driver, from bounded tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import clip
from ..sources.tables import staged
from . import mechanisms as dp

#: Codes in a group of a taxonomy level.
GROUP = 4
#: Cells of a marginal, at most: they are on the driver with their noise.
MOST_CELLS = 5_000_000


def taxonomy(size: int, group: int = GROUP) -> list[list[int]]:
    """For each level the group of every code.

    Groups nest from the right: level k merges the codes of the last k groups. 12 codes have levels of 12, 9 and 5
    groups; up to `group` codes have one level.
    """
    opens = list(range(group, size, group))
    levels = [list(range(size))]
    for start in reversed(opens):
        levels.append([min(v, start) for v in range(size)])
    return levels


@dataclass(frozen=True, order=True)
class Attribute:
    column: int
    level: int = 0


@dataclass(frozen=True)
class Dependence:
    child: int
    parents: tuple[Attribute, ...] = ()


@dataclass
class Domain:
    names: list[str]
    sizes: list[int]
    levels: list[list[list[int]]] = field(default_factory=list)

    def __post_init__(self):
        self.levels = self.levels or [taxonomy(s) for s in self.sizes]

    def width(self, a: Attribute) -> int:
        return max(self.levels[a.column][a.level]) + 1

    def depth(self, column: int) -> int:
        return len(self.levels[column])

    def code(self, a: Attribute) -> Column:
        """The generalised code of an attribute: since a level merges a tail of the codes, a minimum."""
        c = F.col(f"`{self.names[a.column]}`").cast("int")
        groups = self.levels[a.column][a.level]
        if groups == [min(v, max(groups)) for v in range(len(groups))]:
            return F.least(c, F.lit(max(groups)))
        return F.element_at(F.array(*map(F.lit, groups)), c + 1)

    def specialise(self, a: Attribute, group: int) -> tuple[int, int]:
        """The codes, from and up to but without, that a group stands for."""
        at = [v for v, g in enumerate(self.levels[a.column][a.level]) if g == group]
        return at[0], at[-1] + 1

    def table(self, df_session) -> DataFrame:
        """column, level, code, group of all taxonomies."""
        rows = [(n, l, v, g) for n, levels in zip(self.names, self.levels) for l, groups in enumerate(levels) for v, g in enumerate(groups)]
        return df_session.createDataFrame(rows, "column string, level int, code int, group int")


def grid_code(c: Column, low: float, high: float, depth: int = 4) -> Column:
    """A continuous value's cell of 2^depth equal ones, over a range widened by 3 % of its length."""
    low, high = low - 0.03 * (high - low), high + 0.03 * (high - low)
    step = (high - low) / 2**depth + 1e-8
    return clip(F.floor((c - F.lit(low)) / F.lit(step)), 0, 2**depth - 1).cast("int")


def grid_centre(code: Column, low: float, high: float, depth: int = 4) -> Column:
    low, high = low - 0.03 * (high - low), high + 0.03 * (high - low)
    return F.lit(low) + (code + 0.5) * F.lit((high - low) / 2**depth + 1e-8)


def cells(df: DataFrame, domain: Domain) -> DataFrame:
    """Distinct rows with counts: all marginals are sums of these."""
    return df.groupBy(*(F.col(f"`{n}`") for n in domain.names)).agg(F.count(F.lit(1)).alias("n"))


def marginals(cell_table: DataFrame, domain: Domain, wanted: Sequence[tuple[Attribute, ...]]) -> dict[tuple[Attribute, ...], np.ndarray]:
    """Counts of every cell of each marginal, zeros too, all in one job: a cell adds to each marginal at the mixed-radix
    place of its codes, the last attribute fastest."""
    wanted = list(dict.fromkeys(wanted))
    shapes = [[domain.width(a) for a in w] for w in wanted]
    for w, s in zip(wanted, shapes):
        if math.prod(s) > MOST_CELLS:
            raise ValueError(f"a marginal of {math.prod(s)} cells")
    out = [np.zeros(math.prod(s)) for s in shapes]
    places = []
    for k, (w, s) in enumerate(zip(wanted, shapes)):
        place = F.lit(0).cast("long")
        for a, width in zip(w, s):
            place = place * width + domain.code(a).cast("long")
        places.append(F.struct(F.lit(k).alias("k"), place.alias("place")))
    sums = cell_table.select("n", F.explode(F.array(*places)).alias("m")).groupBy("m.k", "m.place").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():
        out[r.k][r.place] = r.n
    return {w: o.reshape(s or [1]) for w, o, s in zip(wanted, out, shapes)}


def score_r(joint: np.ndarray) -> float:
    """Sum of |P(child, parents) - P(child) P(parents)|; the child is the last axis."""
    p = joint.reshape(-1, joint.shape[-1]) / max(joint.sum(), 1e-300)
    return float(np.abs(p - p.sum(1, keepdims=True) * p.sum(0, keepdims=True)).sum())


def score_i(joint: np.ndarray) -> float:
    """Mutual information of child and parents, in bits."""
    p = joint.reshape(-1, joint.shape[-1]) / max(joint.sum(), 1e-300)
    q = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    seen = p > 0
    return float((p[seen] * np.log2(p[seen] / q[seen])).sum())


def sensitivity(n: int, score: str = "R") -> float:
    if score == "R":
        return 6 / n
    return 2 / n * math.log2((n + 1) / 2) + (n - 1) / n * math.log2((n + 1) / max(n - 1, 1e-12))


def parent_sets(domain: Domain, placed: Sequence[int], budget: float, by_degree: bool) -> list[tuple[Attribute, ...]]:
    """Maximal sets of generalised parents within a budget: of cells (at least one must be left), or of parents.

    The last placed column takes part at its finest level, at a coarser one, or not at all; each choice leaves a budget for
    the columns before it. A set of earlier columns goes with the first choice that affords it, and with no later one.
    """
    if budget < (0 if by_degree else 1):
        return []
    if not placed:
        return [()]
    levels = [Attribute(placed[-1], k) for k in range(1 if by_degree else domain.depth(placed[-1]))]
    choices = [((a,), budget - 1 if by_degree else budget / domain.width(a)) for a in levels] + [((), budget)]
    best: dict[tuple[Attribute, ...], tuple[Attribute, ...]] = {}
    for own, left in choices:
        for earlier in parent_sets(domain, placed[:-1], left, by_degree):
            best.setdefault(earlier, own)
    return [earlier + own for earlier, own in best.items()]


def cell_bound(n: int, d: int, theta: float, epsilon: float, most: float = 2e12) -> float:
    """Cells of a marginal whose counts stay useful: epsilon n / (4 d theta), halved while the candidates are too many."""
    bound = epsilon * n / (4 * d * theta)
    while bound > 1 and n * math.comb(d, max(0, min(d, int(math.log2(bound))))) > most:
        bound /= 2
    return bound


class BayesNet:
    """Fit with theta (usefulness of counts) or degree (number of parents), exactly one of them."""

    def __init__(self, epsilon: float, epsilon_split: float = 0.3, theta: float | None = None, degree: int | None = None, score: str = "R"):
        if (theta is None) == (degree is None):
            raise ValueError("give theta or degree, one of them")
        self.epsilon, self.split, self.theta, self.degree, self.score = epsilon, epsilon_split, theta, degree, score
        self.transcript: list[dict] = []

    def fit(self, df: DataFrame, domain: Domain) -> BayesNet:
        self.domain = domain
        table = staged(cells(df, domain))
        self.n = int(table.agg(F.sum("n")).first()[0] or 0)
        if not self.n:
            raise ValueError("an empty table has no network")
        self.structure = self._greedy(table)
        self._noisy_marginals(table)
        return self

    def _candidates(self, placed: list[int], left: list[int], bound: float) -> list[Dependence]:
        out = []
        for x in left:
            budget = self.degree if self.degree is not None else bound / self.domain.width(Attribute(x))
            found = list(dict.fromkeys(parent_sets(self.domain, sorted(placed), budget, self.degree is not None)))
            out += [Dependence(x, p) for p in found] or [Dependence(x)]
        return out

    def _greedy(self, table: DataFrame) -> list[Dependence]:
        d = len(self.domain.names)
        bound = cell_bound(self.n, d, self.theta, (1 - self.split) * self.epsilon) if self.theta is not None else 0.0
        placed, left, chosen, known = [], list(range(d)), [], {}
        for step in range(d):
            options = self._candidates(placed, left, bound)
            keys = {o: (*o.parents, Attribute(o.child)) for o in options}
            known |= marginals(table, self.domain, [k for k in keys.values() if k not in known]) if any(k not in known for k in keys.values()) else {}
            score = score_r if self.score == "R" else score_i
            quality = [score(known[keys[o]]) for o in options]
            # The first column's choice tells nothing: without parents all scores are 0.
            epsilon = 1000.0 if step == 0 else self.split * self.epsilon / (d - 1)
            pick = options[dp.exponential_choice(quality, epsilon, sensitivity(self.n, self.score))]
            self.transcript.append({"stage": "structure", "child": self.domain.names[pick.child], "parents": [f"{self.domain.names[a.column]}@{a.level}" for a in pick.parents], "options": len(options), "score": quality[options.index(pick)]})
            chosen.append(pick)
            placed.append(pick.child)
            left.remove(pick.child)
        return chosen

    def _noisy_marginals(self, table: DataFrame) -> None:
        d = len(self.structure)
        scale = 2 * d / ((1 - self.split) * self.epsilon)
        exact = marginals(table, self.domain, [(*s.parents, Attribute(s.child)) for s in self.structure])
        self.noisy = {}
        for s in self.structure:
            counts = exact[*s.parents, Attribute(s.child)]
            noise = np.array([dp.laplace_noise(scale) for _ in range(counts.size)]).reshape(counts.shape)
            self.noisy[s] = counts + noise
            self.transcript += [{"stage": "noise", "child": self.domain.names[s.child], "count": float(c), "noise": float(e), "noisy": float(c + e)} for c, e in zip(counts.ravel(), noise.ravel())][:1000]

    def sample(self, spark, n: int, seed: int = 0) -> DataFrame:
        """n rows, columns in the order of the structure: each is drawn from its conditional table, which is broadcast
        (bounded by MOST_CELLS), given the columns before. Negative counts are 0, a row of zeros is uniform."""
        out = spark.range(n)
        for k, s in enumerate(self.structure):
            table = np.maximum(self.noisy[s].reshape(-1, self.noisy[s].shape[-1]), 0.0)
            table[table.sum(1) == 0] = 1.0
            upto = np.cumsum(table, axis=1) / table.sum(1, keepdims=True)
            rows = spark.createDataFrame([(i, u[:-1].tolist()) for i, u in enumerate(upto)], "_place long, _upto array<double>")
            place = F.lit(0).cast("long")
            for a in s.parents:
                place = place * self.domain.width(a) + self.domain.code(a).cast("long")
            u = F.rand(seed + k)
            drawn = out.withColumn("_place", place).withColumn("_u", u).join(F.broadcast(rows), "_place")
            code = F.size(F.filter("_upto", lambda e: e <= F.col("_u")))
            out = drawn.withColumn(self.domain.names[s.child], code.cast("int")).drop("_place", "_upto", "_u")
        return staged(out.select(*(F.col(f"`{x}`") for x in self.domain.names)))

    def log(self, spark) -> DataFrame:
        rows = [(t["stage"], t["child"], ",".join(t.get("parents", [])), t.get("options"), t.get("score"), t.get("count"), t.get("noise"), t.get("noisy")) for t in self.transcript]
        return spark.createDataFrame(rows, "stage string, child string, parents string, options int, score double, `count` double, noise double, noisy double")

    def total_information(self, df: DataFrame) -> float:
        """Sum of the mutual information of every column with its parents."""
        known = marginals(staged(cells(df, self.domain)), self.domain, [(*s.parents, Attribute(s.child)) for s in self.structure])
        return math.fsum(score_i(known[*s.parents, Attribute(s.child)]) for s in self.structure)
