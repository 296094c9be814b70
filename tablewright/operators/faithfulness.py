"""Radius join and maximum matching between two tables.

Rows become configurations with counts. The join is an equi-join, never a nested loop: a column whose scaled values are all
multiples of a step above alpha must agree; another column is cut into cells of width alpha and one side visits its two
neighbour cells too. The exact weighted distance is the residual filter. Only as many columns are cut into cells as
pay: each triples one side.

The matching is over configurations (a flow with counts as capacities), split into blocks that no edge leaves: the
connected components, or the values of the exact columns. A block is solved on one executor; beta is one less the matched share and does not
depend on which maximum matching is found.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import scale_by_weights
from ..functions.stats import assignment
from ..sources.tables import staged
from .flows import match_counts
from .ranges import Ranges, match_ranges

#: Columns cut into cells, at most.
CELL_COLUMNS = 2
#: Edges (16 bytes each) up to which one task solves all of them; beyond, components are found and solved apart.
LOCAL_EDGES = 2_000_000
#: Edges of a component beyond which it is matched greedily only, for an upper bound on beta. None: no limit.
COMPONENT_EDGES = None
#: Rows from which on a radius join's tasks are not merged, and rows for which there is one task more.
DEALT_ROWS, DEALT_A_TASK = 100_000, 10_000
#: Algorithms and time limits where nothing is known of the density.
AUTO = (("push_relabel", 3600.0),)


def configurations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns..., n, id: a hash of the values, the same for equal rows of any table."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.xxhash64(*columns))


def _ranges(x: DataFrame, y: DataFrame, columns: Sequence[str], alpha: float) -> tuple[list[str], dict[str, int], int]:
    """Columns in which two values within alpha are equal: whole multiples of a step above alpha; and into how many cells of
    width alpha each column falls; and the number of rows. One aggregate."""
    both = x.select(*columns).unionByName(y.select(*columns))
    steps = [s for s in (math.floor(alpha) + 1, 10, 100, 1000) if s > alpha]
    cells = [F.approx_count_distinct(F.floor(F.col(c) / alpha)).alias(f"{c}|cells") for c in columns] if alpha > 0 else []
    row = both.agg(F.count(F.lit(1)).alias("|rows"), *cells, *(F.max(F.abs(F.col(c) - F.rint(F.col(c) / s) * s)).alias(f"{c}|{s}") for c in columns for s in steps)).first()
    return [c for c in columns if any((row[f"{c}|{s}"] or 0.0) == 0.0 for s in steps)], {c: row[f"{c}|cells"] or 0 for c in columns} if alpha > 0 else {}, row["|rows"]


def exact_columns(x: DataFrame, y: DataFrame, columns: Sequence[str], alpha: float) -> list[str]:
    return _ranges(x, y, columns, alpha)[0]


def radius_edges(x: DataFrame, y: DataFrame, columns: Sequence[str], alpha: float, p: float = 1, keys: Sequence[str] | None = None) -> DataFrame:
    """x_id, y_id, distance of all pairs of rows with a distance of at most alpha. x and y have an id."""
    exact, spread, rows = _ranges(x, y, columns, alpha)
    keys = exact if keys is None else list(keys)
    rest = [c for c in columns if c not in keys]
    celled = sorted(rest, key=lambda c: -spread.get(c, 0))[:CELL_COLUMNS] if alpha > 0 else []
    keys = keys if alpha > 0 else list(columns)
    a = x.select(F.col("id").alias("x_id"), *(F.col(c).alias(f"x_{c}") for c in columns), *(F.floor(F.col(c) / alpha).alias(f"k_{c}") for c in celled), *(F.col(c).alias(f"k_{c}") for c in keys))
    b = y.select(F.col("id").alias("y_id"), *(F.col(c).alias(f"y_{c}") for c in columns), *(F.col(c).alias(f"k_{c}") for c in keys))
    for c in celled:
        cell = F.floor(F.col(f"y_{c}") / alpha)
        b = b.withColumn(f"k_{c}", F.explode(F.array(cell - 1, cell, cell + 1)))
    on = [f"k_{c}" for c in [*keys, *celled]]
    total = reduce(lambda s, c: s + F.pow(F.abs(F.col(f"x_{c}") - F.col(f"y_{c}")), F.lit(float(p))) if p != 1 else s + F.abs(F.col(f"x_{c}") - F.col(f"y_{c}")), columns, F.lit(0.0))
    distance: Column = total if p == 1 else F.pow(total, F.lit(1.0 / p))
    if on and rows >= DEALT_ROWS:
        # As many tasks as the pairs ask for: by what the tables weigh, Spark would merge them to a few.
        a, b = (t.repartition(RANGE_TASKS + rows // DEALT_A_TASK, *on) for t in (a, b))
    joined = a.join(b, on) if on else a.crossJoin(b)
    return joined.withColumn("distance", distance).filter(F.col("distance") <= alpha).select("x_id", "y_id", "distance")


#: Types whose differences are the same in Spark and as doubles.
RANGE_TYPES = ("double", "int", "smallint", "tinyint")
#: Tasks that blocks of ranges are dealt to, and rows a task beyond which there are more.
RANGE_TASKS, RANGE_ROWS = 48, 100_000


def as_ranges(x: DataFrame, y: DataFrame, columns: Sequence[str]) -> bool:
    """Whether pairs can be counted and matched by ranges."""
    return all(t in RANGE_TYPES for df in (x, y) for c, t in df.dtypes if c in columns)


def _sides(x: DataFrame, y: DataFrame, columns: Sequence[str], on: Sequence[str], rows: int) -> DataFrame:
    """Both tables in one, told apart by `_x`, dealt by `on` to tasks that are not merged: what little they read says nothing
    of the work."""
    keep = ["id", "n", *on]
    both = [t.dropna(subset=list(columns)).select(*keep, *(F.col(c).cast("double").alias(f"v_{c}") for c in columns), F.lit(side).alias("_x")) for t, side in ((x, True), (y, False))]
    return both[0].unionByName(both[1]).repartition(RANGE_TASKS + rows // RANGE_ROWS, *on)


def _halves(batches, columns: Sequence[str], on: Sequence[str]):
    """A task's rows of x and of y, their values, and the numbers of their blocks; None without rows of both."""
    both = pd.concat(list(batches) or [pd.DataFrame({"_x": []})], ignore_index=True)
    if both["_x"].nunique() < 2:
        return None
    side = both["_x"].to_numpy(dtype=bool)
    block = both.groupby(list(on), sort=False).ngroup().to_numpy() if on else np.zeros(len(both), dtype=np.int64)
    values = both[[f"v_{c}" for c in columns]].to_numpy(dtype=float)
    return both[side], both[~side], values[side], values[~side], (block[side], block[~side])


def radius_counts(x: DataFrame, y: DataFrame, columns: Sequence[str], alphas: Sequence[float], p: float = 1) -> dict[float, tuple[int, int]]:
    """For each alpha the number of pairs within it, of configurations and of the rows that they stand for. x and y have id and
    n. No pair is made: on lines of rows that differ in one column alone, what is within alpha is a range (`ranges`). Cells are
    those of the radius join, but of one column."""
    alphas, widest = [float(a) for a in alphas], float(max(alphas))
    exact, spread, rows = _ranges(x, y, columns, widest)
    keys = exact if widest > 0 else list(columns)
    celled = sorted((c for c in columns if c not in keys), key=lambda c: -spread.get(c, 0))[:1]
    on = [f"k_{c}" for c in [*keys, *celled]]
    for c in keys:
        x, y = (t.withColumn(f"k_{c}", F.col(c).cast("double")) for t in (x, y))
    for c in celled:
        cell = F.floor(F.col(c) / F.lit(widest * (1 + 1e-9)))
        x, y = x.withColumn(f"k_{c}", cell), y.withColumn(f"k_{c}", F.explode(F.array(cell - 1, cell, cell + 1)))

    def count(batches):
        halves = _halves(batches, columns, on)
        if halves is None:
            return
        a, b, of_a, of_b, blocks = halves
        sums = [Ranges(of_a, of_b, alpha, p, blocks).sums(a["n"].to_numpy(), b["n"].to_numpy()) for alpha in alphas]
        yield pd.DataFrame({"alpha": alphas, "edges": [s[0] for s in sums], "rows": [s[1] for s in sums]})

    found = _sides(x, y, columns, on, rows).mapInPandas(count, "alpha double, edges long, rows long")
    got = {r.alpha: (int(r.edges), int(r.rows)) for r in found.groupBy("alpha").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("edges", "rows"))).collect()}
    return {a: got.get(a, (0, 0)) for a in alphas}


def solved_ranges(x: DataFrame, y: DataFrame, columns: Sequence[str], alphas: Sequence[float], p: float = 1, seconds: float | None = None) -> DataFrame:
    """Like `solved`, for each alpha, but no edge is ever a row: tasks get whole blocks of configurations that agree in the exact
    columns, and match them by ranges. For graphs with too many edges for one task."""
    exact, _, rows = _ranges(x, y, columns, float(max(alphas)))
    each = F.explode(F.array(*(F.lit(float(a)) for a in alphas)))
    on = ["alpha", *(f"k_{c}" for c in exact)]
    x, y = (t.select("*", *(F.col(c).cast("double").alias(f"k_{c}") for c in exact), each.alias("alpha")) for t in (x, y))

    def solve(batches):
        halves = _halves(batches, columns, on)
        if halves is None:
            return
        a, b, of_a, of_b, blocks = halves
        for alpha in np.unique(a["alpha"]):
            i, j = (np.flatnonzero(t["alpha"].to_numpy() == alpha) for t in (a, b))
            began = time.monotonic()
            r = Ranges(of_a[i], of_b[j], float(alpha), p, (blocks[0][i], blocks[1][j]))
            try:
                got = match_ranges(r, a["n"].to_numpy()[i], b["n"].to_numpy()[j], seconds)
            except TimeoutError:
                got = None
            u, v, k = (np.array(z, dtype=np.int64) for z in zip(*got)) if got else (np.zeros(0, dtype=np.int64),) * 3
            pairs = pd.DataFrame({"x_id": a["id"].to_numpy()[i[u]], "y_id": b["id"].to_numpy()[j[v]], "pairs": k}).astype("Int64")
            yield pairs.assign(algorithm=None, seconds=None, alpha=alpha)
            total = pd.array([None if got is None else int(k.sum())], dtype="Int64")
            none = pd.array([None], dtype="Int64")
            yield pd.DataFrame({"x_id": none, "y_id": none, "pairs": total, "algorithm": ["hopcroft_karp"], "seconds": [time.monotonic() - began], "alpha": [alpha]})

    return _sides(x, y, columns, on, rows).mapInPandas(solve, "x_id long, y_id long, pairs long, algorithm string, seconds double, alpha double")


def density(n_edges: float, n: int) -> float:
    return n_edges / (n * (n - 1) / 2) if n > 1 else 0.0


def neighbours(edges: DataFrame) -> DataFrame:
    """y_id, x_ids in order."""
    return edges.groupBy("y_id").agg(F.array_sort(F.collect_list("x_id")).alias("x_ids"))


def adjacency(edges: DataFrame) -> DataFrame:
    """A sparse matrix as coordinates: row (y), column (x), 1."""
    return edges.select(F.col("y_id").alias("row"), F.col("x_id").alias("column"), F.lit(1).alias("value"))


def edge_components(edges: DataFrame) -> DataFrame:
    """edges with a `block`: the least node of the component (x nodes and y nodes told apart). Label propagation with
    pointer jumping, each round written to the shared folder."""
    e = staged(edges.select("x_id", "y_id", F.xxhash64(F.lit("x"), "x_id").alias("u"), F.xxhash64(F.lit("y"), "y_id").alias("v")))
    both = e.select("u", "v").union(e.select("v", "u"))
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"u": "v", "label": "l"}), "v").groupBy("u").agg(F.min("l").alias("l"))
        new = labels.join(near, "u").select("u", F.least("label", "l").alias("next"), "label")
        jump = labels.select(F.col("u").alias("next"), F.col("label").alias("far"))
        new = staged(new.join(jump, "next").select("u", F.least("next", "far").alias("next"), "label"))
        changed = new.filter("next <> label").limit(1).count()
        labels = new.select("u", F.col("next").alias("label"))
        if not changed:
            return e.join(labels, "u").select("x_id", "y_id", F.col("label").alias("block"))


def solved(x: DataFrame, y: DataFrame, edges: DataFrame, candidates=AUTO, exact: bool = True, component_edges: int | None = COMPONENT_EDGES, local_edges: int = LOCAL_EDGES, most_edges: int | None = None) -> DataFrame:
    """x_id, y_id, pairs: how many rows of each configuration are matched; and for each block of edges that was solved a row
    without ids: its pairs (null if no candidate ended in time), algorithm, seconds. x and y have id and n. Edges may have
    an `alpha`: each alpha's edges are then matched on their own, and the result has it too.

    Candidates are (algorithm, seconds), tried in turn until one ends in time, or a dictionary of them by alpha."""
    keys = ["alpha"] if "alpha" in edges.columns else []
    if most_edges is None:
        most_edges = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("e")).agg(F.max("e")).first()[0] or 0
    if most_edges <= local_edges:
        blocks = edges.withColumn("block", F.lit(0))
    elif keys:
        alphas = [r.alpha for r in edges.select("alpha").distinct().collect()]
        parts = [edge_components(edges.filter(F.col("alpha") == a).drop("alpha")).withColumn("alpha", F.lit(a)) for a in alphas]
        blocks = reduce(DataFrame.unionByName, parts)
    else:
        blocks = edge_components(edges)
    blocks = blocks.select(*keys, "block", "x_id", "y_id").join(x.select(F.col("id").alias("x_id"), F.col("n").alias("nx")), "x_id").join(y.select(F.col("id").alias("y_id"), F.col("n").alias("ny")), "y_id")

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        full = exact and (component_edges is None or len(block) <= component_edges)
        supply, demand = dict(zip(block.x_id, block.nx)), dict(zip(block.y_id, block.ny))
        got, name, took = None, None, 0.0
        for name, seconds in candidates[float(block.alpha.iloc[0])] if isinstance(candidates, dict) else candidates:
            began = time.monotonic()
            try:
                got = match_counts(block.x_id.to_numpy(), block.y_id.to_numpy(), supply, demand, full, name, seconds)
            except TimeoutError:
                continue
            took = time.monotonic() - began
            break
        rows = [(u, v, k, None, None) for (u, v), k in (got or {}).items()]
        rows.append((None, None, None if got is None else sum(got.values()), name if full else "greedy", took))
        whole = zip(("x_id", "y_id", "pairs"), zip(*(r[:3] for r in rows)))
        out = pd.DataFrame({k: pd.array(list(v), dtype="Int64") for k, v in whole}).assign(algorithm=[r[3] for r in rows], seconds=[r[4] for r in rows])
        return out.assign(**{k: block[k].iloc[0] for k in keys})

    return blocks.groupBy(*keys, "block").applyInPandas(solve, "x_id long, y_id long, pairs long, algorithm string, seconds double" + ", alpha double" * bool(keys))


def matching(x: DataFrame, y: DataFrame, edges: DataFrame, exact: bool = True, component_edges: int | None = COMPONENT_EDGES, local_edges: int = LOCAL_EDGES, candidates=AUTO) -> DataFrame:
    """x_id, y_id, pairs (and alpha): how many rows of each configuration are matched."""
    return solved(x, y, edges, candidates, exact, component_edges, local_edges).filter("x_id IS NOT NULL").drop("algorithm", "seconds")


def unmatched(table: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """id, left: configurations with rows that no pair uses."""
    used = pairs.groupBy(F.col(side).alias("id")).agg(F.sum("pairs").alias("used"))
    return table.join(used, "id", "left").select("id", (F.col("n") - F.coalesce("used", F.lit(0))).alias("left")).filter(F.col("left") > 0)


def matching_info(x: DataFrame, y: DataFrame, pairs: DataFrame) -> dict:
    """beta, and the configurations with rows left on either side (id, left)."""
    n, size = x.agg(F.sum("n")).first()[0] or 0, pairs.agg(F.sum("pairs")).first()[0] or 0
    return {"beta": 1 - size / n if n else 0.0, "size": size, "unmatched_x": unmatched(x, pairs, "x_id"), "unmatched_y": unmatched(y, pairs, "y_id")}


def auto_candidates(dens: float, n: int) -> list[tuple[str, float]]:
    """Algorithms and their time limits in order. The published strategy tries Hopcroft-Karp for 300 s below this
    density and size, and push-relabel for 3,600 s in any case."""
    return ([("hopcroft_karp", 300.0)] if dens < 0.005 and n < 50_000 else []) + [("push_relabel", 3600.0)]


def evaluate(x: DataFrame, y: DataFrame, weights: dict, alphas: Sequence[float], p: float = 1, candidates="auto") -> list[dict]:
    """A row for each alpha: alpha, beta, density, algorithm (that solved it), duration (its seconds), pairs
    (configurations), unmatched. Candidates are tried in turn until one ends in time; if none does, beta is NaN. One radius join
    at the largest alpha and one matching job serve all. Beyond LOCAL_EDGES edges "auto" makes none of them: Hopcroft-Karp over
    ranges solves all, within the longest of the time limits. Tables must have as many rows."""
    columns = x.columns
    cx, cy = (staged(configurations(scale_by_weights(t.select(*columns), weights), columns)) for t in (x, y))
    n, m = (r.n or 0 for r in cx.agg(F.sum("n").alias("n")).withColumn("t", F.lit(0)).union(cy.agg(F.sum("n").alias("n")).withColumn("t", F.lit(1))).orderBy("t").collect())
    if n != m:
        raise AssertionError(f"{n} rows against {m}")
    stats = radius_counts(cx, cy, columns, alphas, p) if as_ranges(cx, cy, columns) else None
    if stats is None or candidates != "auto" or max(e for e, _ in stats.values()) <= LOCAL_EDGES:
        edges = radius_edges(cx, cy, columns, max(alphas), p)
        within = F.filter(F.array(*(F.lit(float(a)) for a in alphas)), lambda a: a >= F.col("distance"))
        near = staged(edges.select("x_id", "y_id", F.explode(within).alias("alpha")))
        if stats is None:
            rows = near.join(cx.select(F.col("id").alias("x_id"), F.col("n").alias("a")), "x_id").join(cy.select(F.col("id").alias("y_id"), F.col("n").alias("b")), "y_id")
            counted = rows.groupBy("alpha").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("a") * F.col("b")).alias("rows")).collect()
            stats = {float(a): (0, 0) for a in alphas} | {r.alpha: (r.edges, r.rows) for r in counted}
    else:
        near = None
    dens = {a: density(r, n) for a, (_, r) in stats.items()}
    plans = {a: auto_candidates(v, n) if candidates == "auto" else list(candidates) for a, v in dens.items()}
    if near is None:
        every = staged(solved_ranges(cx, cy, columns, alphas, p, max(s for plan in plans.values() for _, s in plan)))
    else:
        every = staged(solved(cx, cy, near, plans, most_edges=max(e for e, _ in stats.values())))
    info = every.filter("x_id IS NULL").groupBy("alpha").agg(F.sum("pairs").alias("size"), F.count_if(F.col("pairs").isNull()).alias("late"), F.max_by("algorithm", "seconds").alias("algorithm"), F.sum("seconds").alias("seconds"))
    info, out = {r.alpha: r for r in info.collect()}, []
    for alpha in map(float, alphas):
        pairs = every.filter((F.col("alpha") == alpha) & F.col("x_id").isNotNull()).select("x_id", "y_id", "pairs")
        got = info.get(alpha)
        late = bool(got and got.late)
        beta = float("nan") if late else 1 - (got.size if got else 0) / n if n else 0.0
        out.append({"alpha": alpha, "beta": beta, "density": dens[alpha], "algorithm": got.algorithm if got else "", "duration": float("nan") if late else got.seconds if got else 0.0, "pairs": pairs, "unmatched_x": unmatched(cx, pairs, "x_id"), "unmatched_y": unmatched(cy, pairs, "y_id")})
    return out


def minimum_cost_assignment(x: DataFrame, y: DataFrame, columns: Sequence[str], weights: dict, p: float = 1, limit: int = 2_000) -> list[tuple[int, int, float]]:
    """Row numbers and cost of a cheapest pairing of two small tables, on the driver; ValueError beyond `limit` rows."""
    rows = [np.array(scale_by_weights(t.select(*columns), weights).limit(limit + 1).collect(), dtype=float).reshape(-1, len(columns)) for t in (x, y)]
    if len(rows[0]) != len(rows[1]) or len(rows[0]) > limit:
        raise ValueError("tables must have as many rows, and few")
    cost = (np.abs(rows[0][:, None] - rows[1][None]) ** p).sum(axis=2) ** (1 / p)
    return [(i, j, float(cost[i, j])) for i, j in enumerate(assignment(cost))]


def matched_costs(x: DataFrame, y: DataFrame, pairs: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """How many columns matched configurations differ in (changed, pairs), and each column's mean and largest
    absolute difference."""
    a = x.select(F.col("id").alias("x_id"), *(F.col(c).alias(f"x_{c}") for c in columns))
    b = y.select(F.col("id").alias("y_id"), *(F.col(c).alias(f"y_{c}") for c in columns))
    both = pairs.join(a, "x_id").join(b, "y_id")
    gap = {c: F.abs(F.col(f"x_{c}") - F.col(f"y_{c}")) for c in columns}
    changed = both.withColumn("changed", reduce(lambda s, g: s + (g > 0).cast("int"), gap.values(), F.lit(0))).groupBy("changed").agg(F.sum("pairs").alias("pairs"))
    stats = both.agg(*(f for c, g in gap.items() for f in ((F.sum(g * F.col("pairs")) / F.sum("pairs")).alias(f"{c}_mean"), F.max(g).alias(f"{c}_max"))))
    return changed, stats
