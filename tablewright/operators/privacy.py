"""Disclosure measures: uniques, k-anonymity, l-diversity, attacks, baselines and mitigations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged
from .faithfulness import radius_edges
from .filters import duplicated
from .profile import frequency_of_frequencies, histogram, n_histograms, replicated


#: Ranges of random keys in a sample of exact size.
RANGES = 4096


def uniques(df: DataFrame, up_to: int) -> DataFrame:
    return frequency_of_frequencies(histogram(df), up_to)


def k_anonymity(df: DataFrame, quasi: Sequence[str], up_to: int) -> DataFrame:
    return frequency_of_frequencies(histogram(df, list(quasi)), up_to)


def l_diversity(df: DataFrame, quasi: Sequence[str], sensitive: str, up_to: int) -> DataFrame:
    return frequency_of_frequencies(df.groupBy(*quasi).agg(F.count_distinct(sensitive).alias("n")), up_to)


def face_table(df: DataFrame, up_to: int, pairs: Sequence[tuple[Sequence[str], str]] = ()) -> DataFrame:
    """param, value, metric, quasi, sensitive, name, type: all measures, and the largest value of each metric and
    parameter as `<metric>/<param>/max` rows."""
    null = F.lit(None).cast("string")

    def rows(d: DataFrame, metric: str, quasi: Column = null, sensitive: Column = null) -> DataFrame:
        return d.select("param", "value", F.lit(metric).alias("metric"), quasi.alias("quasi"), sensitive.alias("sensitive"), F.concat_ws("/", F.lit(metric), F.col("param").cast("string")).alias("name"), F.lit("single").alias("type"))

    parts = [rows(uniques(df, up_to), "unique")]
    for quasi in dict.fromkeys(tuple(q) for q, _ in pairs):
        parts.append(rows(k_anonymity(df, quasi, up_to), "k-anonymity", F.lit(";".join(quasi))))
    for quasi, sensitive in pairs:
        parts.append(rows(l_diversity(df, quasi, sensitive, up_to), "l-diversity", F.lit(";".join(quasi)), F.lit(sensitive)))
    single = reduce(DataFrame.unionByName, parts)
    top = single.groupBy("metric", "param").agg(F.max("value").alias("value"))
    top = top.select("param", "value", "metric", null.alias("quasi"), null.alias("sensitive"), F.concat_ws("/", "metric", F.col("param").cast("string"), F.lit("max")).alias("name"), F.lit("max").alias("type"))
    return single.unionByName(top)


def replicated_uniques(original: DataFrame, release: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys that are unique in the release, those unique in the original too, and their shares of keys and rows."""
    h = n_histograms({"original": original, "release": release}, keys)
    once = F.col("release") == 1
    r = h.agg(F.count_if(once).alias("unique_release"), F.count_if(once & (F.col("original") == 1)).alias("replicated"), F.count_if(F.col("release") > 0).alias("keys"), F.sum("release").alias("rows"))
    return r.select("unique_release", "replicated", (100.0 * F.col("replicated") / F.col("keys")).alias("pct_keys"), (100.0 * F.col("replicated") / F.col("rows")).alias("pct_rows"))


def apparent_match(original: DataFrame, release: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame:
    """One row: quasi groups with one sensitive value in the release; with the same single value in the original."""
    both = release.select(*quasi, F.col(sensitive).alias("s"), F.lit(True).alias("r")).unionByName(original.select(*quasi, F.col(sensitive).alias("s"), F.lit(False).alias("r")))
    side = lambda of, f: f(F.when(F.col("r") if of == "r" else ~F.col("r"), F.col("s")))
    g = both.groupBy(*quasi).agg(side("r", F.count_distinct).alias("nr"), side("o", F.count_distinct).alias("no"), side("r", F.min).alias("vr"), side("o", F.min).alias("vo"), side("r", F.count).alias("size"))
    return g.agg(F.count_if(F.col("nr") == 1).alias("apparent"), F.count_if((F.col("nr") == 1) & (F.col("no") == 1) & (F.col("vr") == F.col("vo"))).alias("exact"), F.sum(F.when((F.col("nr") == 1) & (F.col("no") == 1) & (F.col("vr") == F.col("vo")), F.col("size")).otherwise(0)).alias("rows"))


def approximate_match(original: DataFrame, release: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame:
    """One row: mean difference of the group means of a coded sensitive column, weighted by the release's group sizes."""
    a = original.groupBy(*quasi).agg(F.avg(sensitive).alias("mo"))
    b = release.groupBy(*quasi).agg(F.avg(sensitive).alias("mr"), F.count(F.lit(1)).alias("n"))
    return a.join(b, list(quasi)).agg((F.sum(F.abs(F.col("mo") - F.col("mr")) * F.col("n")) / F.sum("n")).alias("weighted_diff"))


def cumulative(counts: DataFrame, column: str = "n") -> DataFrame:
    """k, groups and rows with a count of k, and both up to k."""
    per = counts.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("groups"), F.sum(column).alias("rows"))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("k", "groups", "rows", F.sum("groups").over(upto).alias("groups_upto"), F.sum("rows").over(upto).alias("rows_upto"))


def weighted_choice(weights: Sequence[tuple[object, float]], u: Column) -> Column:
    """A value by its weight from a uniform number: the first whose cumulative share exceeds it."""
    total = float(sum(w for _, w in weights))
    out, upto, run = None, [], 0.0
    for v, w in weights:
        run += w
        upto.append((v, run / total))
    for v, edge in upto[:-1]:
        out = F.when(u < edge, F.lit(v)) if out is None else out.when(u < edge, F.lit(v))
    return F.lit(weights[-1][0]) if out is None else out.otherwise(F.lit(weights[-1][0]))


def baseline(df: DataFrame, n: int, kind: str = "univariate", seed: int = 0, public: DataFrame | None = None, limit: int = 10_000) -> DataFrame:
    """n rows of independent columns: uniform over each column's values, by their shares (univariate), or by the shares
    in a public table. A column of up to `limit` values is drawn in place; of one with more, rows (or values) are drawn
    with replacement and joined by their number."""
    source = public if kind == "public" else df
    cols, drawn = [], []
    for i, c in enumerate(df.columns):
        counts = source.groupBy(c).count().limit(limit + 1).collect()
        if len(counts) > limit:
            values = source.select(F.col(c).alias(f"_{i}"))
            drawn.append((i, sample(values.distinct() if kind == "uniform" else values, n, seed + i, True, "id")))
        else:
            counts.sort(key=lambda r: (r[0] is not None, r[0]))
            cols.append(weighted_choice([(r[0], 1 if kind == "uniform" else r[1]) for r in counts], F.rand(seed + i)).alias(f"_{i}"))
    out = df.sparkSession.range(n).select("id", *cols)
    for _, d in drawn:
        out = out.join(d, "id")
    return staged(out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(df.columns))))


def resample_uniques(df: DataFrame, seed: int = 0) -> DataFrame:
    """Unique rows give way to copies of other rows, drawn with replacement."""
    keep, lost = staged(duplicated(df)), duplicated(df, unique=True).count()
    return keep.unionByName(sample(keep, lost, seed, True))


def double_uniques(df: DataFrame, replace: bool = False, seed: int = 0) -> DataFrame:
    """Half of the unique rows twice, or as many drawn with replacement."""
    once = staged(duplicated(df, unique=True))
    n = once.count()
    chosen = sample(once, n // 2, seed, replace)
    extra = sample(once, n % 2, seed + 1, False)
    return duplicated(df).unionByName(replicated(chosen, 2)).unionByName(extra)


def sample(df: DataFrame, n: int, seed: int = 0, replace: bool = False, number: str | None = None) -> DataFrame:
    """Exactly n rows; with replacement they may have their numbers, from 0, in the column `number`. Without replacement those with the n smallest random keys: the counts of RANGES ranges of keys
    say which range holds the n-th, and only that one is put in order. With replacement each row's number of draws
    follows from the numbers drawn, which are spread over tasks as row numbers and joined."""
    if n <= 0:
        return df.limit(0)
    if not replace:
        keyed = staged(df.withColumn("_u", F.rand(seed))).withColumn("_r", F.floor(F.col("_u") * RANGES))
        before, last = 0, RANGES
        for r in keyed.groupBy("_r").count().orderBy("_r").collect():
            if before + r["count"] > n:
                last = r["_r"]
                break
            before += r["count"]
        rest = keyed.filter(F.col("_r") == last).orderBy("_u").limit(max(0, n - before))
        return staged(keyed.filter(F.col("_r") < last).unionByName(rest).drop("_u", "_r"))
    numbered = staged(df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    parts = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("c"), F.min("_i").alias("lo")).orderBy("_p").collect()
    total = sum(r.c for r in parts)
    if not total:
        raise ValueError("nothing to draw from")
    draw = F.floor(F.rand(seed) * total)
    draws = staged(df.sparkSession.range(n).select(F.col("id").alias("_n"), draw.alias("_d"))).select("_n", _row_of(parts).alias("_i"))
    out = draws.join(numbered, "_i").drop("_i", "_p")
    return staged(out.withColumnRenamed("_n", number) if number else out.drop("_n"))


def _row_of(parts) -> Column:
    """The row number of the draw-th row, from the first row number and size of each partition."""
    starts, start = [], 0
    for r in parts:
        starts.append(start)
        start += r.c
    at = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("_d")))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    return (F.col("_d") - pick(starts) + pick([r.lo for r in parts])).cast("long")


#: Rows of a table (8 bytes a column each) that are sent to all tasks at a time.
BLOCK_ROWS = 100_000


def distances(x: DataFrame, y: DataFrame, columns: Sequence[str], p: int = 1) -> DataFrame:
    """x_id, y_id, distance of all pairs of two id-keyed tables. As many rows as pairs: for the nearest rows see nearest(),
    for how distances are spread distance_counts()."""
    a = x.select(F.col("id").alias("x_id"), *(F.col(c).alias(f"x_{c}") for c in columns))
    b = y.select(F.col("id").alias("y_id"), *(F.col(c).alias(f"y_{c}") for c in columns))
    total = reduce(lambda s, c: s + F.pow(F.abs(F.col(f"x_{c}") - F.col(f"y_{c}")), F.lit(p)), columns, F.lit(0.0))
    b = F.broadcast(b) if b.count() <= BLOCK_ROWS else b
    return a.crossJoin(b).select("x_id", "y_id", F.pow(total, F.lit(1.0 / p)).alias("distance"))


def distance_counts(x: DataFrame, y: DataFrame, columns: Sequence[str], edges: Sequence[float], p: float = 1) -> DataFrame:
    """edge, n, share: pairs of a row of x and a row of y with a distance of at most each edge, that is the distribution
    function of all pair distances. Rows are counted by value first; values of y go to the tasks in blocks, and a task
    returns a count for each edge, so no pair is ever a row. Of x against itself, pairs of a row with itself count too."""
    a, b = (t.select(*(F.col(c).cast("double").alias(c) for c in columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")) for t in (x, y))
    a, edges, parts = staged(a), np.array(sorted(edges), dtype=float), []

    def against(block):
        def run(batches):
            total = np.zeros(len(edges), dtype=np.int64)
            at, n = block.value
            for batch in batches:
                own, many = np.stack([c.to_numpy() for c in batch.columns[:-1]], axis=1), batch.columns[-1].to_numpy()
                for row, m in zip(own, many):
                    d = (np.abs(at - row) ** p).sum(axis=1) ** (1 / p)
                    # Counts of the first edge that each distance fits under.
                    first = np.bincount(np.searchsorted(edges, d), n, len(edges) + 1)[:-1]
                    total += m * first.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edges), pa.array(total)], names=["edge", "n"])

        return run

    def flush(rows):
        block = x.sparkSession.sparkContext.broadcast((np.array([r[:-1] for r in rows], dtype=float).reshape(len(rows), len(columns)), np.array([r[-1] for r in rows])))
        parts.append(staged(a.mapInArrow(against(block), "edge double, n long").groupBy("edge").agg(F.sum("n").alias("n"))))

    rows = []
    for r in b.toLocalIterator():
        rows.append(tuple(r))
        if len(rows) == BLOCK_ROWS:
            flush(rows)
            rows = []
    flush(rows)
    found = reduce(DataFrame.union, parts).groupBy("edge").agg(F.sum("n").alias("n"))
    every = float(x.count() * y.count()) or 1.0
    running = F.sum("n").over(Window.orderBy("edge"))
    return found.select("edge", running.alias("n"), (running / every).alias("share"))


def nearest(x: DataFrame, y: DataFrame, columns: Sequence[str], k: int = 1, p: float = 1, others: bool = False) -> DataFrame:
    """x_id, y_id, distance, r: the k nearest rows of y to each row of x, ties by id; with others (x and y are one table) but
    the row itself.

    Exact, by radius joins: those of small radius serve where rows are dense; only rows that have too few rows within it
    meet a radius three times as wide. Equal rows of x are searched for once, and of equal rows of y the first ones alone.
    """
    want = k + 1 if others else k
    copy = F.row_number().over(Window.partitionBy(*columns).orderBy("id"))
    near = staged(y.select("id", *columns).withColumn("_c", copy).filter(F.col("_c") <= want).drop("_c"))
    values = staged(x.select(*columns).distinct().withColumn("id", F.xxhash64(*columns)))
    both = values.select(*columns).unionByName(near.select(*columns))
    span = both.agg(*(F.max(c) - F.min(c) for c in columns)).first()
    widest = sum(float(v or 0.0) ** p for v in span) ** (1 / p)
    rows, left, found = near.count(), values, []
    enough = min(want, rows)
    radius = widest * (enough / max(1, rows)) ** (1 / len(columns)) / 4
    by_distance = Window.partitionBy("x_id").orderBy("distance", "y_id")
    while enough:
        met = radius_edges(left, near, columns, radius, p)
        met = staged(met.withColumn("r", F.row_number().over(by_distance)).filter(F.col("r") <= want))
        done = met.groupBy("x_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough).select("x_id")
        found.append(met.join(done, "x_id", "left_semi"))
        left = staged(left.join(done, left["id"] == done["x_id"], "left_anti"))
        if radius > widest or left.isEmpty():
            break
        radius = 3 * radius if radius else 1.0
    if not found:
        return values.sparkSession.createDataFrame([], f"x_id {x.schema['id'].dataType.simpleString()}, y_id {y.schema['id'].dataType.simpleString()}, distance double, r int")
    lists = reduce(DataFrame.union, found).groupBy("x_id").agg(F.sort_array(F.collect_list(F.struct("distance", "y_id"))).alias("near")).withColumnRenamed("x_id", "_v")
    own = x.select(F.col("id").alias("x_id"), F.xxhash64(*columns).alias("_v")).join(lists, "_v")
    picked = F.filter("near", lambda s: s["y_id"] != F.col("x_id")) if others else F.col("near")
    out = own.select("x_id", F.posexplode(F.slice(picked, 1, k)).alias("r", "s"))
    return out.select("x_id", F.col("s.y_id").alias("y_id"), F.col("s.distance").alias("distance"), (F.col("r") + 1).alias("r"))


def nearest_ratio(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> float:
    """Mean distance of a synthetic row to the nearest real one, over that of a real row to the nearest other."""
    mean = lambda d: d.agg(F.avg("distance")).first()[0]
    return mean(nearest(synth, real, columns)) / mean(nearest(real, real, columns, others=True))


#: Numbers of neighbours over which the outlier factor is taken at its highest, and the factor of an outlier.
LOF_RANGE, LOF_LIMIT = (20, 50), 1.5


def outlier_factor(real: DataFrame, synth: DataFrame, columns: Sequence[str], ks: tuple[int, int] = LOF_RANGE) -> DataFrame:
    """id, factor, score. The factor is local reachability of a row's k nearest real rows over its own, at its highest over
    all k from ks[0] to ks[1]; over 1 is sparser than they are. The score is LOF_LIMIT less the factor, 1 at most; below
    0 is an outlier. No k is more than the number of other real rows. One search serves every k."""
    n = real.count()
    numbers = sorted({max(1, min(k, n - 1)) for k in range(ks[0], ks[1] + 1)})
    inner, outer = staged(nearest(real, real, columns, numbers[-1], others=True)), staged(nearest(synth, real, columns, numbers[-1]))
    each = lambda value: [F.avg(F.when(F.col("r") <= k, value(k))).alias(f"k{k}") for k in numbers]
    radii = inner.groupBy("x_id").agg(*(F.max(F.when(F.col("r") <= k, F.col("distance"))).alias(f"d{k}") for k in numbers)).withColumnRenamed("x_id", "y_id")

    def density(neighbours: DataFrame) -> DataFrame:
        reach = neighbours.join(radii, "y_id").groupBy("x_id").agg(*each(lambda k: F.greatest("distance", f"d{k}")))
        return reach.select("x_id", *((1 / (F.col(f"k{k}") + F.lit(1e-10))).alias(f"own{k}") for k in numbers))

    theirs = density(inner).withColumnRenamed("x_id", "y_id")
    around = outer.join(theirs, "y_id").groupBy("x_id").agg(*each(lambda k: F.col(f"own{k}")))
    factors = [F.col(f"k{k}") / F.col(f"own{k}") for k in numbers]
    factor = F.greatest(*factors) if len(factors) > 1 else factors[0]
    out = around.join(density(outer), "x_id").select(F.col("x_id").alias("id"), factor.alias("factor"))
    return out.withColumn("score", F.least(F.lit(1.0), F.lit(LOF_LIMIT) - F.col("factor")))


def plausible(real: DataFrame, synth: DataFrame, keys: Sequence[str], negate: bool = False) -> DataFrame:
    """Synthetic rows whose keys a real row has; with negate those whose keys none has."""
    return synth.join(real.select(*keys).distinct(), list(keys), "left_anti" if negate else "left_semi")


def inspection_set(real: DataFrame, synth: DataFrame, unmatched: DataFrame, columns: Sequence[str], keys: Sequence[str], ks: tuple[int, int] = LOF_RANGE) -> DataFrame:
    """Unmatched synthetic rows that are outliers and implausible."""
    odd = outlier_factor(real, synth, columns, ks).filter("score < 0").select("id")
    return plausible(real, synth, keys, True).join(unmatched, "id", "left_semi").join(odd, "id", "left_semi")
