"""Histograms of all column subsets, and what is built from them.

All subsets of all columns, for any number of tables, come from two jobs: tagged rows are counted once by full cell,
then a cube over the (far fewer) cells sums the counts of every subset. `grouping_id` names the subset; nulls do not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import cut
from ..sources.tables import staged

MODES, FUNCS = ("diff", "ratio"), ("max", "min", "mean", "rmse")


def tagged(tables: dict[str, DataFrame], tag: str = "name") -> DataFrame:
    """Rows of all tables, each with its table's name."""
    return reduce(DataFrame.unionByName, (df.withColumn(tag, F.lit(n)) for n, df in tables.items()))


def histogram(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """keys..., n."""
    return df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))


def paired_histogram(x: DataFrame, y: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """keys..., nx, ny over the union of keys, 0 where one lacks the key. One aggregate; null keys match."""
    columns = list(columns or x.columns)
    both = tagged({"x": x.select(*columns), "y": y.select(*columns)}, "_tag")
    return both.groupBy(*columns).agg(F.count_if(F.col("_tag") == "x").alias("nx"), F.count_if(F.col("_tag") == "y").alias("ny"))


def n_histograms(tables: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """keys..., a count for each table, side by side."""
    both = tagged({k: v.select(*columns) for k, v in tables.items()}, "_tag")
    return both.groupBy(*columns).agg(*(F.count_if(F.col("_tag") == k).alias(k) for k in tables))


def binned(df: DataFrame, bins: dict[str, Sequence[float]]) -> DataFrame:
    """Columns that have bins as codes, null outside the bins; others as they are."""
    return df.select(*(cut(F.col(c), bins[c]).alias(c) if c in bins else F.col(c) for c in df.columns))


def subset_cells(tables: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """subset (grouping id), columns..., a count for each table: the histograms of all non-empty subsets."""
    cells = n_histograms(tables, columns)
    cube = cells.cube(*columns).agg(F.grouping_id().alias("subset"), *(F.sum(k).alias(k) for k in tables))
    return cube.filter(F.col("subset") != 2 ** len(columns) - 1)


def subset_names(subset: Column, columns: Sequence[str]) -> Column:
    """The columns that a grouping id keeps, in order."""
    n = len(columns)
    return F.filter(F.array(*(F.when(subset.bitwiseAND(1 << (n - 1 - i)) == 0, F.lit(c)) for i, c in enumerate(columns))), lambda x: x.isNotNull())


def frequency_columns(nx: Column, ny: Column, size_x: float, size_y: float, strict: bool = False) -> tuple[Column, Column]:
    """Absolute difference and largest ratio of a cell's relative frequencies.

    A cell of one table only differs by 0 unless `strict`. Ratios are of counts plus one; both are over the first
    table's size, so the sizes cancel.
    """
    p = nx / F.lit(float(size_x) or None) - ny / F.lit(float(size_y) or None)
    diff = F.abs(F.coalesce(p, F.lit(0.0)))
    if not strict:
        diff = F.when((nx > 0) & (ny > 0), diff).otherwise(F.lit(0.0))
    ratio = (nx + 1) / (ny + 1)
    return diff, F.greatest(ratio, 1 / ratio)


def _summary(c: Column, name: str) -> list[Column]:
    return [F.max(c).alias(f"{name}/max"), F.min(c).alias(f"{name}/min"), F.avg(c).alias(f"{name}/mean"), F.sqrt(F.avg(c * c)).alias(f"{name}/rmse")]


def subset_frequencies(tables: dict[str, DataFrame], columns: Sequence[str], pairs: dict[str, tuple[str, str]], sizes: dict[str, int], strict: bool = False) -> DataFrame:
    """targets, comparison, name, val: the eight frequency metrics of all subsets and all comparisons at once.

    A cell that neither table of a comparison has does not count for it.
    """
    cells = subset_cells(tables, columns)
    per_pair = []
    for label, (a, b) in pairs.items():
        diff, ratio = frequency_columns(F.col(a), F.col(b), sizes[a], sizes[b], strict)
        seen = (F.col(a) > 0) | (F.col(b) > 0)
        per_pair.append(F.when(seen, F.struct(F.lit(label).alias("comparison"), diff.alias("diff"), ratio.alias("ratio"))))
    rows = cells.select("subset", F.explode(F.filter(F.array(*per_pair), lambda x: x.isNotNull())).alias("v")).select("subset", "v.*")
    wide = rows.groupBy("subset", "comparison").agg(*_summary(F.col("diff"), "diff"), *_summary(F.col("ratio"), "ratio"))
    names = [f"{m}/{f}" for m in MODES for f in FUNCS]
    long = wide.select("subset", "comparison", F.explode(F.array(*(F.struct(F.lit(f"frequencies/{n}").alias("name"), F.col(f"`{n}`").alias("val")) for n in names))).alias("v"))
    return long.select(subset_names(F.col("subset").cast("long"), columns).alias("targets"), "comparison", "v.name", "v.val")


def roll_up(rows: DataFrame, n_columns: int) -> DataFrame:
    """binning, comparison, name, val: `frequencies/<mode>/<func>` over subsets of each size, and over all sizes."""
    func, mode = F.element_at(F.split("name", "/"), -1), F.get(F.split("name", "/"), F.lit(1))
    base = rows.filter(F.col("name").startswith("frequencies/")).withColumns({"func": func, "mode": mode})
    every = "".join(str(k) for k in range(1, n_columns + 1))
    sized = base.select("*", F.explode(F.array(F.size("targets").cast("string"), F.lit(f"all{every}"))).alias("ways"))
    sized = sized.withColumn("ways", F.regexp_replace("ways", "^all", ""))
    if n_columns == 1:
        sized = sized.distinct()
    how = F.when(F.col("func") == "max", F.max("val")).when(F.col("func") == "min", F.min("val")).when(F.col("func") == "mean", F.avg("val")).otherwise(F.sqrt(F.avg(F.col("val") * F.col("val"))))
    out = sized.groupBy("binning", "comparison", "mode", "func", "ways").agg(how.alias("val"))
    name = F.concat("ways", F.lit("way/"), "func", F.lit("/frequencies/"), "mode", F.lit("/"), F.when(F.col("binning"), "bins").otherwise("raw"))
    return out.select("binning", "comparison", name.alias("name"), F.concat("ways", F.lit("way/"), "func", F.lit("/frequencies")).alias("metric"), "val")


def frequency_of_frequencies(counts: DataFrame, up_to: int, column: str = "n") -> DataFrame:
    """param 1..up_to, value: how many groups have exactly that count, 0 if none."""
    spark = counts.sparkSession
    found = counts.filter(F.col(column).between(1, up_to)).groupBy(F.col(column).cast("long").alias("param")).agg(F.count(F.lit(1)).alias("v"))
    return spark.range(1, up_to + 1).withColumnRenamed("id", "param").join(found, "param", "left").select("param", F.coalesce("v", F.lit(0).cast("long")).alias("value"))


def min_marginal(df: DataFrame) -> int:
    """The least count of any value of any column: distinct rows are counted first, then their values, all columns in one
    pass."""
    cells = histogram(df)
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns))
    return cells.select("n", F.explode(pairs).alias("p")).filter("p.v IS NOT NULL").groupBy("p").agg(F.sum("n").alias("n")).agg(F.min("n")).first()[0]


def contingency(df: DataFrame, a: str, b: str, normalise: str | None = None) -> DataFrame:
    """a, b, value: counts, or shares of the columns' totals ("columns") or of all ("all")."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("value"))
    if normalise is None:
        return counts
    over = Window.partitionBy(b) if normalise == "columns" else Window.partitionBy(F.lit(0))
    return counts.withColumn("value", F.col("value") / F.sum("value").over(over))


def describe(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """count, nunique, mean, std, min, quartiles, max of every numeric column, for each group."""
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") and c not in by]
    stats = lambda c: [F.count(c).alias(f"{c}_count"), F.count_distinct(c).alias(f"{c}_nunique"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.percentile(c, F.lit(0.25)).alias(f"{c}_q1"), F.median(c).alias(f"{c}_median"), F.percentile(c, F.lit(0.75)).alias(f"{c}_q3"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*(s for c in numbers for s in stats(c)))


def pass_rates(df: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of true flags, and rows, of each group."""
    return df.groupBy(*by).agg(*(F.avg(F.col(f).cast("double")).alias(f) for f in flags), F.count(F.lit(1)).alias("size"))


def group_lists(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """by..., values (in order, bounded by the group), size, nunique."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias("values"), F.count(column).alias("size"), F.count_distinct(column).alias("nunique"))


def normalised_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return histogram(df, columns).crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def co_occurrence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """a, b, share: how often two flags are true together, over all rows."""
    both = [F.avg((F.col(a) & F.col(b)).cast("double")).alias(f"{i}_{j}") for i, a in enumerate(flags) for j, b in enumerate(flags)]
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}_{j}").alias("share")) for i, a in enumerate(flags) for j, b in enumerate(flags)))
    return df.agg(*both).select(F.explode(cells).alias("c")).select("c.*")


#: Rows of a key that one task puts in order.
ORDERED_ROWS = 200_000


def ordered(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """df with `upto_<column>`, the running sums of columns in the order of a numeric column with distinct values, and
    `next`, the next value; for each key.

    More than `rows` rows are cut into ranges at approximate quantiles; each range is ordered in a task of its own, and
    the sums and first values of the ranges, a row for each, carry over.
    """
    rows, keys, df = rows or ORDERED_ROWS, list(keys), staged(df)
    n = df.count()
    window = lambda *by: Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    sums = lambda w: {f"upto_{c}": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
    if n <= rows:
        w = window(*keys)
        return df.withColumns({**sums(w), "next": F.lead(order).over(w)})
    cuts = -(-n // rows)
    points = F.array(*(F.lit(k / cuts) for k in range(1, cuts)))
    edges = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.percentile_approx(order, points, 10_000).alias("_edges"))
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys] or F.lit(True)
    ranged = df.join(F.broadcast(edges), same("_")).withColumn("_range", F.size(F.filter("_edges", lambda e: e <= F.col(order)))).drop("_edges", *(f"_{k}" for k in keys))
    ranged = staged(ranged)
    totals = ranged.groupBy(*(F.col(k).alias(f"o_{k}") for k in keys), F.col("_range").alias("o_range")).agg(F.min(order).alias("_first"), *(F.sum(c).alias(f"_{c}") for c in columns))
    over = Window.partitionBy(*([f"o_{k}" for k in keys] or [F.lit(0)])).orderBy("o_range")
    carry = totals.select(*(f"o_{k}" for k in keys), "o_range", F.lead("_first").over(over).alias("_after"), *(F.coalesce(F.sum(f"_{c}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}") for c in columns))
    w = window(*keys, "_range")
    on = [*([] if not keys else same("o_")), F.col("_range") == F.col("o_range")]
    out = ranged.withColumns({**sums(w), "next": F.lead(order).over(w)}).join(F.broadcast(carry), on)
    out = out.withColumns({**{f"upto_{c}": F.col(f"upto_{c}") + F.col(f"_{c}") for c in columns}, "next": F.coalesce("next", "_after")})
    return out.drop("_range", "o_range", "_after", *(f"_{c}" for c in columns), *(f"o_{k}" for k in keys))


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column's average ranks, from counts of its distinct values: those are ordered, not the rows."""
    out = df
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        ranks = ordered(counts, "_v", ["_n"]).select("_v", (F.col("upto__n") - (F.col("_n") - 1) / 2).alias("_r"))
        out = out.join(ranks, F.col(c) == F.col("_v"), "left").withColumn(c, F.col("_r")).drop("_v", "_r")
    return out


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """value, n, share of rows at or below it."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return ordered(counts, "value", ["n"]).crossJoin(F.broadcast(total)).select("value", "n", (F.col("upto_n") / F.col("total")).alias("share"))


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def interleave(df: DataFrame, queue: str, order: str) -> DataFrame:
    """Round-robin over queues: the first of each, then the second of each."""
    place = F.row_number().over(Window.partitionBy(queue).orderBy(order))
    return df.withColumn("round", place).orderBy("round", queue)


def venn(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """flags..., n: rows of each combination of flags."""
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def to_long(df: DataFrame, ids: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], name, value)


def to_wide(df: DataFrame, index: Sequence[str], column: str, value: str, among: Sequence | None = None) -> DataFrame:
    """A column for each value of `column`; the greatest value if an index has several."""
    return df.groupBy(*index).pivot(column, list(among) if among else None).agg(F.max(value))


def transposed(df: DataFrame, index: str) -> DataFrame:
    """Rows become columns; the index's values, few, name them."""
    return to_wide(to_long(df, [index], "column"), ["column"], index, "value")


def replicated(df: DataFrame, times: Column | int) -> DataFrame:
    """Each row as often as said."""
    n = F.lit(times) if isinstance(times, int) else times
    return df.withColumn("_k", F.explode(F.sequence(F.lit(1), n.cast("int")))).drop("_k")


def id_sets(a: DataFrame, b: DataFrame, key: str) -> dict[str, DataFrame]:
    """Union, intersection and differences of two sets of keys."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return {"union": x.union(y).distinct(), "both": x.intersect(y), "only_a": x.join(y, key, "left_anti"), "only_b": y.join(x, key, "left_anti")}


def merge_comparisons(results: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One value column for each comparison, matched on keys that may be null or arrays; the greatest value if keys repeat."""
    both = reduce(DataFrame.unionByName, (df.withColumn("_label", F.lit(k)) for k, df in results.items()))
    return both.groupBy(*keys).agg(*(F.max(F.when(F.col("_label") == k, F.col("val"))).alias(k) for k in results))


def with_match_flag(df: DataFrame, other: DataFrame, keys: Sequence[str] | None = None, flag: str = "matched") -> DataFrame:
    """Left join on all columns, with an indicator; null keys match."""
    keys = list(keys or df.columns)
    small = other.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys))).distinct().withColumn("_in", F.lit(True))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)))
    return df.join(small, on, "left").withColumn(flag, F.col("_in").isNotNull()).drop(*(f"_{i}" for i in range(len(keys))), "_in")


def domain_counts(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Counts of every cell of the domain, zero cells too; ValueError beyond ten million cells."""
    cells = 1
    for s in sizes.values():
        cells *= s
    if cells > 10_000_000:
        raise ValueError(f"the domain has {cells} cells")
    columns, radix, code = list(sizes), 1, []
    for c in reversed(columns):
        code.append(((F.floor(F.col("id") / radix)) % sizes[c]).cast("long").alias(c))
        radix *= sizes[c]
    grid = df.sparkSession.range(cells).select(*reversed(code)) if columns else df.sparkSession.range(1).select()
    counts = df.groupBy(*(F.col(c).cast("long").alias(c) for c in columns)).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, columns, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
