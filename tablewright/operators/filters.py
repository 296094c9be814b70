"""Row and column selection."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def query(df: DataFrame, expr: str) -> DataFrame:
    return df.filter(expr)


def single_row(df: DataFrame, expr: str) -> Row:
    """The only row that an expression selects; AssertionError if there is none or more."""
    rows = df.filter(expr).take(2)
    if len(rows) != 1:
        raise AssertionError(f"{expr!r} selects {'no row' if not rows else 'several rows'}")
    return rows[0]


def matching(df: DataFrame, column: str, *, contains: Sequence[str] = (), starts: str | None = None, ends: str | None = None, pattern: str | None = None, among: Sequence | None = None) -> DataFrame:
    """Rows whose text has any of `contains`, the prefix, the suffix, the pattern, and is among the values."""
    c, ok = F.col(column), F.lit(True)
    if contains:
        any_of = F.lit(False)
        for x in contains:
            any_of |= c.contains(x)
        ok &= any_of
    for use, test in ((starts, c.startswith), (ends, c.endswith), (pattern, c.rlike)):
        ok = ok & test(use) if use is not None else ok
    return df.filter(ok & c.isin(*among) if among is not None else ok)


def split_by(df: DataFrame, constraints: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all constraints, and the others. A constraint that is null is not met."""
    met = F.lit(True)
    for c in constraints:
        met &= F.coalesce(c, F.lit(False))
    return df.filter(met), df.filter(~met)


def not_both(low: str, low_limit: float, high: str, high_limit: float) -> Column:
    """No interval of `low` wholly below its limit together with one of `high` wholly above its own."""
    return ~((F.col(low)["hi"] <= low_limit) & (F.col(high)["lo"] > high_limit))


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name matches a Python pattern anywhere, look-ahead included."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if re.search(pattern, c)))


def duplicated(df: DataFrame, keys: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """Rows whose key occurs more than once, all of them; with unique those that occur once.

    Keys are counted by an aggregate, with partial sums before the shuffle, and joined back null-safely: a window over
    all rows of a key would hold a frequent key in one task.
    """
    keys = list(keys or df.columns)
    counts = df.groupBy(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys))).count().filter("count = 1" if unique else "count > 1")
    on = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    return df.join(counts, on, "left_semi")


def replace_rows(df: DataFrame, condition: str, new: DataFrame) -> DataFrame:
    """Rows that meet the condition give way to new ones."""
    return df.filter(f"NOT coalesce({condition}, false)").unionByName(new, allowMissingColumns=True)


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in an order, for an n that fits one task."""
    return df.orderBy(order).limit(n)


def any_n(df: DataFrame, n: int) -> DataFrame:
    """n rows, the same on every read, without gathering them in one task as limit() does: rows are numbered within their
    partitions, and the sizes of the partitions (a number each) say where to stop."""
    from ..sources.tables import staged

    parts = staged(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before, start = {}, 0
    for r in parts.groupBy("_part").count().orderBy("_part").collect():
        before[r["_part"]], start = start, start + r["count"]
    if not before:
        return df.limit(0)
    starts = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    return parts.filter(F.col("_at") + starts[F.col("_part")] < n).drop("_part", "_at")


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Dense row numbers from 0 in a total order: range-partitioned, numbered in each partition, offset by the sizes of
    the partitions before (one row each on the driver)."""
    from ..sources.tables import staged

    parts = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count().orderBy("_part").collect()
    offset, start = {}, 0
    for r in sizes:
        offset[r["_part"]], start = start, start + r["count"]
    offsets = F.create_map(*(F.lit(x) for kv in offset.items() for x in kv)) if offset else F.create_map(F.lit(0), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, (within + offsets[F.col("_part")]).cast("long")).drop("_part")
