"""Constraints and min-count projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged
from .filters import any_n, split_by
from .privacy import sample
from .profile import replicated


def reject(df: DataFrame, constraints: Sequence[Column], n: int | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the constraints (n of them, the first in an order if one is given; RuntimeError if there are fewer), and those that do not."""
    kept, lost = split_by(df, constraints)
    if n is not None:
        have = kept.count()
        if have < n:
            raise RuntimeError(f"{have} rows meet the constraints, {n} are needed")
        kept = any_n(kept.orderBy(order) if order else kept, n)
    return kept, lost


def project_min_count(df: DataFrame, order: int, seed: int = 0) -> DataFrame:
    """Afterwards no row occurs exactly `order` times or less, and the table is as long as before.

    Of the configurations that occur `order` times, order / (order + 1) are kept once more than before and the others
    dropped; what is missing is drawn, with replacement, from the rows that were kept. Others are as before. A table whose
    least count is higher is returned as it is; RuntimeError if it is lower or nothing is left to draw from.
    """
    columns = df.columns
    counts = staged(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")))
    least, total, exact = counts.agg(F.min("_n"), F.sum("_n"), F.count_if(F.col("_n") == order)).first()
    if least is None or least > order:
        return df
    if least < order:
        raise RuntimeError(f"a row occurs {least} times, fewer than {order}")
    chosen_n = order * (exact // (order + 1))
    low = counts.filter(F.col("_n") == order).drop("_n")
    chosen = sample(low, chosen_n, seed)
    missing = exact * order - (order + 1) * chosen_n
    if missing and not chosen_n:
        raise RuntimeError("no configuration is left to draw from")
    larger = counts.filter(F.col("_n") > order)
    grown = chosen.withColumn("_n", F.lit(order + 1).cast("long"))
    extra = sample(chosen, missing, seed + 1, True).withColumn("_n", F.lit(1).cast("long")) if missing else grown.limit(0)
    return replicated(larger.unionByName(grown).unionByName(extra), F.col("_n")).select(*columns)


def project(df: DataFrame, projection: dict | None, seed: int = 0) -> DataFrame:
    """min-count of orders 1 up to the one asked for; None leaves the table."""
    if projection is None:
        return df
    if projection.get("name") != "min-count":
        raise ValueError(f"unknown projection {projection.get('name')!r}")
    for k in range(1, projection["order"] + 1):
        df = project_min_count(df, k, seed + 10 * k)
    return df


def top_per_group(df: DataFrame, by: str, n: int, seed: int) -> DataFrame:
    """n random rows of each group; the rank limit is applied in each task before the shuffle."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.col("_u")))
    return df.withColumn("_u", F.rand(seed)).withColumn("_r", r).filter(F.col("_r") <= n).drop("_u", "_r")
