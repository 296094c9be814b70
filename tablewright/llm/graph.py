"""Connected components of an edge table, without any node's neighbours in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_groups, written


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """pairs(u, v): link v and u to the least node around u. The minimum is a partial aggregate; nodes with very many
    neighbours get it by broadcast (join_groups). It is cheaper to sum again than to write."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    linked = join_groups(pairs, least, ["u"], "n", pairs.count())
    if keep_larger:
        linked = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select("v", "m").union(least.select("u", "m")).toDF("u", "v")
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> node, root: the least node of its component. Nodes without an edge do not appear.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each written to the shared folder; about
    log(longest path) rounds. Ends when a round changes nothing.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        large = written(_star(both, True))
        small = written(_star(large, False))
        new = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        drop(large)
        now = small
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
