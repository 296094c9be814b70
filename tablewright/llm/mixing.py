"""Mixing sources to target weights: hash-random order within each source, cut at the source's exact budget.

Every document gets a hash-random key of its id and size. Rows that are equal in source, id and size are interchangeable:
they are counted first, stand in the order as one, and are dealt out again at the end. Keys are uniform, so ranges of equal width hold about equally many
documents; a source is dealt into ranges by its share of all documents, each range is sorted and summed on its own, and prefix sums
of the range totals turn the local sums into positions in the source. A target above the source's size repeats the
source in epochs; the last epoch is cut at the exact word.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a null id sorts first among
equal keys; rows that repeat an id and a size are interchangeable; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Weights by the place of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: Most times that a source, and so a document, is repeated.
MOST = 2
#: Ranges of all sources together, about; a source has its share of them, and one at least.
RANGES = 4096
#: Fewest documents for which a source gets another range.
LEAST_ROWS = 500
#: Largest number of rows of a per-source table that is broadcast.
BROADCAST_SOURCES = 100_000
#: Equal rows that a task gives out at a time.
COPIES = 1000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def random_key(id_col: Column, size: Column, seed: int) -> Column:
    """The first 13 hex digits of an MD5, as a number: even over its range, and the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), size.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_rows, source_size, target. One aggregate a round; a round fixes all sources that reach their
    limit at the present level, and the level only rises, so the rounds end."""
    by_place = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double")
    sources = written(sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", by_place).drop("place"))
    words_in_all = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    limit, level = most * F.col("source_size"), 0.0
    while True:
        open_ = F.col("weight") * F.lit(level) <= limit
        fixed, weight = sources.agg(F.sum(F.when(~open_, limit).otherwise(0)), F.sum(F.when(open_, F.col("weight")).otherwise(0.0))).first()
        new = (share * words_in_all - float(fixed or 0)) / weight if weight else level
        if not weight or new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(level))).drop("weight")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 9, n_ranges: int = RANGES) -> DataFrame:
    """id, source, size, source_size, target, taken: the words that the mix takes of each document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    sized = written(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", random_key(F.col("id"), F.col("size"), seed)))
    sources = source_targets(sized.groupBy("source").agg(F.sum("copies").alias("source_rows"), F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, most)
    # Ranges number n_ranges and one a source at most.
    side = F.broadcast if sources.count() + n_ranges <= BROADCAST_SOURCES else (lambda x: x)
    rows = sources.agg(F.sum("source_rows")).first()[0] or 0
    ranges = F.ceil(F.col("source_rows") / F.lit(max(LEAST_ROWS, rows / n_ranges)))
    placed = sized.join(side(sources.select(F.col("source").alias("of"), "source_rows", "source_size", "target")), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("range", F.floor(F.col("key") / F.lit(2.0**52) * ranges))
    within = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
    totals = placed.groupBy(F.col("source").alias("of"), F.col("range").alias("at")).agg(F.sum(F.col("size") * F.col("copies")).alias("total"))
    offsets = totals.withColumn("offset", F.coalesce(F.sum("total").over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    local = local.join(side(offsets), F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    # What is left for the first of equal rows and those after it, in the last epoch.
    local = local.select("id", "source", "size", "source_size", "target", "copies", (epochs * F.col("size")).alias("full"), (rest - F.col("offset") - F.col("before")).alias("left"))
    parts = local.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / COPIES) - 1))).repartition("id", "source", "size", "part")
    each = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("copy") * F.col("size")))
    return each.withColumn("taken", (F.col("full") + last).cast("long")).select("id", "source", "size", "source_size", "target", "taken")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source").withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sized AS (
  SELECT doc_id, source, size,
         ('0x' || substr(md5('9:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 13))::BIGINT AS key
  FROM counted),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sources),
filling AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE AS fixed,
         (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS open_weight, 2 * source_size / weight AS full_at
  FROM weighted WINDOW w AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max((1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE - fixed) / open_weight) AS level FROM filling
  WHERE (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE - fixed) / open_weight <= full_at),
targets AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * coalesce((SELECT level FROM level), 0)) AS target FROM weighted),
placed AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""
