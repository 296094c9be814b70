"""What the corpus operators share: tables in the shared folder, and joins that stand a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shipping, tables

#: Bytes of rows that a Python worker gets at a time, unless the session says otherwise: whole texts can be long, and Spark's
#: own limit is 64 MB.
BATCH_BYTES, _BATCH = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"

#: A group is hot from this share of all rows on, so there are at most 1 / HOT_SHARE hot groups.
HOT_SHARE = 1 / 1000


def ship(spark: SparkSession) -> None:
    """Before any work in Python workers: the package, and batches of a bounded size."""
    shipping.ship(spark)
    if spark.conf.get(_BATCH) in ("67108864b", "64m", "67108864"):
        spark.conf.set(_BATCH, BATCH_BYTES)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor costs no recomputation of what led to it."""
    ship(df.sparkSession)
    return tables.staged(df)


drop = tables.unstaged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return tables.table(spark, sf_dir, name)


def bucket(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod: the folds of the contracts. A null id falls in fold -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(-1))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Each row with its group's values; groups has one row for each key, with the number of rows in `size`.

    Groups with at least HOT_SHARE of all rows number 1 / HOT_SHARE at most and are broadcast, so that their rows
    stay where they are; the others are joined by a shuffle in which no key is large.
    """
    is_hot = F.col(size) >= F.lit(max(1.0, total * HOT_SHARE))
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    return rows.join(F.broadcast(hot), keys).unionByName(
        rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("shuffle_merge"), keys)
    )


def join_dealt(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """Like join_groups, for groups whose values may be long: these are never broadcast. The rows of a hot group are dealt
    out, and its values repeated for each share; only the hot keys are sent along. Rows with a null key may be kept (left).
    The keys and sizes of all groups may be given apart, so that groups are read but once."""
    limit = F.lit(max(1.0, total * HOT_SHARE))
    copies = F.ceil(F.col(size) / limit)
    hot = (groups if sizes is None else sizes).filter(F.col(size) > limit).select(*keys, copies.alias("_copies"))
    shares = groups.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop(size)
    share = F.when(F.col("_copies").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_copies")))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_copy", share).drop("_copies")
    return dealt.join(shares.hint("shuffle_merge"), [*keys, "_copy"], how).drop("_copy")


#: Bits of a Seen table: 16 for each key, and 32 MB at most. Beyond, more rows look as if they were in it, and none less.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 15, 1 << 28, 16


class Seen:
    """Which rows may have one of the keys: a bit for the hash of each key, in tables of a bounded size that are sent to all
    tasks. Rows that are told apart so need no shuffle to meet the keys."""

    def __init__(self, keys: DataFrame, by: list[str], most_bits: int = MOST_BITS):
        self.by, n = by, keys.count()
        self.bits = min(max(LEAST_BITS, 1 << (BITS_A_KEY * n).bit_length()), most_bits)
        at = self._at()
        self.tables = keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))

    def _at(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(23), *self.by), F.lit(self.bits)).cast("long")

    def mark(self, rows: DataFrame, name: str) -> DataFrame:
        """rows, and whether each may have one of the keys; a row that has is always marked."""
        place = F.bitmap_bit_position(self._at())
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        joined = rows.withColumn("_bucket", F.bitmap_bucket_number(self._at())).join(F.broadcast(self.tables), "_bucket", "left")
        return joined.withColumn(name, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


#: Keys (about 40 bytes each) up to which they are broadcast.
BROADCAST_KEYS = 250_000


def without(rows: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """The rows whose key is not in keys(by); a null key never is. Many keys are met by a shuffle of those rows alone that may
    have one."""
    if keys.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys.select(by)), by, "left_anti")
    marked = Seen(keys, [by]).mark(rows, "_seen")
    some = marked.filter("_seen").join(keys.select(by).hint("shuffle_merge"), by, "left_anti")
    return marked.filter("NOT _seen").unionByName(some).drop("_seen")
