"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

DataFrame functions only. Each level reads the texts that the one before left over: first their lengths alone, then the
first characters of those whose length recurs, then the whole of those whose length and prefix recur. Which these are is
told by hashed bits of the surviving keys (common.Seen), of a bounded size that is sent to all tasks, so the levels are
the same at every size and no text is ever shuffled; where there are more keys than the bits can tell apart, some texts
are hashed that no other is like, which changes no result.

Defined cases: a null text counts as empty; a null id is smaller than any other, and a group of null ids only
has a null keep_id; rows that repeat an id and a text share one fate; an empty table gives an empty result.
Only the two named columns are read, so columns with other names never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BITS, Seen, join_groups, table, written

#: Characters of the prefix that is hashed before the whole text.
PREFIX = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digests: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """id, keep_id (largest id of the equal texts), group_size, kept, full_hash (null for texts that the levels before
    told from all others, unless digests asks for all)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("len"))
    again = lambda rows, keys: written(rows.groupBy(*keys).count().filter("count > 1").select(*keys))
    lengths = Seen(again(source, ["len"]), ["len"], most_bits)
    source = lengths.mark(source, "open").withColumn("prefix", F.when(F.col("open"), F.xxhash64(F.substring("text", 1, prefix))))
    prefixes = Seen(again(source.filter("open"), ["len", "prefix"]), ["len", "prefix"], most_bits)
    full = F.sha2(F.col("text"), 256)
    marked = prefixes.mark(source, "both").withColumn("shared", F.col("open") & F.col("both"))
    marked = written(marked.select("id", "shared", (full if digests else F.when(F.col("shared"), full)).alias("full_hash")))
    shared = marked.filter("shared").drop("shared")
    groups = written(shared.groupBy("full_hash").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    alone = marked.filter("not shared").select("id", "full_hash", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return join_groups(shared, groups, ["full_hash"], "group_size", total).unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "keep_id", "group_size", "kept", "full_hash")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digests=True).withColumnsRenamed({"id": "doc_id", "full_hash": "text_sha256"})


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
