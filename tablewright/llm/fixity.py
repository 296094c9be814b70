"""Merkle fixity audit of WARC replicas: trees over ordered offset ranges, compared from the root down.

A leaf is the SHA-256 of a record. The leaves of one range of a file are hashed, in order of offset, into a node; ranges
grow by FANOUT from level to level up to the file, and files are hashed in groups up to one root. A range ends where the
hash of a record's name says so, not after a number of bytes, so that a record that is lost or longer in one replica moves
the offsets of those behind it but not their ranges. A node has about FANOUT children, and a file's records at most. Two
replicas whose roots agree need nothing else; otherwise only children of nodes that differ are compared, down to the
records: changed, missing or added.

Defined cases: a null URL or body counts as empty; rows that repeat an id are records of their own, ordered by their
content, and compared in this order; records with a null id form the file -1; a file that would have over twice PAGES
records, as of a null or repeated id, is cut into parts by content; empty replicas have the hash of an empty tree. Only
the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_groups, table, written

#: Records in a range at the lowest level, about, and ranges, or files, in a node of the next level.
FANOUT = 64
#: Pages in a file.
PAGES = 1000


def to_record(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def place(rows: DataFrame, pages_per_file: int = PAGES) -> DataFrame:
    """rows(id, digest, ...) -> the same with copies (up to pages_per_file equal rows), file and chunk: files hold ranges of
    ids, and those that would be far too long are cut into parts."""
    rows = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("all")).withColumn("range", F.coalesce(F.floor(F.col("id") / pages_per_file), F.lit(-1)).cast("long")))
    sizes = written(rows.groupBy("range").agg(F.sum("all").alias("n"), F.count(F.lit(1)).alias("different")))
    total = sizes.agg(F.sum("different")).first()[0] or 0
    rows = join_groups(rows, sizes, ["range"], "different", total).drop("different")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("all") / pages_per_file) - 1)))
    parts = F.ceil(F.col("n") / pages_per_file)
    part = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") + F.col("chunk"), parts)
    file = F.when(F.col("n") <= 2 * pages_per_file, F.col("range").cast("string")).otherwise(F.concat_ws(".", F.col("range").cast("string"), part.cast("string")))
    copies = F.least(F.lit(pages_per_file), F.col("all") - F.col("chunk") * pages_per_file)
    return rows.withColumn("file", file).withColumn("copies", copies).drop("all", "n", "range")


def lay_out(placed: DataFrame, length: str = "length", digest: str = "digest") -> DataFrame:
    """id, record (its name), file, offset, length, digest of the records of placed rows, one after the other in each file."""
    order = Window.partitionBy("file").orderBy("id", "digest", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("before", F.coalesce(F.sum(F.col(length) * F.col("copies")).over(order), F.lit(0).cast("long")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select("id", name(F.col("id")).alias("record"), "file", (F.col("before") + F.col("copy") * F.col(length)).alias("offset"), F.col(length).alias("length"), F.col(digest).alias("digest"))


def name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def serialised(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", pages_per_file: int = PAGES) -> DataFrame:
    """id, record, file, offset, length, digest of each page's record."""
    record = to_record(F.col(id_col), F.col(url_col), F.col(body_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    return lay_out(place(rows, pages_per_file))


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]+)", re.I)
_NAME = re.compile(rb"\r\nWARC-Record-ID:[ \t]*([^\r]*)", re.I)


def unpacked(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, plain or gzipped as a whole or by record, about `size` at a time; a torn end is left out."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + size] for i in range(0, len(data), size))
        return
    at, rest, member = 0, b"", zlib.decompressobj(31)
    try:
        while rest or at < len(data):
            if not rest:
                rest, at = data[at : at + size], at + size
            out = member.decompress(rest, size)
            if out:
                yield out
            rest = member.unconsumed_tail
            if member.eof:
                rest, member = member.unused_data, zlib.decompressobj(31)
        while out := member.decompress(member.unconsumed_tail, size):
            yield out
    except zlib.error:
        return


def parse_warc(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of a WARC file; of a packed one the offsets are those of the unpacked bytes. One
    record is held at a time. What does not parse as a record is returned as one, up to the next record or the end."""
    chunks, held, at = unpacked(data), bytearray(), 0

    def more() -> bool:
        new = next(chunks, b"")
        held.extend(new)
        return bool(new)

    while held or more():
        end, found = -1, None
        while (head := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if head >= 0 and held[:5] == b"WARC/" and (found := _LENGTH.search(held, 0, head + 2)):
            end = head + 4 + int(found[1]) + 4
            while len(held) < end and more():
                pass
        if not found or end > len(held):
            begin = 5
            while (end := held.find(b"WARC/1.", begin)) < 0:
                begin = max(5, len(held) - 6)
                if not more():
                    end = len(held)
                    break
        yield at, bytes(held[:end])
        del held[:end]
        at += end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file (its name), record, offset, length, digest of the records of WARC files; the list of files is what is dealt
    out, so files should be of the usual size of about a gigabyte at most. A record without a name is named by its digest."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for at, x in parse_warc(content.as_py()):
                    digest, found = hashlib.sha256(x).hexdigest(), _NAME.search(x, 0, max(0, x.find(b"\r\n\r\n")) + 2)
                    rows.append((file.as_py(), found[1].decode("utf-8", "replace").strip() if found else digest, at, len(x), digest))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "record", "offset", "length", "digest"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, record string, offset long, length long, digest string")


def heights(*replicas: DataFrame, fanout: int = FANOUT) -> tuple[int, int]:
    """Levels of ranges in the longest file, and above the files, that hold all replicas."""
    above = lambda n, k=0: k if n <= 1 else above(-(-n // fanout), k + 1)
    stats = [r.groupBy("file").count().agg(F.max("count"), F.count(F.lit(1))).first() for r in replicas]
    return max(1, above(max(s[0] or 0 for s in stats))), max(1, above(max(s[1] for s in stats)))


def tree(records: DataFrame, height: tuple[int, int], fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the records up to the root, each a table of file, key and digest, of where it stands (place), and of the
    node above as up_file and up. A record's key is its name, and which of that name it is in its file; a range's is
    the name of the record that begins it, at level k one whose hash is a multiple of fanout ** k. Files are dealt into groups
    by a hash of their name; there the file is empty and the key the group."""
    in_file = Window.partitionBy("file").orderBy("offset")
    begins = lambda k: F.coalesce(F.last(F.when(F.pmod(F.xxhash64(F.lit(2), "record"), F.lit(fanout**k)) == 0, F.col("record")), True).over(in_file), F.lit(""))
    nth = F.row_number().over(Window.partitionBy("file", "record").orderBy("offset"))
    rows = records.withColumn("key", F.concat_ws(" ", nth.cast("string"), F.col("record"))).withColumns({f"up_{k}": begins(k) for k in range(1, height[0] + 1)})
    ups = [f"up_{k}" for k in range(1, height[0] + 1)]
    digest = F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("place", "file", "key", "digest"))), lambda x: F.concat_ws(" ", x["file"], x["key"], x["digest"]))), 256)
    rows, levels, nowhere = rows.select("file", F.col("offset").alias("place"), "key", "digest", *ups), [], F.lit("")
    # Ranges up to the file, whose only node has no key.
    for up, rest in [(up, ups[k + 1 :]) for k, up in enumerate(ups)] + [(None, [])]:
        levels.append(written(rows.withColumn("up_file", F.col("file")).withColumn("up", F.col(up) if up else nowhere)))
        rows = levels[-1].groupBy("up_file", "up", *rest).agg(F.min("place").alias("first"), digest.alias("digest")).select(F.col("up_file").alias("file"), F.col("first").alias("place"), F.col("up").alias("key"), "digest", *rest)
    # Groups of files, in the order of their names.
    group = F.pmod(F.xxhash64("file"), F.lit(fanout ** height[1]))
    for k in range(height[1] + 1):
        group = group if k == 0 else F.floor(F.col("key").cast("long") / fanout)
        levels.append(written(rows.withColumn("place", F.lit(0).cast("long")).withColumn("up_file", nowhere).withColumn("up", group.cast("string"))))
        rows = levels[-1].groupBy("up_file", "up").agg(digest.alias("digest")).select(F.col("up_file").alias("file"), F.lit(0).cast("long").alias("place"), F.col("up").alias("key"), "digest")
    return [*levels, written(rows)]


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """a, b(file, record, offset, digest) -> file, key, offset (in a, or in b if only there), status of the records that
    differ: changed, missing (from b) or added (in b)."""
    height = heights(a, b, fanout=fanout)
    left, right = (tree(x, height, fanout) for x in (a, b))
    open_ = None
    for x, y in reversed(list(zip(left, right))):
        if open_ is not None:
            x, y = (s.join(open_, (s["up_file"] == open_["of"]) & (s["up"] == open_["at"]), "left_semi") for s in (x, y))
        both = x.select("file", "key", F.col("place").alias("at_x"), F.col("digest").alias("x")).join(y.select("file", "key", F.col("place").alias("at_y"), F.col("digest").alias("y")), ["file", "key"], "full_outer")
        differ = written(both.filter(~F.col("x").eqNullSafe(F.col("y"))))
        if differ.isEmpty():
            break
        open_ = differ.select(F.col("file").alias("of"), F.col("key").alias("at")).distinct()
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "missing").otherwise("changed")
    return differ.select("file", "key", F.coalesce("at_x", "at_y").alias("offset"), status.alias("status"))


#: The second replica of the query: rot in records whose id's MD5 begins so, loss of others.
ROTTEN, LOST = ("00", "01", "02"), ("f0",)


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the pages, with what the audit of a second replica says of it. The replica is made here, from the
    pages: some bodies have another first character, and one more if they were empty, and some records are lost, so that
    those behind them in a file have other offsets. Its records are serialised and hashed like those of the first."""
    pages = table(spark, sf_dir, "pages")
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    body = F.coalesce(F.col("html"), F.lit(""))
    flipped = F.concat(F.when(F.substring(body, 1, 1) == "~", F.lit("!")).otherwise(F.lit("~")), F.substring(body, 2, 1 << 30))
    record, other = (to_record(F.col("page_id"), F.col("url"), x) for x in (body, F.when(mark.isin(*ROTTEN), flipped).otherwise(body)))
    columns = {"id": F.col("page_id").cast("long"), "lost": mark.isin(*LOST)}
    columns |= {k: f for n, r in (("", record), ("_b", other)) for k, f in ((f"length{n}", F.octet_length(r).cast("long")), (f"digest{n}", F.sha2(r, 256)))}
    placed = written(place(pages.select(*(f.alias(k) for k, f in columns.items()))))
    good = written(lay_out(placed))
    found = audit(good, lay_out(placed.filter("NOT lost"), "length_b", "digest_b"))
    return good.join(found, ["file", "offset"], "left").select(F.col("id").alias("page_id"), "file", "offset", "length", F.col("digest").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"))


OP2_SQL = r"""
WITH records AS (
  SELECT page_id, coalesce(page_id // 1000, -1)::BIGINT AS of_ids,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
hashed AS (
  SELECT page_id, of_ids, strlen(record)::BIGINT AS length, sha256(record) AS record_sha256, substr(md5(coalesce(page_id::VARCHAR, '')), 1, 2) AS mark,
         (row_number() OVER (PARTITION BY page_id, sha256(record)) - 1) // 1000 AS chunk, count(*) OVER (PARTITION BY of_ids) AS n FROM records),
placed AS (
  SELECT *, CASE WHEN n <= 2000 THEN of_ids::VARCHAR
                 ELSE of_ids::VARCHAR || '.' || ((('0x' || substr(record_sha256, 1, 8))::BIGINT + chunk) % ceil(n / 1000)::BIGINT)::VARCHAR END AS file FROM hashed)
SELECT page_id, file, length, record_sha256,
       coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, record_sha256, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       CASE WHEN mark IN ('00', '01', '02') THEN 'changed' WHEN mark = 'f0' THEN 'missing' ELSE 'ok' END AS status
FROM placed
"""
