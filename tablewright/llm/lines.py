"""Line deduplication by a log-template tree: recurring templates across documents are dropped.

A line is parsed at fixed depth: by its number of tokens, then by its first DEPTH tokens, where a token with a digit is
a variable field. In a leaf, in order of their hashes, a line joins the first template that it agrees with in at least
SIMILAR of its tokens, or begins one; where the lines of a template differ is a variable field too. A template that
two documents or more hold is recurring: the document with the smallest id keeps its lines, the others lose theirs.
Lines of fewer than MIN_TOKENS tokens, or with a variable in over half of them, are too general to be a template and
stay.

Counts come first, by hash: which leaf, which line, the first and last document. Only leaves with several different
lines are parsed again with their tokens (two bytes each), so most lines never leave their task. A leaf with many
lines takes rounds: the first lines in the order of hashes are grouped, the rest of the leaf, dealt out in parts, meets
the templates that these began, and what joins none of them goes on. The templates are the same at every size.

Defined cases: a null text stays null and has no lines; a null id is no document of its own: its lines neither make
a template recur nor are dropped; rows that share an id are one document; a document that loses every line
is empty text; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_dealt, join_groups, table, written

MIN_TOKENS, DEPTH, SIMILAR = 5, 4, 0.7
#: Different lines of one leaf that a task groups at a time, at most, and at least if a thousandth of all is fewer. Rounds
#: of a larger leaf take so many, then GROWTH times as many up to MOST_FIRST, so that few rounds do.
MOST_LINES, LEAST_LINES, GROWTH, MOST_FIRST = 4096, 256, 4, 16384
#: Lines, and bytes of their tokens, that are held against the templates of a round at a time.
CHUNK, CHUNK_BYTES = 1024, 1 << 20
#: Leaves (8 bytes each) up to which they are broadcast.
BROADCAST_LEAVES = 500_000

_DIGIT = re.compile(rb"[0-9]")


def parse(line: bytes, min_tokens: int = MIN_TOKENS, depth: int = DEPTH) -> tuple[int, int, bytes] | None:
    """Leaf, hash and tokens (16-bit hashes, 0 for a variable) of a line; None if it is no template."""
    words = line.split()
    if len(words) < min_tokens:
        return None
    if _DIGIT.search(line):
        words = [b"" if _DIGIT.search(w) else w for w in words]
        if 2 * words.count(b"") > len(words):
            return None
    masked = b" ".join(words)
    leaf = xxhash.xxh64_intdigest(b"%d " % len(words) + b" ".join(words[:depth]))
    return leaf, xxhash.xxh64_intdigest(masked), masked


def token_hashes(masked: bytes) -> bytes:
    return np.array([zlib.crc32(w) % 65535 + 1 if w else 0 for w in masked.split(b" ")], dtype=np.uint16).tobytes()


_signed = lambda values: np.array(values, dtype=np.uint64).view(np.int64)


def _lines(docs: DataFrame, with_tokens: bool, leaves=None, min_tokens: int = MIN_TOKENS, depth: int = DEPTH) -> DataFrame:
    """id, same, leaf, line of every different template line of a document; or leaf, line, tokens of those in `leaves`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if leaves is None else leaves.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, owner, leaf, line, tokens = batch.slice(at, 256), [], [], [], []
                for i, value in enumerate(part.column(1)):
                    seen = set()
                    for raw in (value.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n"):
                        found = parse(raw, min_tokens, depth)
                        if found and found[1] not in seen:
                            seen.add(found[1])
                            if with_tokens and wanted is not None:
                                key = np.uint64(found[0]).view(np.int64)
                                k = np.searchsorted(wanted, key)
                                if k == len(wanted) or wanted[k] != key:
                                    continue
                            owner.append(i)
                            leaf.append(found[0])
                            line.append(found[1])
                            if with_tokens:
                                tokens.append(token_hashes(found[2]))
                if with_tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(leaf)), pa.array(_signed(line)), pa.array(tokens, pa.binary())], names=["leaf", "line", "tokens"])
                else:
                    at_row = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at_row), part.column(2).take(at_row), pa.array(_signed(leaf)), pa.array(_signed(line))], names=["id", "same", "leaf", "line"])

    kind = docs.schema["id"].dataType.simpleString()
    docs = docs.select("id", "text", F.xxhash64("text").alias("same"))
    return docs.mapInArrow(run, "leaf long, line long, tokens binary" if with_tokens else f"id {kind}, same long, leaf long, line long")


def enough(width: int, similar: float) -> int:
    """Tokens of a line that have to agree."""
    return math.ceil(similar * width - 1e-9)


def group_leaf(lines: np.ndarray, tokens: list[bytes], similar: float = SIMILAR) -> np.ndarray:
    """The template of each line of a leaf, as the line that began it: in order of hashes, each line joins the first template
    that it agrees with in enough tokens, or begins one. Variables agree with each other."""
    out = lines.copy()
    width = len(tokens[0]) // 2
    need = enough(width, similar)
    firsts, began, n = np.zeros((16, width), dtype=np.uint16), np.zeros(16, dtype=np.int64), 0
    for i in np.argsort(lines):
        line = np.frombuffer(tokens[i], dtype=np.uint16)
        like = (firsts[:n] == line).sum(axis=1) >= need
        if like.any():
            out[i] = began[int(like.argmax())]
            continue
        if n == len(firsts):
            firsts, began = np.concatenate([firsts, np.zeros_like(firsts)]), np.concatenate([began, np.zeros_like(began)])
        firsts[n], began[n] = line, lines[i]
        n += 1
    return out


def _grouped(rows: DataFrame, similar: float) -> DataFrame:
    """rows(leaf, size, line, tokens) -> leaf, line, template, and the tokens of a line that began one: a leaf after the other."""
    rows = rows.select("leaf", "size", "line", "tokens").repartition("leaf").sortWithinPartitions("leaf", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines, tokens = None, [], []

        def flush():
            if not lines:
                return
            at = np.array(lines, dtype=np.int64)
            of = group_leaf(at, tokens, similar)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), pa.int64()), pa.array(at), pa.array(of), pa.array([t if x == y else None for t, x, y in zip(tokens, at, of)], pa.binary())], names=["leaf", "line", "template", "tokens"])

        for batch in batches:
            for leaf, size, line, token in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (leaf, size) != key:
                    yield from flush()
                    key, lines, tokens = (leaf, size), [], []
                lines.append(line)
                tokens.append(token)
        yield from flush()

    return rows.mapInArrow(run, "leaf long, line long, template long, tokens binary")


def _joined(rows: DataFrame, firsts: DataFrame, similar: float) -> DataFrame:
    """rows(leaf, part, size, line, tokens) and the lines that began templates, on each part of their leaf -> rows with
    template: the first of these that each agrees with, or null."""
    both = rows.withColumn("new", F.lit(False)).unionByName(firsts.withColumn("new", F.lit(True)))
    both = both.select("leaf", "part", "size", "new", "line", "tokens").repartition("leaf", "part").sortWithinPartitions("leaf", "part", "size", F.desc("new"), "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, began, firsts, held = None, [], [], []

        def flush():
            if not held:
                return
            lines = np.frombuffer(b"".join(t for _, t in held), dtype=np.uint16).reshape(len(held), -1)
            of, open_, need = np.full(len(held), -1), np.arange(len(held)), enough(lines.shape[1], similar)
            for k, first in enumerate(firsts):
                if not len(open_):
                    break
                like = (lines[open_] == np.frombuffer(first, dtype=np.uint16)).sum(axis=1) >= need
                of[open_[like]], open_ = k, open_[~like]
            n = len(held)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array([key[2]] * n, pa.int32()), pa.array([x for x, _ in held], pa.int64()), pa.array([t for _, t in held], pa.binary()), pa.array([began[k] if k >= 0 else None for k in of], pa.int64())], names=["leaf", "part", "size", "line", "tokens", "template"])
            held.clear()

        for batch in batches:
            for leaf, part, size, new, line, token in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (leaf, part, size) != key:
                    yield from flush()
                    key, began, firsts = (leaf, part, size), [], []
                if new:
                    began.append(line)
                    firsts.append(token)
                else:
                    held.append((line, token))
                    if len(held) >= CHUNK or len(held) * size >= CHUNK_BYTES:
                        yield from flush()
        yield from flush()

    return both.mapInArrow(run, "leaf long, part long, size int, line long, tokens binary, template long")


def templates(members: DataFrame, similar: float = SIMILAR, hot_share: float = HOT_SHARE, most_lines: int = MOST_LINES, least_lines: int = LEAST_LINES) -> DataFrame:
    """members(leaf, line, tokens), lines distinct -> line, template (the line hash that began it, the smallest of it)."""
    sizes = written(members.groupBy("leaf").count())
    total = sizes.agg(F.sum("count")).first()[0] or 0
    limit = max(1, min(most_lines, max(least_lines, int(total * hot_share))))
    large = written(sizes.filter(F.col("count") > limit))
    near = F.broadcast(large) if large.count() <= BROADCAST_LEAVES else large
    rows = members.withColumn("size", F.octet_length("tokens"))
    found = [written(_grouped(rows.join(near.select("leaf"), "leaf", "left_anti"), similar).select("line", "template"))]
    left = written(rows.join(near, "leaf").withColumn("part", F.pmod(F.xxhash64("line", F.lit(1)), F.ceil(F.col("count") / limit))))
    done, step = 0.0, limit
    while not left.isEmpty():
        # Hashes are even over their range, so a share of the range has that share of the leaf's lines.
        done, step = done + step, min(GROWTH * step, max(MOST_FIRST, limit))
        first = F.col("line").cast("double") < F.lit(-(2.0**63)) + F.lit(2.0**64) * F.lit(done) / F.col("count")
        began = written(_grouped(left.filter(first), similar))
        found.append(began.select("line", "template"))
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("count") / limit) - 1)).alias("part")
        firsts = began.filter("tokens IS NOT NULL").join(near, "leaf").select("leaf", F.octet_length("tokens").alias("size"), "line", "tokens", parts)
        rest = left.filter(~first).select("leaf", "part", "size", "line", "tokens")
        met = written(_joined(rest, firsts.select("leaf", "part", "size", "line", "tokens"), similar))
        found.append(met.filter("template IS NOT NULL").select("line", "template"))
        left = written(met.filter("template IS NULL").drop("template").join(near, "leaf"))
    return reduce(DataFrame.union, found)


def recurring(docs: DataFrame, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, similar: float = SIMILAR, broadcast_leaves: int = BROADCAST_LEAVES) -> tuple[DataFrame, DataFrame]:
    """docs(id, text) -> the template lines of each document (id, same: the hash of its text, line), and the recurring lines
    (line, first: the id that keeps them, n: rows with this line)."""
    spark = docs.sparkSession
    held = written(_lines(docs.filter("id IS NOT NULL"), False, None, min_tokens, depth))
    counts = written(held.groupBy("leaf", "line").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")))
    several = written(counts.groupBy("leaf").count().filter("count > 1").select("leaf"))
    if several.count() <= broadcast_leaves:
        keys = spark.sparkContext.broadcast(np.sort(np.array([r.leaf for r in several.collect()], dtype=np.int64)))
        members = _lines(docs, True, keys, min_tokens, depth)
    else:
        members = _lines(docs, True, None, min_tokens, depth).join(several, "leaf", "left_semi")
    members = written(members.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens")))
    of = written(templates(members, similar))
    grouped = counts.join(of, "line", "left").withColumn("template", F.coalesce("template", "line"))
    grouped = written(grouped.select("line", "template", "lo", "hi", "n"))
    ends = written(grouped.groupBy("template").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.count(F.lit(1)).alias("m")))
    total = ends.agg(F.sum("m")).first()[0] or 0
    found = join_groups(grouped.select("line", "n", "template"), ends, ["template"], "m", total)
    return held.select("id", "same", "line"), written(found.filter("first <> last").select("line", "first", "n"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS, depth: int = DEPTH, similar: float = SIMILAR, broadcast_leaves: int = BROADCAST_LEAVES, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, text without the lines of recurring templates, n_lines, n_dropped, n_left (lines left that are long enough for
    a template), and in the struct `rest` the columns of carry. Texts are shuffled once, to meet the lines that they
    lose; those are too many to be sent to every task."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("rest"))
    held, lines = recurring(source.select("id", "text"), min_tokens, depth, similar, broadcast_leaves)
    total = lines.agg(F.sum("n")).first()[0] or 0
    drops = join_groups(held, lines, ["line"], "n", total).filter("id <> first")
    # By id and text, so that an id with many rows is no large group; its equal rows are dealt out below.
    drops = written(drops.groupBy("id", "same").agg(F.collect_set("line").alias("drop"), F.count(F.lit(1)).alias("n")).withColumn("n", F.col("n") / F.size("drop")))
    rows = drops.agg(F.sum("n")).first()[0] or 0
    # A null id loses nothing, so its rows go anywhere.
    same = F.when(F.col("id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("text"))
    joined = join_dealt(source.withColumn("same", same), drops, ["id", "same"], "n", rows, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text, gone in zip(part.column("text"), part.column("drop")):
                    text, gone = text.as_py(), set(gone.as_py() or ())
                    if text is None:
                        rows.append((None, 0, 0, 0))
                        continue
                    raw = text.encode("utf-8", "surrogatepass").split(b"\n")
                    kept = raw
                    if gone:
                        found = [parse(x, min_tokens, depth) for x in raw]
                        kept = [x for x, f in zip(raw, found) if not f or int(np.uint64(f[1]).view(np.int64)) not in gone]
                    rows.append((b"\n".join(kept).decode("utf-8", "surrogatepass"), len(raw), len(raw) - len(kept), sum(len(x.split(None, min_tokens - 1)) >= min_tokens for x in kept)))
                text, *n = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in n), part.column("rest")], names=["id", "text", "n_lines", "n_dropped", "n_left", "rest"])

    types = {f.name: f.dataType.simpleString() for f in source.schema}
    return joined.select("id", "text", "rest", "drop").mapInArrow(run, f"id {types['id']}, text string, n_lines long, n_dropped long, n_left long, rest {types['rest']}")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what stays of each text."""
    out = drop_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
