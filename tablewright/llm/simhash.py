"""SimHash near-duplicates by anchor-point covering.

A fingerprint's bits are cut into blocks, one more than half the threshold (3 bits: two blocks of 32), so that a
pair within the threshold differs by at most one bit in some block. The anchors of a block are a covering code of
radius one: a perfect Hamming code on 2^r - 1 of its bits, the other bits as they are. A fingerprint's home is the
anchor within distance one; it is replicated to every anchor within two (covering radius plus block threshold). Two
fingerprints that differ by one bit in a block therefore meet at the home of either, and are compared there in
full. Nothing is missed and no cap is set: the linked pairs are exactly those within the threshold.

Equal fingerprints are one class before any comparison. An anchor's task returns a forest of its links, never all
pairs. Anchors with over a thousandth of all replicas, or over MOST_CELL of them, are cut into blocks of rows that meet
two by two in tasks of their own.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other;
a text of fewer words than a shingle is one shingle; a null id is never a component's id unless all are null; rows
that repeat are linked; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, HOT_SHARE, Seen, drop, join_dealt, join_groups, ship, table, without, written
from .graph import components

SHINGLE = 3
THRESHOLD = 3
SEED = 42
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: Replicas at one anchor that are compared in one task, at most.
MOST_CELL = 200_000.0
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, a list for each piece of about `size` bytes; no word is cut."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, in pieces."""
    digest, tail, seen = xxhash.xxh64_intdigest, [], False
    for part in word_pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        w = tail + part
        if len(w) >= shingle:
            seen = True
            yield np.array([digest(b" ".join(x), seed) for x in zip(*(w[i:] for i in range(shingle)))], dtype=np.uint64)
        tail = w[max(0, len(w) - shingle + 1) :]
    if not seen and tail:
        yield np.array([digest(b" ".join(tail), seed)], dtype=np.uint64)


def majority(hashes: Iterator[np.ndarray]) -> int:
    """A bit is 1 if over half of the hashes have it."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, fp: the fingerprint's bits as a signed long."""
    ship(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = np.array([fingerprint(x.as_py(), shingle, seed) for x in part.column(1)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, fp long")


class Cover:
    """The covering code of one block: bits lo to lo + width of a fingerprint."""

    def __init__(self, index: int, lo: int, width: int):
        self.index, self.lo, self.width = index, lo, width
        r = (width + 1).bit_length() - 1
        self.n, self.free = 2**r - 1, width - (2**r - 1)
        self.checks = np.array([sum(1 << (j - 1) for j in range(1, self.n + 1) if j >> k & 1) for k in range(r)], dtype=np.uint64)
        self.pairs = np.zeros((self.n + 1, self.n // 2), dtype=np.uint64)
        for s in range(1, self.n + 1):
            self.pairs[s] = [(1 << (j - 1)) | (1 << ((j ^ s) - 1)) for j in range(1, self.n + 1) if j < j ^ s]

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of fp, anchor, whether it is home; every anchor within distance two, each once."""
        u = np.uint64
        x = (fp >> u(self.lo)) & u(2**self.width - 1)
        syndrome = np.zeros(len(x), dtype=np.int64)
        for k, mask in enumerate(self.checks):
            syndrome |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << k
        home = np.where(syndrome > 0, x ^ (u(1) << np.maximum(syndrome - 1, 0).astype(u)), x)
        rows, off = np.arange(len(x)), np.flatnonzero(syndrome)
        out = [(rows, home, True), (np.repeat(off, self.pairs.shape[1]), (x[off, None] ^ self.pairs[syndrome[off]]).ravel(), False)]
        free = [u(1) << u(self.n + i) for i in range(self.free)]
        out += [(rows, home ^ f, False) for f in free]
        on = np.flatnonzero(syndrome == 0)
        out += [(on, x[on] ^ f ^ g, False) for i, f in enumerate(free) for g in free[:i]]
        return (np.concatenate([a for a, _, _ in out]), np.concatenate([b for _, b, _ in out]) | u(self.index << 40), np.concatenate([np.full(len(a), c) for a, _, c in out]))


def covers(threshold: int, bits: int = 64) -> list[Cover]:
    n = threshold // 2 + 1
    edges = [bits * i // n for i in range(n + 1)]
    return [Cover(i, edges[i], edges[i + 1] - edges[i]) for i in range(n)]


class Forest:
    """Union-find over the rows of one anchor."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self) -> np.ndarray:
        """Of all rows at once."""
        up = np.array(self.up)
        while (up[up] != up).any():
            up = up[up]
        return up

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, side: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """A forest of the links between rows of equal cell, sorted by cell; one of each pair must be at home."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    ends = np.repeat(np.r_[starts[1:], len(cell)], np.diff(np.r_[starts, len(cell)]))
    at, lag, forest, a, b = np.arange(len(cell)), 1, Forest(len(cell)), [], []
    at = at[at + 1 < ends]
    while len(at):
        to = at + lag
        near = (np.bitwise_count(fp[at] ^ fp[to]) <= threshold) & (home[at] | home[to]) & ((side[at] != side[to]) | (side[at] < 0))
        i_all, j_all = at[near], to[near]
        if len(i_all) > 256:
            # In a dense cell most links are within a component by now.
            root = forest.roots()
            apart = root[i_all] != root[j_all]
            i_all, j_all = i_all[apart], j_all[apart]
        for i, j in zip(i_all.tolist(), j_all.tolist()):
            if forest.link(i, j):
                a.append(i)
                b.append(j)
        lag += 1
        at = at[at + lag < ends[at]]
    return a, b


def links(classes: DataFrame, threshold: int = THRESHOLD, hot_share: float = HOT_SHARE) -> DataFrame:
    """classes(fp), distinct -> a, b: a forest for each anchor of the links within the threshold."""
    codes = covers(threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fp = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for code in codes:
                    row, anchor, home = code.anchors(fp)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    rows = written(classes.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean"))
    total = rows.count()
    # Hot anchors by two counts: of 65,536 groups of anchors, then of the anchors in the hot groups only.
    limit, group = F.lit(min(MOST_CELL, max(64.0, total * hot_share))), F.pmod(F.xxhash64("anchor"), F.lit(1 << 16)).alias("group")
    hot_groups = rows.groupBy(group).count().filter(F.col("count") >= limit).select("group")
    hot = written(rows.withColumn("group", group).join(F.broadcast(hot_groups), "group", "left_semi").groupBy("anchor").count().filter(F.col("count") >= limit).select("anchor", F.ceil(2 * F.col("count") / limit).cast("int").alias("blocks")))
    rows = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    # A row of block i meets block j in cell (min, max); within a cell of two blocks only rows of different blocks are
    # compared, in a cell of one block all.
    cells = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("cell"), F.lit(-1).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct((F.least(block, j) * F.col("blocks") + F.greatest(block, j)).alias("cell"), F.when(j == block, -1).otherwise(block).alias("side")))
    )
    rows = rows.select("anchor", "fp", "home", F.explode(cells).alias("c")).select(F.xxhash64("anchor", "c.cell").alias("key"), "anchor", "c.cell", "fp", "home", "c.side")
    rows = rows.repartition("key").sortWithinPartitions("key", "anchor", "cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            now = [np.concatenate(x) for x in zip(kept, now)] if kept else now
            # The last cell may go on in the next batch.
            last = (now[0] != now[0][-1]) | (now[1] != now[1][-1]) | (now[2] != now[2][-1])
            end = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            kept = [x[end:] for x in now]
            yield from forest([x[:end] for x in now])
        if kept:
            yield from forest(kept)

    def forest(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, anchor, cell, fp, home, side = cols
        if not len(key):
            return
        change = np.r_[True, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]
        a, b = _links(np.cumsum(change), fp.view(np.uint64), home.astype(bool), side, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a].astype(np.int64)), pa.array(fp[b].astype(np.int64))], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, seed: int = SEED) -> DataFrame:
    """id, fp, component_id: the least id that is reachable over links within the threshold."""
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed))
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    roots = components(written(links(classes, threshold)))
    members = written(classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).select("fp", "rep", "n", "root"))
    ids = written(members.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("docs")))
    n_classes, n_docs = members.agg(F.count(F.lit(1)), F.sum("n")).first()
    by_class = written(join_groups(members.select("fp", "n", "root"), ids.select("root", "component_id", "m"), ["root"], "m", n_classes).select("fp", "n", "component_id"))
    return join_groups(fps, by_class, ["fp"], "n", n_docs or 0).select("id", "fp", "component_id")


#: The near-duplicate rule of the pipeline: five-word shingles, and the share of them that two texts have in common.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Texts in which common shingles are looked for, and how many of those are put last in the order of shingles. The order
#: makes lists of texts short; whatever it is, no pair is missed.
ORDER_TEXTS, ORDER_MOST = 20_000, 200_000
#: Pairs a row up to which all pairs of a list are made.
PAIRS_A_ROW = 8
#: Rows of one side in a task's share of a long list.
LIST_PART = 64


def word_sequence(text: str | None) -> int:
    """A hash of the sequence of words."""
    whole = xxhash.xxh64()
    for part in word_pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        for w in part:
            whole.update(w + b" ")
    return whole.intdigest()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    parts = [np.unique(h) for h in shingle_hashes(text, shingle, SEED)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def prefix_length(size: int, similarity: float) -> int:
    """Of two sets with the similarity, each has a share of `similarity` of its elements in the other, so their first
    elements in any common order, all but that share and one more, have one in common."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def parities(h: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes by a power of two, at least twice as many as these: whether it is odd how many have
    it. Two sets differ by as many elements as their parities differ in bits, at least."""
    bits = 1 << max(6, (2 * len(h) - 1).bit_length() if len(h) else 0)
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Elements by which two sets differ, at least, from their parities; the longer ones are folded to the shorter."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, threshold: int = THRESHOLD) -> DataFrame:
    """id, keep_id of the documents that are near-duplicates of another; those that stay are not returned.

    Near-duplicate is a Jaccard similarity of shingles of at least `similarity`, counted exactly; the same words in the same
    order are one text. First by SimHash: of the texts whose fingerprints (of their different shingles) are linked, through
    anchors, to one component, those go that are similar to the first of it, by id. Fingerprints within a few bits miss
    similar texts where one has a part more, so the texts that are left meet again, by shared first shingles
    (prefix_length), in an order that puts common ones last: no similar pair is missed. In order of ids, a text stays
    then unless one before it that stays is similar.

    So no two that stay are similar, and what goes is similar to what stays, or to what goes for being similar to it. Rows that
    share an id share one fate.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    kind = source.schema["id"].dataType.simpleString()
    common = docs.sparkSession.sparkContext.broadcast(_common(source, shingle))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = common.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, same, size, fp, odd, first = batch.slice(at, 256), [], [], [], [], []
                for x in part.column(1):
                    text = x.as_py()
                    h = shingle_set(text, shingle)
                    rank = np.zeros(len(h), dtype=np.int64)
                    if len(often):
                        k = np.minimum(np.searchsorted(often, h), len(often) - 1)
                        rank = np.where(often[k] == h, times[k], 0)
                    same.append(word_sequence(text))
                    size.append(len(h))
                    fp.append(majority(h[i : i + PIECE] for i in range(0, len(h), PIECE)))
                    odd.append(parities(h))
                    first.append(h[np.lexsort((h, rank))[: prefix_length(len(h), similarity)]].view(np.int64))
                signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), signed(same), pa.array(size, pa.int64()), signed(fp), pa.array(odd, pa.binary()), pa.array(first, pa.list_(pa.int64()))], names=["id", "same", "size", "fp", "odd", "first"])

    rows = written(source.mapInArrow(prints, f"id {kind}, same long, size long, fp long, odd binary, first array<long>"))
    classes = written(rows.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("size", "fp", "odd", "first"))))
    similar = lambda pairs: _verified(source, classes, pairs, shingle, similarity)
    gone = [written(similar(_linked(classes, threshold, similarity)).select(F.col("b").alias("same"), F.col("a_rep").alias("keep_id")))]
    lists = without(classes, gone[0], "same").select(F.explode("first").alias("h"), "same")
    lengths = written(lists.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    total = classes.agg(F.sum(F.size("first"))).first()[0] or 0
    lists = join_groups(lists, lengths, ["h"], "m", total).select("h", "same")
    lists = written(lists.join(classes.select("same", "rep", "size").hint("shuffle_merge"), "same"))
    before = None
    while True:
        heads = written(lists.groupBy("h").agg(F.min(F.struct("rep", "same")).alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1"))
        n, pairs = heads.agg(F.sum("m"), F.sum(F.expr("cast(m as double) * (m - 1) / 2"))).first()
        if not n or pairs <= PAIRS_A_ROW * n or (before is not None and pairs > 0.9 * before):
            break
        before = pairs
        longer = written(join_groups(lists, heads, ["h"], "m", n).select("same", "rep", "size", (F.col("head.same") == F.col("same")).alias("leads"), F.col("head.same").alias("a"), F.col("head.rep").alias("a_rep")))
        # First in all lists: no undecided text before it can be similar.
        tops = written(longer.groupBy("same").agg(F.min("leads").alias("top"), F.first("size").alias("a_size")).filter("top").select(F.col("same").alias("a"), "a_size"))
        met = longer.filter("not leads").select("a", "a_rep", F.col("same").alias("b"), "rep", "size").distinct()
        sizes = written(met.groupBy("a").agg(F.count(F.lit(1)).alias("m")).join(tops, "a"))
        met = join_groups(met, sizes, ["a"], "m", n).filter(_sizes_fit(similarity)).select("a", "a_rep", "b")
        gone.append(written(similar(met).groupBy("b").agg(F.min("a_rep").alias("keep_id")).withColumnRenamed("b", "same")))
        old, lists = lists, written(without(lists, tops.select(F.col("a").alias("same")).union(gone[-1].select("same")), "same"))
        for x in (old, heads, longer):
            drop(x)
    if n:
        # All pairs of each list; a long one is dealt out, in parts of one side against all of the other.
        parts = F.ceil(F.col("m") / LIST_PART).cast("int")
        both = join_groups(lists, heads.select("h", "m"), ["h"], "m", n).withColumn("parts", parts)
        one = both.select("h", F.pmod(F.xxhash64("same"), F.col("parts")).cast("int").alias("part"), F.col("same").alias("a"), F.col("rep").alias("a_rep"), F.col("size").alias("a_size"))
        other = both.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("same").alias("b"), "rep", "size")
        met = one.join(other.hint("shuffle_merge"), ["h", "part"]).filter((F.col("a_rep") < F.col("rep")) | ((F.col("a_rep") == F.col("rep")) & (F.col("a") < F.col("b")))).filter(_sizes_fit(similarity))
        gone += _in_order(written(similar(met.select("a", "a_rep", "b").distinct())))
    drop(lists)
    gone = reduce(DataFrame.union, gone)
    # Copies go with the text they repeat: first all but the first of each class, then whole classes.
    copies = join_groups(rows.select("id", "same"), classes.select("same", "rep", "n"), ["same"], "n", rows.count())
    copies = copies.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone.hint("shuffle_merge"), "same", "left")
    return copies.select("id", F.coalesce("keep_id", "rep").alias("keep_id")).filter("id <> keep_id").distinct()


def _sizes_fit(similarity: float):
    return F.least("size", "a_size") >= F.lit(similarity) * F.greatest("size", "a_size")


def _common(source: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the shingles that are common in a sample of the texts, and how many of it have each."""
    share = min(1.0, ORDER_TEXTS / max(1, source.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                sets = [shingle_set(x.as_py(), shingle) for x in batch.column(0).slice(at, 64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    sample = source.select("text").sample(share, 6)
    found = sample.mapInArrow(run, "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(ORDER_MOST).collect()
    h = np.array([r[0] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r[1] for r in found], dtype=np.int64)[order]


def _linked(classes: DataFrame, threshold: int, similarity: float) -> DataFrame:
    """Pairs (a, a_rep, b): a is the first text of each component of linked fingerprints, b any other of a fitting size."""
    first = F.min(F.struct("rep", "same", "size")).alias("head")
    fps = written(classes.groupBy("fp").agg(first, F.count(F.lit(1)).alias("m")))
    roots = components(written(links(fps, threshold)))
    fps = written(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "head", "m", F.coalesce("root", "fp").alias("root")))
    heads = written(fps.groupBy("root").agg(F.min("head").alias("first"), F.sum("m").alias("docs"), F.count(F.lit(1)).alias("prints")).filter("docs > 1"))
    of = written(join_groups(fps.select("fp", "m", "root"), heads.select("root", "first", "prints"), ["root"], "prints", fps.count()).select("fp", "m", "first"))
    total = of.agg(F.sum("m")).first()[0] or 0
    met = join_groups(classes.select("same", "size", "fp"), of, ["fp"], "m", total).filter("same <> first.same")
    met = met.select(F.col("first.same").alias("a"), F.col("first.rep").alias("a_rep"), F.col("first.size").alias("a_size"), F.col("same").alias("b"), "size")
    return met.filter(_sizes_fit(similarity)).select("a", "a_rep", "b")


def _verified(source: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, a_rep, b) of classes that are similar: those whose parities allow it, then by all their shingles."""
    pairs = written(pairs)
    near = _with_both(pairs, classes.select("same", "size", "odd"))
    most = (1 - similarity) / (1 + similarity)

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            keep = [least_difference(x.as_py(), y.as_py()) <= most * n + 1e-9 for x, y, n in zip(batch.column("odd_a"), batch.column("odd_b"), size)]
            yield batch.select(["a", "a_rep", "b"]).filter(pa.array(keep, pa.bool_()))

    near = written(near.mapInArrow(allowed, pairs.select("a", "a_rep", "b").schema))
    wanted = written(near.select(F.col("a").alias("same")).union(near.select("b")).distinct().join(classes.select("same", "rep"), "same").select(F.col("rep").alias("id"), F.col("same").alias("wanted")))
    some = Seen(wanted, ["id"]).mark(source, "seen").filter("seen").select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                # An id may have several texts.
                own = [(w, x) for w, x in zip(part.column(1).to_pylist(), part.column(0).to_pylist()) if np.uint64(word_sequence(x)).view(np.int64) == w]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.int64()), pa.array([shingle_set(x, shingle).view(np.int64) for _, x in own], pa.list_(pa.int64()))], names=["same", "set"])

    found = written(some.join(wanted.hint("shuffle_merge"), "id").select("text", "wanted").mapInArrow(sets, "same long, set array<long>").dropDuplicates(["same"]))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return _with_both(near, found).filter(both >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - both)).select("a", "a_rep", "b")


def _with_both(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs(a, a_rep, b) with the columns of of(same, ...) for either side, named by it."""
    total, many = pairs.count(), {side: pairs.groupBy(side).agg(F.count(F.lit(1)).alias("m")) for side in "ab"}
    for side in "ab":
        own = of.select(F.col("same").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in of.columns if c != "same"))
        pairs = join_dealt(pairs, many[side].join(own.hint("shuffle_merge"), side), [side], "m", total, sizes=many[side])
    return pairs


def _in_order(edges: DataFrame) -> list[DataFrame]:
    """edges(a, a_rep, b), a before b -> tables same, keep_id of what goes: in rounds, what has nothing undecided before
    it stays, and what is linked to it goes."""
    out = []
    while not edges.isEmpty():
        tops = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out.append(written(edges.join(tops, "a").groupBy("b").agg(F.min("a_rep").alias("keep_id")).withColumnRenamed("b", "same")))
        off = out[-1].select("same")
        edges = written(edges.join(off.withColumnRenamed("same", "b"), "b", "left_anti").join(off.withColumnRenamed("same", "a"), "a", "left_anti"))
    return out


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
