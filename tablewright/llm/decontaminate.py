"""Benchmark decontamination: an FM-index of each shard of the training texts is searched for the test phrases.

Each task reads its documents in shards of a few megabytes, makes an FM-index of their words, runs all test
windows backward through its wavelet ranks, locates the occurrences by sampled suffix positions, and merges the spans
of each document. Nothing is shuffled and no text leaves its task. Words that no test item has are separators in
the index, since no window can cross them; so its alphabet is the benchmark's.

The benchmark is taken in blocks of at most BLOCK_WORDS words, which are all that is sent to the executors; more
blocks are more passes, a few at a time in one stage, so its size has no limit.

Defined cases: a null text has no words and no span; an item without words, or with a null id, is ignored; items
that share an id are one item; a window that several items have counts for each; a document longer than a shard is
indexed in pieces that overlap by a window; empty tables give empty or clean results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, written
from .fm_index import FMIndex

#: Words in a window.
WINDOW = 10
#: Bytes of text in a shard.
SHARD = 2 << 20
#: Words of benchmark items in a block: some 20 MB in each Python worker.
BLOCK_WORDS = 1 << 18
#: Passes in one stage, each with a Python worker of its own; then the rows are written to the shared folder.
CHAIN = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)

SPANS = "array<struct<first:long,last:long,start:long,end:long>>"


def cut_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words of lower-cased texts that begin at `starts`."""
    word = _IS_WORD[data]
    new = np.zeros(len(data) + 1, dtype=bool)
    new[starts], new[-1] = True, True
    before = np.r_[False, word[:-1]] & ~new[:-1]
    after = np.r_[word[1:], False] & ~new[1:]
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """A 64-bit hash of each word, 0 for words of more than `longest` bytes."""
    size, out = end - start, np.zeros(len(start), dtype=np.uint64)
    live = np.flatnonzero(size <= longest)
    for k in range(longest):
        live = live[size[live] > k]
        if not len(live):
            break
        h = (out[live] ^ (data[start[live] + k].astype(np.uint64) + np.uint64(1))) * _PRIME
        out[live] = h ^ (h >> np.uint64(29))
    return out


class Phrases:
    """The windows of a block of test items, as symbols: arrays, 50 bytes for each window of ten words and item."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        symbol: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.names)}
        rows, owner = [np.zeros((0, window), dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        for item, text in items:
            data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
            start, end = cut_words(data, np.zeros(1, dtype=np.int64)) if len(data) else ([], [])
            raw = data.tobytes()
            words = np.array([symbol.setdefault(raw[a:b], len(symbol) + 1) for a, b in zip(start, end)], dtype=np.int32)
            if len(words):
                # An item of fewer words than a window is one, with symbol 0 before it.
                words = np.r_[np.zeros(max(0, window - len(words)), dtype=np.int32), words]
                rows.append(np.unique(np.lib.stride_tricks.sliding_window_view(words, window), axis=0))
                owner.append(np.full(len(rows[-1]), number[item], dtype=np.int32))
        owner = np.concatenate(owner)
        self.patterns, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        order = np.lexsort((owner, of.ravel()))
        #: The items of window w are owner[first[w] : first[w + 1]], each once or more.
        self.owner, self.first = owner[order], np.searchsorted(of.ravel()[order], np.arange(len(self.patterns) + 1))
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.window, self.vocabulary = window, list(symbol)
        sizes = np.array([len(w) for w in self.vocabulary], dtype=np.int64)
        self.longest = int(sizes.max(initial=0))
        ends = np.cumsum(sizes)
        hashes = hash_words(np.frombuffer(b"".join(self.vocabulary), dtype=np.uint8), ends - sizes, ends, self.longest)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.by_hash = hashes[order], order + 1

    def words(self, w: int) -> list[bytes]:
        return [self.vocabulary[s - 1] for s in self.patterns[w, self.window - self.lengths[w] :]]

    def items(self, w: int) -> set[str]:
        return {self.names[k] for k in self.owner[self.first[w] : self.first[w + 1]]}

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.by_hash[at], 0)


def merge(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of words (first, last, exclusive) and bytes, in order, without overlap."""
    out: list[list[int]] = []
    for first, last, start, end in sorted(spans):
        if out and first <= out[-1][1]:
            if last > out[-1][1]:
                out[-1][1], out[-1][3] = last, end
        else:
            out.append([first, last, start, end])
    return [tuple(x) for x in out]


def search_shard(texts: list[bytes], phrases: Phrases) -> tuple[list[int], dict[int, list], dict[int, set]]:
    """Words of each text; spans and items of the texts that have any."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    data = _LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    if not len(data):
        return [0] * len(texts), {}, {}
    start, end = cut_words(data, begins[sizes > 0])
    edges = np.searchsorted(start, np.r_[begins, len(data)])
    counts = np.diff(edges)
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    if len(phrases.patterns) and len(start):
        found = phrases.symbols(hash_words(data, start, end, phrases.longest))
        # A separator after each text keeps windows inside it.
        document = np.repeat(np.arange(len(texts)), counts)
        stream = np.zeros(len(found) + len(texts), dtype=np.int64)
        stream[np.arange(len(found)) + document] = found
        index = FMIndex(stream, len(phrases.vocabulary))
        lo, hi = index.search(phrases.patterns, phrases.lengths)
        many = hi - lo
        window = np.repeat(np.arange(len(lo)), many)
        rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        at = index.locate(rows)
        raw = data.tobytes()
        in_stream = np.arange(len(found)) + document
        word = np.searchsorted(in_stream, at)
        for w, k in zip(window.tolist(), word.tolist()):
            wanted = phrases.words(w)
            n = len(wanted)
            # The exact check: hashes stand for words up to here.
            if all(raw[start[k + i] : end[k + i]] == x for i, x in enumerate(wanted)):
                d = int(document[k])
                first = k - int(edges[d])
                spans.setdefault(d, []).append((first, first + n, int(start[k] - begins[d]), int(end[k + n - 1] - begins[d])))
                items.setdefault(d, set()).update(phrases.items(w))
    return counts.tolist(), spans, items


def search_long(text: bytes, phrases: Phrases, shard: int) -> tuple[int, list, set]:
    """One text of more than a shard, in pieces that overlap by a window less one word."""
    at, base, total, spans, items = 0, 0, 0, [], set()
    while True:
        end = min(len(text), at + shard)
        while end < len(text) and _IS_WORD[_LOWER[text[end]]]:
            end += 1
        n, s, i = search_shard([text[at:end]], phrases)
        spans += [(a + base, b + base, c + at, d + at) for a, b, c, d in s.get(0, [])]
        items |= i.get(0, set())
        if end == len(text):
            return base + n[0], spans, items
        back = _LOWER[np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)]
        starts, _ = cut_words(back, np.zeros(1, dtype=np.int64))
        keep = min(phrases.window - 1, len(starts))
        nxt = at + int(starts[-keep]) if keep else end
        base += n[0] - keep
        # A piece always moves on: a shard holds far more than a window, but for words of its own size.
        if nxt <= at:
            shard *= 2
        at = max(nxt, at)


def search(batches: Iterator[pa.RecordBatch], phrases: Phrases, shard: int) -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
    """Each batch cut into shards: its rows, words, spans and items."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, size, end = [], 0, at
            while end < batch.num_rows and (size < shard):
                value = batch.column("text")[end].as_py()
                texts.append((value or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                end += 1
            long = {i for i, t in enumerate(texts) if len(t) > shard}
            n, spans, items = search_shard([b"" if i in long else t for i, t in enumerate(texts)], phrases)
            for i in long:
                n[i], spans[i], items[i] = search_long(texts[i], phrases, shard)
            yield batch.slice(at, end - at), n, [merge(spans.get(i, [])) for i in range(len(texts))], [items.get(i, set()) for i in range(len(texts))]
            at = end


def cut_out(text: str | None, spans: list) -> str | None:
    """The text without the spans; a line break stands for each."""
    if text is None or not spans:
        return text
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for _, _, start, end in spans:
        out.append(raw[at:start].rstrip(b" \t"))
        at = end
    return b"\n".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The benchmark's phrases, a block of bounded size at a time; one block at least."""
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    block, size, any_yet = [], 0, False
    for row in items.toLocalIterator():
        block.append((row.item, row.text))
        size += len(row.text) // 2 + 1
        if size >= block_words:
            yield Phrases(block, window)
            block, size, any_yet = [], 0, True
    if block or not any_yet:
        yield Phrases(block, window)


def find_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard: int = SHARD, block_words: int = BLOCK_WORDS, with_text: bool = False) -> DataFrame:
    """id, n_words, spans (merged; words and UTF-8 bytes), items (ids as strings), and with_text the text."""
    ship(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for k, phrases in enumerate(blocks(benchmark, item_col, item_text_col, window, block_words)):
        out = written(out) if k and k % CHAIN == 0 else out
        out = out.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(phrases), shard), out.schema)
    return out if with_text else out.drop("text")


def _pass(phrases, shard: int):
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n, spans, items in search(batches, phrases.value, shard):
            before = [[tuple(s.values()) for s in x] for x in rows.column("spans").to_pylist()]
            spans = [merge(a + b) if a else b for a, b in zip(before, spans)]
            items = [sorted(a | set(b)) for a, b in zip(items, rows.column("items").to_pylist())]
            as_dicts = [[dict(zip(("first", "last", "start", "end"), s)) for s in x] for x in spans]
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("text"), pa.array(n, pa.int64()), pa.array(as_dicts, kind), pa.array(items, pa.list_(pa.string()))], names=["id", "text", "n_words", "spans", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """id, the text without its spans, contaminated, and in the struct `rest` the columns of carry. What the removal
    joined anew is searched again, until nothing is found; with several blocks of items, over all blocks."""
    ship(docs.sparkSession)
    sc, shard = docs.sparkSession.sparkContext, options.get("shard", SHARD)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(False).alias("contaminated"), F.struct(F.lit(0).alias("_"), *carry).alias("rest"))
    passes = [sc.broadcast(p) for p in blocks(benchmark, options.get("item_col", "item_id"), options.get("item_text_col", "text"), options.get("window", WINDOW), options.get("block_words", BLOCK_WORDS))]
    while True:
        again = out if len(passes) == 1 else out.withColumn("contaminated", F.lit(False))
        for k, phrases in enumerate(passes):
            again = written(again) if k and k % CHAIN == 0 else again
            again = again.mapInArrow(_cleaning(phrases, shard), out.schema)
        if len(passes) == 1:
            return again
        # A cut for one block may have joined a window of another: once more, until no block finds any.
        again = written(again)
        before = out.filter("contaminated").select(F.col("id").alias("i"), F.lit(True).alias("was")).distinct()
        found = not again.filter("contaminated").isEmpty()
        out = again.join(before, F.col("id").eqNullSafe(F.col("i")), "left").withColumn("contaminated", F.col("contaminated") | F.coalesce("was", F.lit(False))).drop("i", "was")
        if not found:
            return out
        out = written(out)


def _cleaning(phrases, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo, texts, hit = list(range(batch.num_rows)), batch.column("text").to_pylist(), batch.column("contaminated").to_pylist()
            while todo:
                part, at, found = pa.RecordBatch.from_arrays([pa.array([texts[i] for i in todo], pa.string())], names=["text"]), 0, []
                for rows, _, spans, _ in search(iter([part]), phrases.value, shard):
                    for i, s in enumerate(spans):
                        if s:
                            row = todo[at + i]
                            texts[row], hit[row] = cut_out(texts[row], s), True
                            found.append(row)
                    at += rows.num_rows
                todo = found
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(hit), batch.column("rest")], names=["id", "text", "contaminated", "rest"])

    return run


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, n, win FROM (
    SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item_words WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM windows),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc_words, lengths WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN windows w ON p.n = w.n AND p.win = w.win),
hit_words AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
