"""Brown class-based bigrams: exchange clustering assigns words to classes; a text's score is the sum of
log10 P(class | class before) + log10 P(word | class).

Passes over the texts. (1) Counts of every word, keyed by a 64-bit hash: summed in each task, then by a shuffle.
(2) Pair counts of units: the MOST_UNITS most frequent words are units of their own, the others for now are units by
their ending (ENDINGS of them). The exchange algorithm moves units between CLASSES classes while that raises the
likelihood of the training text under the class bigram model; it needs the unit pair counts alone, whose number is
bounded. (3) The classes before and after every other word, by one shuffle: each word that occurs twice or more moves to
the class under which its own contexts are likeliest, as the exchange would do with the classes of all others held. Words
that occur once, or never, stay in the class of their ending. Of the MOST_SUMMED most frequent words the contexts are summed
in each task first (10 MB), so that no word is hot. (4) Class pairs once more, by the classes that words now have.
(5) Scores: the MOST_SENT most frequent words, about, have counts and classes sent along (18 bytes each); other words
of each document are joined to theirs by a shuffle.

All counts cover all training documents. Smoothing: classes after a class are interpolated with the class
frequencies; within a class of N tokens and V words, P(word) = (c + 1) / (N + V + 1), so an unseen word counts as one.

Defined cases: a null text is empty, that is one end token; a null id is scored, neither held out nor learned
from; rows that repeat are documents of their own; without training documents all probabilities are 1 over the number of
outcomes of one; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, join_groups, table, written

CLASSES = 64
MOST_UNITS, ENDINGS = 800, 509
MOST_SUMMED, MOST_SENT = 20_000, 500_000
#: Most sweeps of the exchange; it ends when one moves nothing.
SWEEPS = 25
#: Occurrences from which on a word gets its class by its own contexts.
OWN_CLASS = 2
#: Weight, in tokens, of the class frequencies in what follows a class.
PRIOR = 5.0
FOLDS, HELD_OUT = 7, 2
#: Bytes of text that are counted at a time.
PIECE = 1 << 20
#: The hash that stands for the end of a document.
END = np.uint64(0)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LONG = 48


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of each word of the texts, and the words of each text."""
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    word = ~_SPACE[data]
    start, end = np.flatnonzero(word & ~np.r_[False, word[:-1]]), np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    size = end - start
    h, live = np.zeros(len(start), dtype=np.uint64), np.arange(len(start))
    for k in range(_LONG):
        live = live[size[live] > k]
        if not len(live):
            break
        x = (h[live] ^ (data[start[live] + k].astype(np.uint64) + np.uint64(1))) * _PRIME
        h[live] = x ^ (x >> np.uint64(29))
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), 4)
    last = data[end - 1].astype(np.int64) if len(end) else np.zeros(0, dtype=np.int64)
    before = np.where(size > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64) if len(end) else last
    ending = (last * 251 + before * 7 + np.minimum(size, 12) // 4 * 3) % ENDINGS
    edges = np.cumsum([len(t) + 1 for t in texts])
    return h, ending, np.diff(np.r_[0, np.searchsorted(start, edges)])


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their texts, about `size` bytes at a time."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, total, end = [], 0, at
            while end < batch.num_rows and total < size:
                texts.append((batch.column(column)[end].as_py() or "").encode("utf-8", "surrogatepass"))
                total += len(texts[-1])
                end += 1
            yield batch.slice(at, end - at), texts
            at = end


def _slices(texts: list[bytes], size: int = PIECE) -> Iterator[list[bytes]]:
    """The same texts, those of over `size` bytes cut at white space: for counts of words alone."""
    for text in texts:
        if len(text) <= 2 * size:
            continue
        at = 0
        while at < len(text):
            end = min(len(text), at + size)
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            yield [text[at:end]]
            at = end
    yield [t for t in texts if len(t) <= 2 * size]


def word_counts(training: DataFrame) -> DataFrame:
    """training(text) -> h, ending, c of every word and of the end token, whose ending is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, 0):
            for part in _slices(texts):
                h, ending, _ = cut(part)
                word, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ending[at]), pa.array(n.astype(np.int64))], names=["h", "ending", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([int(END)], pa.int64()), pa.array([None], pa.int64()), pa.array([len(texts)], pa.int64())], names=["h", "ending", "c"])

    return training.mapInArrow(run, "h long, ending long, c long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each h in the sorted keys, -1 if it is not there."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


class Units:
    """Units: 0 the edge of a document, then the endings, then frequent words."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)
        self.n = 1 + ENDINGS + len(words)

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        at = lookup(self.words, h)
        return np.where(at >= 0, 1 + ENDINGS + at, 1 + ending)

    def sequence(self, h: np.ndarray, ending: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """The units of several texts, an edge before, between and after them."""
        out = np.zeros(len(h) + len(n_words) + 1, dtype=np.int64)
        out[np.arange(len(h)) + np.repeat(np.arange(len(n_words)), n_words) + 1] = self.of(h, ending)
        return out


def unit_pairs(training: DataFrame, units: Units) -> DataFrame:
    """a, b, n: how often unit b follows unit a."""
    shared = training.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, 0):
            u = shared.value.sequence(*cut(texts))
            code, n = np.unique(u[:-1] * shared.value.n + u[1:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code // shared.value.n), pa.array(code % shared.value.n), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    return training.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """Class part of the training log likelihood, from the class pair counts."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum())


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, n_units: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit. Class 0 is the edge's alone. Each unit in turn, the most frequent first, goes where the
    likelihood is highest; ends when a sweep moves nothing."""
    total = np.bincount(a, n, n_units) + np.bincount(b, n, n_units)
    order = [u for u in np.argsort(-total, kind="stable") if u and total[u]]
    out = np.zeros(n_units, dtype=np.int64)
    out[order] = 1 + np.arange(len(order)) % (classes - 1)
    out[1:][total[1:] == 0] = 1
    right, left = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    right_edges, left_edges = np.searchsorted(a[right], np.arange(n_units + 1)), np.searchsorted(b[left], np.arange(n_units + 1))
    pairs = np.bincount(out[a] * classes + out[b], n, classes * classes).reshape(classes, classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            r, l = right[right_edges[u] : right_edges[u + 1]], left[left_edges[u] : left_edges[u + 1]]
            self_n = n[r][b[r] == u].sum()
            r, l = r[b[r] != u], l[a[l] != u]
            after = np.bincount(out[b[r]], n[r], classes)
            before = np.bincount(out[a[l]], n[l], classes)
            c = out[u]
            pairs[c] -= after
            pairs[:, c] -= before
            pairs[c, c] -= self_n
            # What each class would gain by taking the unit in: its row, its column, the cell of both, and its totals.
            rows = _xlogx(pairs + after).sum(1) - _xlogx(pairs).sum(1)
            cols = _xlogx(pairs + before[:, None]).sum(0) - _xlogx(pairs).sum(0)
            own = pairs.diagonal()
            both = _xlogx(own + after + before + self_n) - _xlogx(own + after) - _xlogx(own + before) + _xlogx(own)
            marginal = sum(_xlogx(m) - _xlogx(m + x.sum() + self_n) for m, x in ((pairs.sum(1), after), (pairs.sum(0), before)))
            gain = rows + cols + both + marginal
            gain[0] = -np.inf
            best = int(gain.argmax())
            best = best if gain[best] > gain[c] + 1e-6 else c
            pairs[best] += after
            pairs[:, best] += before
            pairs[best, best] += self_n
            out[u] = best
            moved += best != c
        if not moved:
            break
    return out


def contexts(training: DataFrame, units: Units, of: np.ndarray, classes: int, summed: np.ndarray) -> DataFrame:
    """h, before, after, n: how often a word that is no unit of its own stands between two classes. For the words of
    `summed`, sorted hashes, either side alone, the other one -1."""
    shared = training.sparkSession.sparkContext.broadcast((units, of, summed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of, summed = shared.value
        sums = np.zeros((2, len(summed) * classes), dtype=np.int64)

        def rows(h, before, after, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(before, pa.int16()), pa.array(after, pa.int16()), pa.array(n, pa.int64())], names=["h", "before", "after", "n"])

        for _, texts in pieces(batches, 0):
            h, ending, n_words = cut(texts)
            cls = of[units.sequence(h, ending, n_words)]
            at = np.arange(len(h)) + np.repeat(np.arange(len(n_words)), n_words) + 1
            place = lookup(summed, h)
            often = np.flatnonzero(place >= 0)
            for side, step in enumerate((-1, 1)):
                sums[side] += np.bincount(place[often] * classes + cls[at[often] + step], minlength=sums.shape[1])
            rare = np.flatnonzero((place < 0) & (lookup(units.words, h) < 0))
            word, place = np.unique(h[rare], return_inverse=True)
            code, n = np.unique((place * classes + cls[at[rare] - 1]) * classes + cls[at[rare] + 1], return_counts=True)
            yield rows(word[code // classes**2], code // classes % classes, code % classes, n)
        for side in range(2):
            for start in range(0, sums.shape[1], 1 << 16):
                code = start + np.flatnonzero(sums[side, start : start + (1 << 16)])
                both = [np.full(len(code), -1), np.full(len(code), -1)]
                both[side] = code % classes
                yield rows(summed[code // classes], *both, sums[side, code])

    return training.mapInArrow(run, "h long, before smallint, after smallint, n long")


def fits(pairs: np.ndarray) -> np.ndarray:
    """For each class before, then each class after, the log likelihood that each class adds to an occurrence there; half of
    the class's own frequency is taken off on either side, since a word's share of its class falls with the class's size."""
    classes = len(pairs)
    share = (pairs.sum(0) + 1) / (pairs.sum() + classes)
    steps = np.log((pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR))
    return np.concatenate([steps, steps.T]) - 0.5 * np.log(share)


def own_classes(found: DataFrame, pairs: np.ndarray, least: int = OWN_CLASS) -> DataFrame:
    """contexts -> h, k: the likeliest class of each word that occurs `least` times or more; class 0 is the edge's alone."""
    gains, classes = fits(pairs)[:, 1:], len(pairs)
    found = found.select("h", "before", "after", "n").repartition("h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def chosen(h, before, after, n):
            new = np.r_[True, h[1:] != h[:-1]]
            word, owner = h[new], np.cumsum(new) - 1
            times = np.zeros((len(word), 2 * classes))
            for side, start in ((before, 0), (after, classes)):
                live = side >= 0
                times += np.bincount(owner[live] * 2 * classes + start + side[live], n[live], times.size).reshape(times.shape)
            often = times[:, :classes].sum(axis=1) >= least
            return pa.RecordBatch.from_arrays([pa.array(word[often]), pa.array(((times[often] @ gains).argmax(axis=1) + 1).astype(np.int32))], names=["h", "k"])

        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                now = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.slice(at, 8192).columns]
                now = [np.concatenate(x) for x in zip(kept, now)] if kept else now
                # The last word may go on: its rows so far are one for each pair of classes at most.
                end = int(np.searchsorted(now[0], now[0][-1]))
                kept = _merged([x[end:] for x in now], classes)
                if end:
                    yield chosen(*(x[:end] for x in now))
        if kept:
            yield chosen(*kept)

    return found.mapInArrow(run, "h long, k int")


def _merged(rows: list[np.ndarray], classes: int) -> list[np.ndarray]:
    """Rows of one word (h, before, after, n), equal ones summed."""
    code, place = np.unique((rows[1] + 1) * (classes + 1) + rows[2] + 1, return_inverse=True)
    return [np.full(len(code), rows[0][0]), code // (classes + 1) - 1, code % (classes + 1) - 1, np.bincount(place, rows[3]).astype(np.int64)]


class Head:
    """Counts and classes of the words that are sent along, and the classes of endings."""

    def __init__(self, h: np.ndarray, c: np.ndarray, k: np.ndarray, endings: np.ndarray):
        order = np.argsort(h)
        self.h, self.c, self.k, self.endings = h[order], c[order], k[order].astype(np.int16), endings.astype(np.int16)

    def of(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, -1 if it is not here; its class, by its ending if it is not here."""
        at = lookup(self.h, h)
        return at, np.where(at >= 0, self.k[at] if len(self.k) else 0, self.endings[ending]).astype(np.int64)


def class_pairs(training: DataFrame, head: Head, classes: int) -> np.ndarray:
    """How often a class follows a class; class 0 is the edge of a document."""
    shared = training.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, dtype=np.int64)
        for _, texts in pieces(batches, 0):
            h, ending, n_words = cut(texts)
            k = np.zeros(len(h) + len(n_words) + 1, dtype=np.int64)
            k[np.arange(len(h)) + np.repeat(np.arange(len(n_words)), n_words) + 1] = shared.value.of(h, ending)[1]
            total += np.bincount(k[:-1] * classes + k[1:], minlength=classes * classes)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    out = np.zeros(classes * classes)
    for r in training.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(classes, classes)


class Model:
    """Transitions, and the words whose counts and classes are sent along."""

    def __init__(self, head: Head, pairs: np.ndarray, tokens: int, words: int, class_tokens: np.ndarray, class_words: np.ndarray, ends: int):
        self.head, self.tokens, self.words, self.ends = head, tokens, words, ends
        share = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs))
        self.transitions = np.log10((pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR))
        #: Denominators of the words of each class, and of the unigram model.
        self.of_class = np.log10(class_tokens + class_words + 1.0)
        self.of_all = float(np.log10(tokens + words + 1))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known ones, base and model score without the rare words; for each rare word of a text:
        the text, hash, class by its ending, times; and for each step to or from a rare word: the text, both sides (a class,
        or the rare word's place in its text, plus the number of classes), times."""
        classes = len(self.transitions)
        h, ending, n_words = cut(texts)
        n, document = len(texts), np.repeat(np.arange(len(texts)), n_words)
        at, k = self.head.of(h, ending)
        known = at >= 0
        logs = np.log10(self.head.c[at[known]] + 1.0)
        base = np.bincount(document[known], logs - self.of_all, n) + np.log10(self.ends + 1.0) - self.of_all
        total = np.bincount(document[known], logs - self.of_class[k[known]], n)
        n_known = np.bincount(document[known], minlength=n) + (self.ends > 0)
        # The rare words of each text, each once.
        rare = np.flatnonzero(~known)
        order = rare[np.lexsort((h[rare], document[rare]))]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (document[order][1:] != document[order][:-1])
        starts = np.flatnonzero(new)
        keep = order[starts]
        # A side of a step: the class, or a rare word's place in its text.
        first_of = np.searchsorted(document[keep], np.arange(n))
        side = k.copy()
        side[order] = classes + (np.cumsum(new) - 1) - first_of[document[order]]
        line = np.zeros(len(h) + n + 1, dtype=np.int64)
        line[np.arange(len(h)) + document + 1] = side
        left, right, owner = line[:-1], line[1:], np.repeat(np.arange(n), n_words + 1)
        local = (left < classes) & (right < classes)
        total = total + np.bincount(owner[local], self.transitions[left[local], right[local]], n)
        owner, left, right = owner[~local], left[~local], right[~local]
        step = np.lexsort((right, left, owner))
        owner, left, right = owner[step], left[step], right[step]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        at = np.flatnonzero(new)
        return n_words + 1, n_known, base, total, document[keep], h[keep], k[keep], np.diff(np.r_[starts, len(order)]), owner[at], left[at], right[at], np.diff(np.r_[at, len(owner)])


def _least(counts: DataFrame, most: int) -> int:
    """The smallest count that at most `most` words have or exceed."""
    total, out = 0, None
    for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("c")).limit(most + 1).toLocalIterator():
        total += r.v
        out = r.c + 1 if out is None else out
        if total > most:
            break
        out = r.c
    return out or 1


def fit(docs: DataFrame, classes: int = CLASSES, most_units: int = MOST_UNITS, most_sent: int = MOST_SENT, sweeps: int = SWEEPS, own_class: int | None = OWN_CLASS, most_summed: int = MOST_SUMMED) -> tuple[Model, DataFrame]:
    """docs(id, text) -> the model, and the counts and classes (h, c, k) of the words that are not in it. With own_class None
    all words but the units keep the class of their ending."""
    spark = docs.sparkSession
    training = docs.filter((bucket("id", FOLDS) >= 0) & (bucket("id", FOLDS) != HELD_OUT)).select("text")
    counts = written(word_counts(training))
    tokens, words, ends = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("ending").isNull(), F.col("c")))).first()
    tokens, ends = tokens or 0, ends or 0
    spread = counts.filter("ending IS NOT NULL")
    top = np.array([r.h for r in spread.orderBy(F.desc("c"), "h").limit(most_summed).select("h").collect()], dtype=np.int64).view(np.uint64)
    units = Units(top[:most_units])
    found = unit_pairs(training, units).toArrow()
    a, b, n = (found[k].to_numpy() for k in "abn")
    of = exchange(a, b, n.astype(np.float64), units.n, classes, sweeps)
    pairs = np.bincount(of[a] * classes + of[b], n, classes * classes).reshape(classes, classes)
    endings = of[1 : 1 + ENDINGS]
    own = spark.createDataFrame([(int(w), int(k)) for w, k in zip(units.words.view(np.int64), of[1 + ENDINGS :])], "h long, k int")
    if own_class is not None:
        own = own.union(own_classes(contexts(training, units, of, classes, np.sort(top[most_units:])), pairs, own_class))
    by_ending = F.element_at(F.array(*map(F.lit, endings.tolist())), F.col("ending").cast("int") + 1)
    placed = written(spread.join(own.hint("shuffle_merge"), "h", "left").select("h", "c", F.coalesce("k", by_ending).cast("int").alias("k")))
    least = _least(placed, most_sent)
    sent = placed.filter(F.col("c") >= least).toArrow()
    head = Head(sent["h"].to_numpy().view(np.uint64), sent["c"].to_numpy(), sent["k"].to_numpy(), endings)
    pairs = class_pairs(training, head, classes)
    class_tokens, class_words = np.zeros(classes), np.zeros(classes)
    for r in placed.groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        class_tokens[r.k], class_words[r.k] = r.c, r.v
    return Model(head, pairs, int(tokens), int(words), class_tokens, class_words, int(ends)), placed.filter(F.col("c") < least)


def score(docs: DataFrame, model: Model, rare_words: DataFrame) -> DataFrame:
    """docs(id, text) -> id, n_tokens, n_known, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, 2):
            n, known, base, total, document, h, k, times, owner, left, right, many = shared.value.score(texts)
            lists = lambda of, *arrays: [pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), pa.array(x, t)) for x, t in arrays]
            words = lists(document, (h.view(np.int64), pa.int64()), (k, pa.int32()), (times, pa.int32()))
            steps = lists(owner, (left, pa.int32()), (right, pa.int32()), (many, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), *words, *steps], names=["row", "id", "n_tokens", "known", "base", "total", "hs", "ks", "times", "lefts", "rights", "many"])

    kind = docs.schema["id"].dataType.simpleString()
    # The row number is written with the scores, so it does not depend on how the texts are read again.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    plain = f"row long, id {kind}, n_tokens long, known long, base double, total double"
    first = written(rows.mapInArrow(run, f"{plain}, hs array<long>, ks array<int>, times array<int>, lefts array<int>, rights array<int>, many array<int>"))
    rare = first.select("row", F.posexplode("hs").alias("place", "h"))
    # A word that training lacks can be in any number of rows.
    sizes = written(rare.groupBy("h").agg(F.count(F.lit(1)).alias("m")).join(rare_words.hint("shuffle_merge"), "h", "left"))
    rows_in_all = sizes.agg(F.sum("m")).first()[0] or 0
    # Words as (place, count, class): class -1 is that of the ending.
    word = F.struct("place", F.coalesce("c", F.lit(0).cast("long")).alias("c"), F.coalesce("k", F.lit(-1)).alias("k"))
    found = join_groups(rare, sizes, ["h"], "m", rows_in_all).groupBy("row").agg(F.sort_array(F.collect_list(word)).alias("words"))
    late = first.filter(F.size("hs") > 0).join(found.hint("shuffle_merge"), "row").select("row", "id", "n_tokens", "known", "base", "total", "ks", "times", "lefts", "rights", "many", F.col("words.c").alias("cs"), F.col("words.k").alias("own"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        classes = len(model.transitions)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                known, base, total = (batch.column(j)[i].as_py() for j in (3, 4, 5))
                ks, times, left, right, many, c, own = (batch.column(j)[i].values.to_numpy() for j in range(6, 13))
                k = np.where(own >= 0, own, ks)
                log = np.log10(c + 1.0)
                side = np.r_[np.arange(classes), k]
                base += float((times * (log - model.of_all)).sum())
                total += float((times * (log - model.of_class[k])).sum() + (many * model.transitions[side[left], side[right]]).sum())
                out.append((known + int(times[c > 0].sum()), base, total))
            known, base, total = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:3], pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64())], names=["id", "n_tokens", "n_known", "base_score", "score"])

    done = late.mapInArrow(finish, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return done.union(first.filter(F.size("hs") == 0).select("id", "n_tokens", "known", "base", "total"))


def perplexity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    model, rare = fit(docs)
    out = score(docs, model, rare)
    return out.select(F.col("id").alias("doc_id"), (bucket("id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
