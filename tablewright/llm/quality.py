"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits a lookup table of each feature: in turn, a shallow tree over the feature's bins takes a small
step along the gradient. Then the pairs whose residuals a cut in four explains best get tables of their own, boosted
alike. A score is a sum of table entries, looked up for all documents of a batch at once.

Fitted on at most SAMPLE labelled documents, chosen by hashes of id and text; every whole text is scored.

Defined cases: a null text is empty and scored as such; labels that are null, or of a null or unknown id, are not
learned from; those of one id are one example with their mean as label and their number as weight; different texts of
one id are examples each, equal ones one; with no label the score is 0.5, with one class it is near that class; equal
texts get equal scores; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, ship, table, written

SAMPLE = 20_000
FOLDS, HELD_OUT = 3, 1
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1
#: Bytes of a text that are read at a time.
PIECE = 1 << 20

FEATURES = (
    "words", "word_length", "long_words", "short_words", "letters", "digits", "upper", "spaces", "stops", "symbols",
    "distinct", "top_word", "repeated_lines", "line_words", "line_ends", "capitalised", "symbol_ends", "runs", "pair_repeats",
)

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 stop, 6 symbol
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 1, 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_STOPS = frozenset(b".!?:;\"'")
_SYMBOLS = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~!")


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.zeros(7, dtype=np.int64)
    for at in range(0, len(raw), PIECE):
        kinds += np.bincount(_CLASS[np.frombuffer(raw[at : at + PIECE], dtype=np.uint8)], minlength=7)
    size = max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    letters = max(1, int(kinds[1] + kinds[2]))
    runs = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(len(words))), float(lengths.sum() / n), float((lengths > 14).sum() / n), float((lengths <= 3).sum() / n),
        (kinds[1] + kinds[2]) / size, kinds[3] / size, kinds[2] / letters, kinds[4] / size, kinds[5] / size, kinds[6] / size,
        len(counts) / n, max(counts.values(), default=0) / n, 1 - len(set(lines)) / n_lines if lines else 0.0, float(np.log1p(n / n_lines)),
        sum(x.rstrip()[-1] in _STOPS for x in lines) / n_lines, sum(65 <= x[0] <= 90 for x in words) / n,
        sum(x[-1] in _SYMBOLS for x in words) / n, runs / n, 1 - pairs / (n - 1) if len(words) > 1 else 0.0,
    ]


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int = 4, ridge: float = 1.0) -> np.ndarray:
    """A tree over ordered bins: the value of each bin."""
    parts, gain_of = [(0, len(gradient))], lambda g, h: g * g / (h + ridge)
    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            g, h = np.cumsum(gradient[a:b]), np.cumsum(hessian[a:b])
            if b - a < 2:
                continue
            gain = gain_of(g[:-1], h[:-1]) + gain_of(g[-1] - g[:-1], h[-1] - h[:-1]) - gain_of(g[-1], h[-1])
            cut = int(gain.argmax())
            if gain[cut] > 1e-9 and (best is None or gain[cut] > best[0]):
                best = (gain[cut], k, a + cut + 1)
        if best is None:
            break
        _, k, cut = best
        a, b = parts.pop(k)
        parts += [(a, cut), (cut, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (hessian[a:b].sum() + ridge)
    return out


def _cross(gradient: np.ndarray, hessian: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of a table of two features in four quadrants: its gain, and the table's values."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    quads = []
    for t in (g, h):
        a, b, c = t[:-1, :-1], t[:-1, -1:], t[-1:, :-1]
        quads.append((a, b - a, c - a, t[-1, -1] - b - c + a))
    gain = sum(x * x / (y + ridge) for x, y in zip(*quads)) - g[-1, -1] ** 2 / (h[-1, -1] + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(gradient)
    for (rows, cols), x, y in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), *quads):
        out[rows, cols] = x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j]), out


class Additive:
    """Lookup tables of single features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE, pairs: int = PAIRS):
        weight = np.ones(len(y)) if weight is None else weight
        mean = float(np.clip(((weight * y).sum() + 0.5) / (weight.sum() + 1), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        cuts = lambda col, bins: np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) if len(col) else np.zeros(0)
        self.edges = [cuts(col, BINS) for col in x.T]
        self.coarse = [cuts(col, PAIR_BINS) for col in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(set(y.tolist())) < 2:
            return
        binned = [np.searchsorted(e, col, side="right") for e, col in zip(self.edges, x.T)]
        total = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-total))
            return weight * (y - p), weight * p * (1 - p)

        for _ in range(rounds):
            for t, b in zip(self.tables, binned):
                g, h = slopes()
                step = rate * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
                t += step
                total += step[b]
        coarse = [np.searchsorted(e, col, side="right") for e, col in zip(self.coarse, x.T)]
        width = [len(e) + 1 for e in self.coarse]
        grid = lambda v, i, j: np.bincount(coarse[i] * width[j] + coarse[j], v, width[i] * width[j]).reshape(width[i], width[j])
        g, h = slopes()
        gains = {(i, j): _cross(grid(g, i, j), grid(h, i, j))[0] for i, j in combinations(range(x.shape[1]), 2) if min(width[i], width[j]) > 1}
        self.pairs = [(i, j, np.zeros((width[i], width[j]))) for i, j in sorted(gains, key=lambda k: (-gains[k], k))[:pairs]]
        for _ in range(pair_rounds):
            for i, j, t in self.pairs:
                g, h = slopes()
                step = rate * _cross(grid(g, i, j), grid(h, i, j))[1]
                t += step
                total += step[coarse[i], coarse[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for e, t, col in zip(self.edges, self.tables, x.T):
            total += t[np.searchsorted(e, col, side="right")]
        for i, j, t in self.pairs:
            total += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _place(*cols) -> Column:
    """A number from 0 to 1 by the hash of a row."""
    return F.pmod(F.xxhash64(F.lit(10), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Additive:
    """Learn from labelled rows outside the held-out fold: `sample` ids at most (40 bytes each) are broadcast to the
    documents, and the features of `sample` texts at most (180 bytes each) come to the driver. Labels are summed for each
    id before they meet the documents, so no pairs of equal ids arise however often an id repeats on either side."""
    rows = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label"))
    fold = bucket("label_id", FOLDS)
    rows = rows.filter((fold >= 0) & (fold != HELD_OUT) & F.col("label").isNotNull())
    rows = written(rows.groupBy("label_id").agg(F.avg("label").alias("label"), F.count(F.lit(1)).alias("weight")))
    n = rows.count()
    if n > sample:
        rows = rows.withColumn("at", _place("label_id")).filter(F.col("at") < 1.2 * sample / n + 1e-6).orderBy("at", "label_id").limit(sample).drop("at")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), F.col("id") == F.col("label_id"))
    most = found.select("label_id").count()
    found = found.select("label_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"), "label", "weight", "text")
    if most > sample:
        # Ids that repeat: rows by the hash of id and text.
        found = found.filter(_place("label_id", "same") < 1.2 * sample / most + 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(x, pa.list_(pa.float64()))], names=["label_id", "same", "label", "weight", "x"])

    found = found.mapInArrow(run, f"label_id {found.schema['label_id'].dataType.simpleString()}, same long, label double, weight long, x array<double>").dropDuplicates(["label_id", "same"])
    if most > sample:
        found = found.orderBy(_place("label_id", "same"), "label_id", "same").limit(sample)
    got = found.collect()
    got.sort(key=lambda r: (r.label, r.weight, r.x))
    return Additive(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.clip([r.label for r in got], 0, 1), np.array([r.weight for r in got], dtype=np.float64))


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score, and the columns of keep as they are."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.array([features(t.as_py()) for t in part.column(1)]).reshape(part.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(x)), *part.columns[2:]], names=["id", "score", *part.schema.names[2:]])

    types = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join([f"id {types['id']}", "score double", *(f"kept_{i} {types[f'kept_{i}']}" for i in range(len(keep)))])
    return source.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), (bucket("id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
