"""Language identification in two steps: the family, then one-versus-one linear SVMs within it.

Features are hashed byte pairs and triples of the lower-cased text, other than letters one space, as square roots of
shares. They are fitted on a bounded sample: the same number of labelled texts of each language, PER_LANGUAGE of each and
SAMPLE in all at most, chosen by hashes of language and text. Every language that has a text is learned, however
many there are (of more than SAMPLE languages, SAMPLE). Every text is scored as a whole.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text if nothing could be
learned; a null id falls in no fold, neither held out nor learned from; copies of a text under one language are learned
from once; equal texts get equal predictions; an empty table gives an empty result. Only the named columns are read, and
the text alone when predicting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket, ship, table, written

BINS = 4096
#: Texts (8 kB of features each) that are learned from, of one language and in all.
PER_LANGUAGE, SAMPLE = 300, 8000
FOLDS, HELD_OUT = 5, 0

# Families of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa sa si ur",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "celtic": "br cy ga gd",
    "semitic": "am ar he mt",
}

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    code = re.split("[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), lang)


def features(text: str) -> np.ndarray:
    data = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)].astype(np.uint32)
    data = data[np.r_[True, (data[1:] != 32) | (data[:-1] != 32)]]
    pair = data[:-1] * np.uint32(256) + data[1:]
    triple = pair[:-1] * np.uint32(256) + data[2:]
    counts = np.bincount((pair * np.uint32(2654435761)) >> np.uint32(21), minlength=BINS).astype(np.float32)
    counts += np.bincount(((triple * np.uint32(2246822519)) >> np.uint32(21)) + np.uint32(BINS // 2), minlength=BINS)
    root = np.sqrt(counts)
    return root / max(float(np.linalg.norm(root)), 1e-9)


def svms(x: np.ndarray, y: np.ndarray, steps: int = 200, penalty: float = 1e-3) -> np.ndarray:
    """Linear SVMs (squared hinge, both classes of equal weight) by accelerated gradient steps, one for each column of y;
    the last weight is the bias."""
    y = y.astype(np.float32)
    ones = lambda side: np.maximum(1, side.sum(axis=0))
    weight = np.where(y > 0, 0.5 / ones(y > 0), 0.5 / ones(y < 0)).astype(np.float32)
    w = last = np.zeros((x.shape[1] + 1, y.shape[1]), dtype=np.float32)
    for k in range(steps):
        v = w + np.float32(k / (k + 3)) * (w - last)
        slack = weight * np.maximum(np.float32(0), 1 - y * (x @ v[:-1] + v[-1])) * y
        last, w = w, v - np.float32(0.2) * (np.float32(penalty) * v - 2 * np.concatenate([x.T @ slack, slack.sum(axis=0, keepdims=True)]))
    return w


class Model:
    """Families by one-versus-rest, languages of a family by votes of one-versus-one SVMs."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.families = sorted({family(l) for l in langs})
        of = np.array([family(l) for l in langs], dtype=object)
        self.members = {f: sorted({l for l in langs if family(l) == f}) for f in self.families}
        self.columns: dict[object, int] = {}
        weights = []

        def add(keys, rows, y):
            for key in keys:
                self.columns[key] = len(self.columns)
            weights.append(svms(x[rows], y))

        if len(self.families) > 1:
            add(self.families, slice(None), np.where(of[:, None] == np.array(self.families, dtype=object), 1.0, -1.0))
        for members in self.members.values():
            for a, b in combinations(members, 2):
                rows = np.flatnonzero((langs == a) | (langs == b))
                add([(a, b)], rows, np.where(langs[rows] == a, 1.0, -1.0)[:, None])
        self.weights = np.concatenate(weights, axis=1) if weights else np.zeros((BINS + 1, 0), dtype=np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = x @ self.weights[:-1] + self.weights[-1]
        p = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        if len(self.families) > 1:
            by_family = p[:, [self.columns[f] for f in self.families]]
            by_family = by_family / np.maximum(by_family.sum(axis=1, keepdims=True), 1e-9)
            best, score = by_family.argmax(axis=1), by_family.max(axis=1)
        else:
            best, score = np.zeros(len(x), dtype=int), np.ones(len(x))
        langs: list[str] = [""] * len(x)
        for k, f in enumerate(self.families):
            rows, members = np.flatnonzero(best == k), self.members[f]
            share = np.zeros((len(rows), len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                q = p[rows, self.columns[a, b]]
                share[:, i] += q
                share[:, j] += 1 - q
            if len(members) > 1:
                score[rows] *= share.max(axis=1) / (len(members) - 1)
            for row, l in zip(rows, share.argmax(axis=1)):
                langs[row] = members[l]
        return langs, np.clip(score, 0, 1)


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).astype(np.float16).tobytes() if _LETTER.search(t.as_py()) else None for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.binary())], names=["lang", "same", "at", "x"])

    return rows.mapInArrow(run, "lang string, same long, at double, x binary").filter("x IS NOT NULL")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Learn from rows with a language outside the held-out fold. The driver gets `sample` rows of 8 kB at most."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter((bucket("id", FOLDS) > HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("same", F.xxhash64("text"))
    place = F.pmod(F.xxhash64(F.lit(5), "lang", "same"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    langs = written(rows.groupBy("lang").agg(F.approx_count_distinct("same").alias("n")))
    each = max(1, min(per_language, sample // max(1, langs.count())))
    # Half as many again, since the numbers of texts are estimates; then the first in the order of hashes.
    share = langs.orderBy(F.xxhash64("lang"), "lang").limit(sample).select("lang", (F.lit(1.5 * each) / F.col("n") + 1e-6).alias("share"))
    some = rows.withColumn("at", place).join(F.broadcast(share), "lang").filter(F.col("at") < F.col("share"))
    some = _featured(some.select("lang", "same", "at", "text")).dropDuplicates(["lang", "same"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("at", "same"))
    got = some.withColumn("nth", first).filter(F.col("nth") <= each).select("lang", "x").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    if not got:
        return None
    return Model(np.array([np.frombuffer(r.x, dtype=np.float16) for r in got], dtype=np.float32), np.array([r.lang for r in got], dtype=object))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.as_py() for t in part.column(1)]
                langs, score = ["und"] * len(texts), np.zeros(len(texts))
                rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if shared.value else []
                if rows:
                    found, p = shared.value.predict(np.array([features(texts[i]) for i in rows]))
                    score[rows] = p
                    for i, l in zip(rows, found):
                        langs[i] = l
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select(F.col("id").alias("doc_id"), (bucket("id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
