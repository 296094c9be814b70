"""The FM-index against brute force; spans and edge cases."""

import random
import re

import numpy as np
import pytest

from tablewright.llm import decontaminate as dc
from tablewright.llm.fm_index import FMIndex, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def brute(text, items, window=10):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            win = w[i : i + window]
            for k in range(len(words) - len(win) + 1):
                if words[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(item)
    return len(words), len(hit), found


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_search_and_locate(seed):
    rng = np.random.default_rng(seed)
    text = np.r_[rng.integers(0, 4, 400), np.ones(70, dtype=np.int64), 0]
    order = suffix_array(text, 5)
    key = lambda i: [(0, int(j)) if text[j] == 0 else (1, int(text[j])) for j in range(i, next(j for j in range(i, len(text)) if text[j] == 0) + 1)]
    assert order.tolist() == sorted(range(len(text)), key=key)
    index = FMIndex(text, 5)
    patterns = [rng.integers(1, 6, rng.integers(1, 6)) for _ in range(80)]
    grid = np.zeros((80, 6), dtype=np.int64)
    for row, p in zip(grid, patterns):
        row[6 - len(p) :] = p
    lo, hi = index.search(grid, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi):
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def sample(seed):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "ÉTÉ", "d3", "x"]
    items = [(str(i), " ".join(rng.choices(vocab, k=rng.choice([0, 2, 9, 10, 11, 25])))) for i in range(12)]
    texts = [None, "", "...", "alpha"]
    for _ in range(30):
        parts = [" ".join(rng.choices(vocab + ["other"], k=rng.randrange(40))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(items)[1])
        texts.append("; ".join(parts).upper() if rng.random() < 0.2 else "-".join(parts))
    return items, texts


@pytest.mark.parametrize("shard", [64, 500, 1 << 20])
@pytest.mark.parametrize("block_words", [8, 1 << 20])
def test_spans_match_brute_force(spark, shard, block_words):
    items, texts = sample(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "alpha Beta"), ("0", None)], "item_id string, text string")
    rows = {r.id: r for r in dc.find_spans(docs, bench, shard=shard, block_words=block_words).collect()}
    for i, text in enumerate(texts):
        n, hit, found = brute(text, items)
        assert (rows[i].n_words, sum(s["last"] - s["first"] for s in rows[i].spans), set(rows[i].items)) == (n, hit, found), i


@pytest.mark.parametrize("block_words", [8, 1 << 20])
def test_nothing_is_left_after_removal(spark, block_words):
    items, texts = sample(4)
    items = [x for x in items if len(x[1].split()) >= 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for r in dc.decontaminate(docs, bench, block_words=block_words).collect():
        assert brute(r.text, items)[1] == 0
        assert r.contaminated == (brute(texts[r.id], items)[1] > 0)
        assert r.contaminated or r.text == texts[r.id]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (None, None, 6, "y")], "doc_id long, text string, n_words int, spans string")
    bench = spark.createDataFrame([(1, "A b", "z")], "item_id long, text string, doc_id string")
    got = {r.id: (r.n_words, len(r.spans)) for r in dc.find_spans(docs, bench).collect()}
    assert got == {1: (2, 1), None: (0, 0)}
    assert {r.id: r.rest.spans for r in dc.decontaminate(docs, bench, carry=("spans",)).collect()} == {1: "x", None: "y"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.find_spans(docs.limit(0), bench).count() == 0
    assert dc.find_spans(docs, bench.limit(0)).first().spans == []
