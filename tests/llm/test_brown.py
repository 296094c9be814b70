"""Brown classes against plain counting: base score, class model, likelihood."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import brown

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def corpus():
    rng = random.Random(7)
    nouns, verbs = [f"noun{i}o" for i in range(30)], [f"verb{i}x" for i in range(30)]
    rows = []
    for i in range(200):
        text = " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)}\ta {rng.choice(nouns)}." for _ in range(rng.randrange(1, 30)))
        rows.append((i, text + f" rare{i} Ünï" * (i % 3)))
    return rows + [(300, None), (301, ""), (302, " \n "), (None, "the noun1o"), (5, "again five"), (303, "x" * 100 + " " + "é" * 60), (305, "the a " * 5000)]


def train(rows):
    return [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]


def h(words):
    return brown.cut([" ".join(words).encode()])[:2]


@pytest.mark.parametrize("sent,piece,own", [(10**6, 1 << 20, 2), (30, 200, 2), (30, 1 << 20, None)])
def test_scores_match_plain_counting(spark, monkeypatch, sent, piece, own):
    for f in (brown.pieces, brown._slices):
        monkeypatch.setattr(f, "__defaults__", (piece,))
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, h string")
    model, rare = brown.fit(df, classes=8, most_units=20, most_sent=sent, own_class=own, most_summed=40)
    counts = Counter("</s>" if w is None else w for _, t in train(rows) for w in [*WORD.findall(lower(t)), None])
    N, V = sum(counts.values()), len(counts)
    assert (model.tokens, model.words) == (N, V)
    assert (len(model.head.h) < V - 1) == (sent < 100)

    types = [w for w in counts if w != "</s>"]
    classes = {int(x): int(k) for x, k in zip(model.head.h, model.head.k)}
    in_head = set(classes)
    classes.update({r.h % 2**64: r.k for r in rare.collect()})
    by_ending = lambda w: int(model.head.endings[h([w])[1][0]])
    class_of = lambda w: classes.get(int(h([w])[0][0]), by_ending(w))
    assert len(classes) == V - 1
    tokens, kinds = Counter(), Counter()
    for w in types:
        tokens[class_of(w)] += counts[w]
        kinds[class_of(w)] += 1
    pairs = Counter()
    for _, t in train(rows):
        seq = [0, *(class_of(w) if int(h([w])[0][0]) in in_head else by_ending(w) for w in WORD.findall(lower(t))), 0]
        pairs.update(zip(seq, seq[1:]))
    total = sum(pairs.values())
    share = [(sum(pairs[i, j] for i in range(8)) + 1) / (total + 8) for j in range(8)]
    row = [sum(pairs[i, j] for j in range(8)) for i in range(8)]
    step = lambda i, j: math.log10((pairs[i, j] + brown.PRIOR * share[j]) / (row[i] + brown.PRIOR))
    got = sorted(((r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in brown.score(df, model, rare).collect()), key=str)
    want = []
    for i, t in rows:
        words = WORD.findall(lower(t))
        base = sum(math.log10((counts[w] + 1) / (N + V + 1)) for w in [*words, "</s>"])
        own_of = [class_of(w) for w in words]
        score = sum(step(x, y) for x, y in zip([0, *own_of], [*own_of, 0]))
        score += sum(math.log10((counts[w] + 1) / (tokens[c] + kinds[c] + 1)) for w, c in zip(words, own_of))
        want.append((i, len(words) + 1, sum(counts[w] > 0 for w in [*words, "</s>"]), base, score))
    want.sort(key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9)


def test_each_word_has_the_class_of_its_own_contexts(spark):
    rows, classes = corpus(), 6
    texts = [WORD.findall(lower(t)) for _, t in train(rows)]
    df = spark.createDataFrame([(t,) for _, t in train(rows)], "text string")
    words = sorted({w for t in texts for w in t})
    units = brown.Units(h(words[:15])[0])
    rng = np.random.default_rng(4)
    of = np.r_[0, rng.integers(1, classes, units.n - 1)]
    pairs = rng.integers(0, 50, (classes, classes)).astype(float)
    got = {r.h % 2**64: r.k for r in brown.own_classes(brown.contexts(df, units, of, classes, np.sort(h(words[15:30])[0])), pairs, 2).collect()}
    share = (pairs.sum(0) + 1) / (pairs.sum() + classes)
    step = (pairs + brown.PRIOR * share) / (pairs.sum(1, keepdims=True) + brown.PRIOR)
    score, count = {}, Counter(w for t in texts for w in t)
    cls = lambda w: int(of[units.of(*h([w]))[0]])
    for t in texts:
        seq = [0, *map(cls, t), 0]
        for i, w in enumerate(t):
            mine = score.setdefault(w, np.zeros(classes))
            mine += np.log(step[seq[i]] * step[:, seq[i + 2]] / share)
    want = {int(h([w])[0][0]): 1 + int(score[w][1:].argmax()) for w in words[15:] if count[w] >= 2}
    assert got == want and len(want) > 50


def test_exchange_finds_word_classes():
    rng = np.random.default_rng(1)
    truth = np.r_[0, rng.integers(1, 4, 40)]
    steps = np.array([[0, 1, 0, 0], [0, 0.1, 0.8, 0.1], [0, 0.1, 0.1, 0.8], [0, 0.8, 0.1, 0.1]])
    members = [np.flatnonzero(truth == k) for k in range(4)]
    seq, c = [0], 1
    for _ in range(20000):
        seq.append(int(rng.choice(members[c])))
        c = int(rng.choice(4, p=steps[c] / steps[c].sum()))
    u = np.array([*seq, 0])
    code, n = np.unique(u[:-1] * 41 + u[1:], return_counts=True)
    out = brown.exchange(code // 41, code % 41, n.astype(float), 41, classes=4)
    for k in range(1, 4):
        assert len(set(out[members[k]])) == 1
    assert len(set(out[1:])) == 3
    pairs = lambda of: np.bincount(of[code // 41] * 4 + of[code % 41], n, 16).reshape(4, 4)
    assert brown.likelihood(pairs(out)) >= brown.likelihood(pairs(np.r_[0, 1 + np.arange(40) % 3])) - 1e-6


def test_better_than_unigrams_and_empty(spark):
    df = spark.createDataFrame(corpus(), "id long, text string")
    model, rare = brown.fit(df, classes=8, most_units=40)
    got = brown.score(df, model, rare).filter("n_tokens > 20").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    empty = df.limit(0)
    model, rare = brown.fit(empty)
    assert brown.score(empty, model, rare).count() == 0
    assert brown.score(df, model, rare).filter("n_known > 0").count() == 0


def test_a_word_that_training_lacks_in_a_third_of_all_rows(spark):
    """One held-out id with many rows: its new words are in as many rows, and scored like any other."""
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = corpus() + [(held, "brandnew word of the fold " + "x" * (i % 5)) for i in range(150)] + [(None, "brandnew again")] * 150
    df = spark.createDataFrame(rows, "id long, text string")
    model, rare = brown.fit(df, classes=8, most_units=20, most_sent=30)
    key = lambda r: (str(r.id), r.n_tokens, r.n_known, round(r.base_score, 8), round(r.score, 8))
    got = Counter(map(key, brown.score(df, model, rare).collect()))
    # Each different row alone, in a table where no word is frequent, times its number.
    many = Counter(rows)
    once = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(many)], "id long, text string")
    alone = {r.id: r for r in brown.score(once, model, rare).collect()}
    want = Counter()
    for k, ((i, _), n) in enumerate(many.items()):
        want[(str(i), *key(alone[k])[1:])] += n
    assert got == want and sum(got.values()) == len(rows)
