"""The additive model: separates what it should, pairs included, and stands odd input."""

import random
import zlib

import numpy as np

from tablewright.llm import quality


def test_single_features_and_a_pair():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    model = quality.Additive(x[:3000], y[:3000])
    assert (((model.score(x[3000:]) >= 0.5) == y[3000:]).mean()) > 0.95
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    y = (x[:, 2] > 0.3).astype(float)
    model = quality.Additive(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.99
    # A score is the sum of table entries.
    total = model.base + sum(t[np.searchsorted(e, x[0, k], side="right")] for k, (e, t) in enumerate(zip(model.edges, model.tables)))
    total += sum(t[np.searchsorted(model.coarse[i], x[0, i], side="right"), np.searchsorted(model.coarse[j], x[0, j], side="right")] for i, j, t in model.pairs)
    assert np.isclose(model.score(x[:1])[0], 1 / (1 + np.exp(-total)))


def test_documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    good = lambda: ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(5)) + "."
    bad = lambda: " | ".join(word().upper() + "$$$" for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "x") for i in range(400)] + [(900, None, "x"), (901, "", "x"), (None, "a b", "x"), (902, good() * 500, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(5, None), (None, 1), (7, 1), (7, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.id: r.score for r in quality.score(docs, model, keep=("score",)).collect()}
    assert all((got[i] >= 0.5) == bool(i % 3) for i in range(400))
    assert len(got) == 404 and got[900] == got[901] and all(0 <= s <= 1 for s in got.values()) and got[902] > 0.5
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality.score(docs, none).collect()} == {0.5}
    sampled = quality.fit(docs, labels, sample=100)
    assert np.mean([(r.score >= 0.5) == bool(r.id % 3) for r in quality.score(docs, sampled).collect() if r.id is not None and r.id < 400]) > 0.95


def plain_features(text):
    """The features from their meaning, letter by letter."""
    raw = (text or "").encode()
    chars = [chr(b) for b in raw]
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size, m = max(1, len(words)), max(1, len(raw)), max(1, len(lines))
    upper, digits = sum("A" <= c <= "Z" for c in chars), sum("0" <= c <= "9" for c in chars)
    letters = sum("a" <= c <= "z" or ord(c) > 127 for c in chars) + upper
    of = lambda kinds: sum(c in kinds for c in chars) / size
    pairs = list(zip(words, words[1:]))
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) > 14 for w in words) / n, sum(len(w) <= 3 for w in words) / n, letters / size, digits / size, upper / max(1, letters),
        of(" \t\n\x0b\x0c\r"), of(".,;:!?'\"()-"), of("#$%&*+/<=>@[\\]^_`{|}~"), len(set(words)) / n, max([words.count(w) for w in set(words)], default=0) / n,
        1 - len(set(lines)) / m if lines else 0.0, np.log1p(n / m), sum(x.decode().rstrip()[-1] in ".!?:;\"'" for x in lines) / m, sum(65 <= w[0] <= 90 for w in words) / n,
        sum(chr(w[-1]) in "#$%&*+/<=>@[\\]^_`{|}~!" for w in words) / n, sum(a == b for a, b in pairs) / n, 1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
    ]


def plain_boost(x, y, w, rounds, pair_rounds, rate=0.1, n_pairs=8):
    """Cyclic boosting by loops over rows; returns the score of a row."""
    n, k = len(y), len(x[0])
    mean = min(max((sum(a * b for a, b in zip(w, y)) + 0.5) / (sum(w) + 1), 1e-3), 1 - 1e-3)
    base = np.log(mean / (1 - mean))
    cut = lambda j, bins: sorted(set(np.quantile([r[j] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist()))
    fine, coarse = [cut(j, 32) for j in range(k)], [cut(j, 8) for j in range(k)]
    place = lambda v, edges: sum(v >= e for e in edges)
    tables, total = [[0.0] * (len(e) + 1) for e in fine], [base] * n

    def slope(i):
        p = 1 / (1 + np.exp(-total[i]))
        return w[i] * (y[i] - p), w[i] * p * (1 - p)

    gain = lambda g, h: g * g / (h + 1)
    at = [[place(r[j], fine[j]) for j in range(k)] for r in x]
    for _ in range(rounds):
        for j in range(k):
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for i in range(n):
                a, b = slope(i)
                g[at[i][j]] += a
                h[at[i][j]] += b
            parts = [(0, len(g))]
            while len(parts) < 4:
                best = None
                for q, (a, b) in enumerate(parts):
                    for c in range(a + 1, b):
                        v = gain(sum(g[a:c]), sum(h[a:c])) + gain(sum(g[c:b]), sum(h[c:b])) - gain(sum(g[a:b]), sum(h[a:b]))
                        if v > 1e-9 and (best is None or v > best[0] + 1e-12):
                            best = (v, q, c)
                if best is None:
                    break
                a, b = parts.pop(best[1])
                parts += [(a, best[2]), (best[2], b)]
            for a, b in parts:
                for c in range(a, b):
                    tables[j][c] += rate * sum(g[a:b]) / (sum(h[a:b]) + 1)
            old = [0.0] * len(g)
            for a, b in parts:
                for c in range(a, b):
                    old[c] = rate * sum(g[a:b]) / (sum(h[a:b]) + 1)
            for i in range(n):
                total[i] += old[at[i][j]]
    assert pair_rounds == 0
    return lambda r: 1 / (1 + np.exp(-(base + sum(tables[j][place(r[j], fine[j])] for j in range(k)))))


def test_scores_match_a_plain_version(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghé.,A1$", k=rng.randrange(1, 18)))
    text = lambda: "\n".join(" ".join(word() for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 5)))
    rows = [(i, text()) for i in range(120)] + [(200, None), (201, "")]
    x = [plain_features(t) for _, t in rows]
    assert np.allclose(x, [quality.features(t) for _, t in rows])
    y, w = [float(rng.random() < 0.3 + 0.4 * (r[3] > 0.2)) for r in x], [float(rng.randrange(1, 4)) for _ in x]
    model = quality.Additive(np.array(x), np.array(y), np.array(w), rounds=3, pairs=0)
    plain = plain_boost(x, y, w, 3, 0)
    assert np.allclose(model.score(np.array(x)), [plain(r) for r in x], atol=1e-9)
    got = {r.id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(np.isclose(got[i], plain(r), atol=1e-9) for (i, _), r in zip(rows, x))


def test_an_id_with_a_third_of_both_tables(spark):
    """Repeated ids make no pairs, and the driver gets `sample` rows at most."""
    n = 3000
    rows = [(7 if i % 3 == 0 else (None if i % 3 == 1 and i < 900 else i), f"text {i} " + ("word. " * (i % 7) if i % 2 else "$$$ " * (i % 7))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7 if i % 3 == 0 else i, i % 2) for i in range(n)] + [(None, 1)] * 500, "doc_id long, quality int")
    seen = []

    class Watched(quality.Additive):
        def __init__(self, x, y, weight=None, **more):
            seen.append((x, y, weight))
            super().__init__(x, y, weight, rounds=2, pair_rounds=1)

    old, quality.Additive = quality.Additive, Watched
    try:
        quality.fit(docs, labels, sample=200)
        quality.fit(docs, labels, sample=200)
        quality.fit(docs, labels, sample=10**6)
    finally:
        quality.Additive = old
    assert len(seen[0][0]) <= 200 and all(np.array_equal(a, b) for a, b in zip(seen[0], seen[1]))
    learned = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    ids = {i for i, _ in rows if i is not None and i != 7 and i % 3} & {i for i in range(n) if i % 3}
    assert len(seen[2][0]) == sum(map(learned, ids)) + (1000 if learned(7) else 0)
    if learned(7):
        assert max(seen[2][2]) == 1001


def test_labels_of_one_id_are_one_example_and_copies_count_once(spark):
    p, q = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(p, "a b."), (p, "a b."), (p, "c"), (q, "d e")], "doc_id long, text string")
    labels = spark.createDataFrame([(p, 1), (p, 0), (p, 1), (q, 0), (q, None)], "doc_id long, quality int")
    seen = []
    old, quality.Additive = quality.Additive, lambda x, y, w: seen.append(sorted(zip(y.tolist(), w.tolist())))
    try:
        quality.fit(docs, labels)
    finally:
        quality.Additive = old
    assert [(round(a, 6), b) for a, b in seen[0]] == [(0.0, 1.0), (round(2 / 3, 6), 3.0), (round(2 / 3, 6), 3.0)]
