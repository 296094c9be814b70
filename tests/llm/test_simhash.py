"""SimHash against brute force: fingerprints, links and components."""

import random

import numpy as np
import pytest
import xxhash

from tablewright.llm import simhash


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, t=3):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= t:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "a", "One two", "one two three", "Ä ä Öne\x0btwo\x0cthree four five", "a b c " * 300])
def test_fingerprint_follows_the_definition(text):
    assert simhash.fingerprint(text) == brute_fp(text)


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3000))
    whole = brute_fp(text)
    monkeypatch.setattr(simhash.word_pieces, "__defaults__", (50,))
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("threshold", [1, 3, 5, 7])
def test_every_close_pair_meets_at_a_home(threshold):
    rng = random.Random(threshold)
    for code in simhash.covers(threshold):
        x = np.array([rng.getrandbits(64) for _ in range(300)], dtype=np.uint64)
        row, anchor, home = code.anchors(x)
        assert len(set(zip(row.tolist(), anchor.tolist()))) == len(row)
        assert sorted(row[home].tolist()) == list(range(300))
        homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
        mask = (1 << code.width) - 1
        for i, a in homes.items():
            assert bin((int(x[i]) >> code.lo & mask) ^ (a & mask)).count("1") <= 1
        flipped = x ^ np.array([1 << (code.lo + rng.randrange(code.width)) for _ in x], dtype=np.uint64)
        row2, anchor2, _ = code.anchors(flipped)
        reach = set(zip(row2.tolist(), anchor2.tolist()))
        assert all((i, a) in reach for i, a in homes.items())


@pytest.mark.parametrize("hot_share", [1 / 1000, 1 / 100000])
def test_links_and_components_match_brute_force(spark, monkeypatch, hot_share):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
            x ^= 1 << b
        fps.append(x)
    ball = rng.getrandbits(64)
    fps += [ball ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = sorted(set(signed))
    df = spark.createDataFrame([(x,) for x in distinct], "fp long")
    from tablewright.llm.graph import components

    got = {r.node: r.root for r in components(simhash.links(df, 3, hot_share)).collect()}
    want = brute_components([x & (1 << 64) - 1 for x in distinct], distinct)
    assert [got.get(x, x) for x in distinct] == want


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "  ", "z"), (4, "one two three four", "q"), (5, "one two three four", "q"), (None, "one two three four", "q"), (7, "solo", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.id, r.component_id) for r in simhash.near_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (7, 7)], key=str)
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_dense_cells_stay_fast():
    """A cell of thousands of rows that are nearly all linked: the links make one tree."""
    import time

    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = list({base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(24) for b in range(a) for c in range(b)})
    n = len(fps)
    began = time.time()
    a, b = simhash._links(np.zeros(n, dtype=np.int64), np.array(fps, dtype=np.uint64), np.ones(n, dtype=bool), np.full(n, -1), 3)
    assert len(a) == n - 1 and time.time() - began < 20


def test_few_tables_are_written(spark, monkeypatch):
    """Each file costs processes where the shared folder is local: a round of components writes two tables, and values are joined
    to pairs without any."""
    from tablewright.llm import graph
    from tablewright.sources import tables

    wrote, real = [], tables.staged
    monkeypatch.setattr(tables, "staged", lambda df: wrote.append(df.columns) or real(df))
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)] + [(20, 21)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {k: 0 for k in range(7)} | {20: 20, 21: 20}
    assert len(wrote) % 2 == 1 and not [c for c in wrote if c != ["u", "v"]]
    wrote.clear()
    pairs = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (2, 2, 3), (4, 4, 4)], "a long, a_rep long, b long")
    of = spark.createDataFrame([(k, 10 * k) for k in range(1, 5)], "same long, size long")
    rows = simhash._with_both(pairs, of).select("a", "b", "size_a", "size_b").collect()
    assert sorted(map(tuple, rows)) == [(1, 2, 10, 20), (1, 3, 10, 30), (2, 3, 20, 30), (4, 4, 40, 40)] and not wrote
