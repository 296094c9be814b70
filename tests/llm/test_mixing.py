"""Mixing: targets by water-filling, exact budgets, reruns, edge cases."""

import math

import pytest

from tablewright.llm import mixing


def fill(sizes, share=1.5, most=2):
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, x)))}
    target, left, open_ = {}, share * sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > most * sizes[s]]
        if not over:
            return target | {s: weights[s] * level for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("n_ranges,broadcast", [(1, 10**5), (7, 0), (4096, 10**5)])
def test_targets_and_budgets(spark, monkeypatch, n_ranges, broadcast):
    monkeypatch.setattr(mixing, "LEAST_ROWS", 3)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(i, "w " * (i * 7 % 23), ["a", "b", "c", "d", None][min(4, i % 9)]) for i in range(300)] + [(None, None, "a"), (5, "w " * 12, "d"), (5, "w " * 12, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.F.lit("clash"))
    got = mixing.mix(df, n_ranges=n_ranges).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = fill(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(want[s]) and mine[0].source_size == sizes[s]
        assert sum(r.taken for r in mine) == math.floor(mine[0].target + 1e-9)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, n_ranges=n_ranges).collect()))


def test_an_id_with_a_third_of_all_rows(spark, monkeypatch):
    """Null and repeated ids are spread over the order and stand in it as one; each budget is still cut at the word."""
    monkeypatch.setattr(mixing, "COPIES", 16)
    rows = [((7, None, i)[i % 3], "w " * (3 if i % 4 else i % 50), "ab"[i % 5 == 0]) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), n_ranges=20).collect()
    assert sorted((str(r.id), r.size, r.source) for r in got) == sorted((str(i), len(t.split()), s) for i, t, s in rows)
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == math.floor(mine[0].target + 1e-9) and all(0 <= r.taken <= 2 * r.size for r in mine)
        assert sum(0 < r.taken % r.size for r in mine if r.size) <= 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    df = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(df).collect()] == [0, 0]
