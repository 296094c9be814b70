"""Exact dedup against a dictionary, with bits for all keys and with far too few."""

import hashlib

import pytest

from tablewright.llm.exact_dedup import exact_groups


@pytest.mark.parametrize("most_bits", [2, 1 << 28])
def test_groups(spark, most_bits):
    long = "x" * 5000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long + "1"), (6, long + "2"), (7, long + "1"), (None, "a"), (8, "b"), (8, "b"), (None, "null only")]
    rows += [(100 + i, "hot") for i in range(60)] + [(None, "of none") for _ in range(60)] + [(9, f"own {i}") for i in range(60)] + [(10, long * 60 + "x"), (11, long * 60 + "y")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, kept string")
    got = exact_groups(df, most_bits=most_bits, digests=True).collect()
    assert len(got) == len(rows)
    by_hash = {}
    for i, t in rows:
        by_hash.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    for r in got:
        ids = by_hash[r.full_hash]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.id == keep)


def test_only_survivors_are_hashed_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "long one")], "doc_id long, text string")
    assert {r.id: r.full_hash is None for r in exact_groups(df).collect()} == {1: False, 2: False, 3: True}
    assert exact_groups(df.limit(0)).count() == 0
