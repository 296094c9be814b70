"""Fixity audit: WARC files read back, corruption located, edge cases."""

import gzip
import random

import pytest

from tablewright.llm import fixity


def record(i, body):
    body = body.encode()
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Target-URI: u%d\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (i, i, len(body), body)


def frame(spark, rows):
    """rows (file, record, length, digest), in order -> with offsets."""
    at, out = {}, []
    for f, r, n, d in rows:
        out.append((str(f), r, at.get(f, 0), n, d))
        at[f] = at.get(f, 0) + n
    return spark.createDataFrame(out, "file string, record string, offset long, length long, digest string")


@pytest.mark.parametrize("seed", range(3))
def test_audit_locates_every_difference(spark, seed):
    """Lost, longer and new records move those behind them, which are not reported."""
    rng = random.Random(seed)
    rows = [(f, f"r{f}-{k}", 50 + k, f"{f}-{k}") for f in range(9) for k in range(40)] + [("x", "alone", 5, "x")]
    bad = rng.sample(range(360), 12)
    other, want, at = [], set(), {}
    for i, r in enumerate(rows):
        offset = at.get(r[0], 0)
        at[r[0]] = offset + r[2]
        if i in bad[:6]:
            other.append((r[0], r[1], r[2] + rng.randrange(3), "rot"))
            want.add((str(r[0]), offset, "changed"))
        elif i in bad[6:10]:
            want.add((str(r[0]), offset, "missing"))
        else:
            other.append(r)
            if i == bad[10]:
                other.append((r[0], "new", 7, "new"))
                want.add((str(r[0]), sum(o[2] for o in other[:-1] if o[0] == r[0]), "added"))
    got = {(r.file, r.offset, r.status) for r in fixity.audit(frame(spark, rows), frame(spark, other), fanout=4).collect()}
    assert got == want and len(want) == 11


def test_only_branches_that_differ_are_opened(spark):
    """A node's digest depends on the records below it alone: one change leaves all but one path equal."""
    rows = [(f, f"r{f}-{k}", 50, f"{f}-{k}") for f in range(20) for k in range(100)]
    lost = [r for i, r in enumerate(rows) if i != 777]
    a, b = (fixity.tree(frame(spark, x), (3, 2), 8) for x in (rows, lost))
    for x, y in zip(a[1:], b[1:]):
        new = y.select("file", "key", "digest").exceptAll(x.select("file", "key", "digest")).count()
        assert new <= 2


def test_equal_empty_and_unequal_heights(spark):
    rows = frame(spark, [(f, f"r{k}", 10, f"{f}{k}") for f in range(3) for k in range(5)])
    assert fixity.audit(rows, rows, fanout=2).count() == 0
    assert fixity.audit(rows.limit(0), rows.limit(0)).count() == 0
    got = fixity.audit(rows, rows.filter("file = '0' AND offset = 0"), fanout=2).collect()
    assert len(got) == 14 and {r.status for r in got} == {"missing"}
    assert {r.status for r in fixity.audit(rows.limit(0), rows).collect()} == {"added"}


def test_files_and_table_agree(spark, tmp_path):
    pages = [(i, f"u{i}", "é" * i + "x") for i in range(30)]
    raw = b"".join(record(i, h) for i, _, h in pages)
    for d in "abc":
        (tmp_path / d).mkdir()
    (tmp_path / "a" / "one.warc").write_bytes(raw)
    rotten = raw.replace("é".encode() * 7 + b"x", "é".encode() * 7 + b"y", 1)
    (tmp_path / "b" / "one.warc").write_bytes(gzip.compress(rotten))
    (tmp_path / "c" / "one.warc").write_bytes(b"".join(gzip.compress(record(i, h)) for i, _, h in pages if i != 4))
    a, b, c = (fixity.read_warc(spark, str(tmp_path / d)) for d in "abc")
    table = fixity.serialised(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted((r.record, r.offset, r.length, r.digest) for r in a.collect()) == sorted((r.record, r.offset, r.length, r.digest) for r in table.collect())
    assert [r.status for r in fixity.audit(a, b).collect()] == ["changed"]
    assert [(r.key, r.status) for r in fixity.audit(a, c).collect()] == [("1 <urn:page:4>", "missing")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, "x"), (1, None, "x"), (2, "u", "y" * 300000), (None, "v", "")], "page_id long, url string, html string").withColumn("file", fixity.F.lit("clash"))
    got = fixity.serialised(df).collect()
    assert len({(r.file, r.offset) for r in got}) == 5 and sorted(r.file for r in got) == ["-1", "-1", "0", "0", "0"]


def test_ids_with_a_third_of_all_rows(spark):
    """Null and repeated ids, equal records too: no file is longer than twice PAGES, and no byte is in two records."""
    rows = [((None, 4, 1000 + i)[i % 3], "u", f"body {i % 90}" if i % 2 else "same") for i in range(900)]
    got = fixity.serialised(spark.createDataFrame(rows, "page_id long, url string, html string"), pages_per_file=20).collect()
    assert len(got) == 900
    files = {}
    for r in got:
        files.setdefault(r.file, []).append((r.offset, r.offset + r.length))
    for spans in files.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and len(spans) <= 80


def test_torn_file():
    data = record(1, "a") + b"garbage" + record(2, "b")[:-3]
    assert b"".join(x for _, x in fixity.parse_warc(data)) == data
    packed = gzip.compress(record(1, "a")) + gzip.compress(record(2, "b" * 10**6))
    assert [x for _, x in fixity.parse_warc(packed)] == [record(1, "a"), record(2, "b" * 10**6)]
    assert b"".join(x for _, x in fixity.parse_warc(packed[:-30])).startswith(record(1, "a"))
