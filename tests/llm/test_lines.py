"""Line dedup: templates generalise variable fields, the first document keeps them, against a plain version."""

import random

import pytest

from tablewright.llm import lines


def brute(rows):
    """rows (id, text): a dictionary of leaves, grouped line by line."""
    info, leaves = {}, {}
    for i, text in rows:
        if i is None:
            continue
        for raw in (text or "").encode().split(b"\n"):
            p = lines.parse(raw)
            if p:
                leaves.setdefault(p[0], {})[p[1]] = lines.token_hashes(p[2])
                info.setdefault(p[1], set()).add(i)
    first = {}
    for members in leaves.values():
        keys = list(members)
        signed = [k - (1 << 64) if k >> 63 else k for k in keys]
        began = []
        for k, x in sorted(zip(keys, signed), key=lambda p: p[1]):
            mine = lines.np.frombuffer(members[k], dtype=lines.np.uint16).tolist()
            for own, head in began:
                if 10 * sum(a == b for a, b in zip(mine, head)) >= 7 * len(mine):
                    own.append(k)
                    break
            else:
                began.append(([k], mine))
        for mine, _ in began:
            ids = set().union(*(info[k] for k in mine))
            if len(ids) > 1:
                first.update({k: min(ids) for k in mine})
    out = {}
    for i, text in rows:
        kept = []
        for raw in (text or "").split("\n"):
            p = lines.parse(raw.encode())
            if i is None or not p or first.get(p[1], i) == i:
                kept.append(raw)
        out[i] = None if text is None else "\n".join(kept)
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(3, 25)))
    notice = "Copyright notice all rights are reserved by the owner of this page"
    rows = []
    for i in range(120):
        body = [prose() for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            body.insert(rng.randrange(len(body)), notice)
        if i % 4 == 0:
            body.append(f"Posted on 2024-01-{i:02d} by {word()} in the general section of the forum today")
        if i % 5 == 0:
            body.append("Of the")
        rows.append((i, "\n".join(body)))
    return rows + [(200, rows[7][1]), (None, notice), (201, None), (202, ""), (203, "1 2 3 4 5 6 7"), (204, "1 2 3 4 5 6 8"), (205, "word " * 30000), (0, rows[0][1])]


@pytest.mark.parametrize("broadcasts", [0, 10**6])
def test_matches_the_plain_version(spark, broadcasts):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    got = lines.drop_lines(df, broadcast_leaves=broadcasts).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.id], r.id
    by_id = {r.id: r for r in got}
    assert "Copyright" in by_id[0].text and "Copyright" not in by_id[3].text and "Posted" not in by_id[4].text
    assert "Copyright" in by_id[None].text and by_id[204].text == "1 2 3 4 5 6 8" and by_id[5].text.endswith("Of the")
    assert not any(lines.parse(x.encode()) for x in by_id[200].text.split("\n"))


def hot_leaf(rng, n):
    """Lines of one leaf: few templates that recur, and many lines that are like no other."""
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    bodies = [[word() for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(n):
        body = list(bodies[i % 4]) if i % 3 else [word() for _ in range(12)]
        for at in rng.sample(range(12), 2 if i % 5 else 4):
            body[at] = word()
        rows.append((i, "one leaf has all " + " ".join(body) + "\n" + " ".join(word() for _ in range(8))))
    return rows


@pytest.mark.parametrize("limit", [7, 10**6])
def test_a_leaf_gives_the_same_templates_at_every_limit(spark, limit):
    rows = hot_leaf(random.Random(11), 400)
    raw = [x.encode() for _, t in rows for x in t.split("\n")]
    parsed = {p[1]: p for p in map(lines.parse, raw) if p}
    members = spark.createDataFrame([(lines._signed([p[0]])[0].item(), lines._signed([p[1]])[0].item(), lines.token_hashes(p[2])) for p in parsed.values()], "leaf long, line long, tokens binary")
    got = {r.line: r.template for r in lines.templates(members, most_lines=limit, least_lines=1).collect()}
    want, leaves = {}, {}
    for r in members.collect():
        leaves.setdefault(r.leaf, []).append((r.line, bytes(r.tokens)))
    for own in leaves.values():
        of = lines.group_leaf(lines.np.array([x for x, _ in own]), [t for _, t in own])
        want.update({x: int(t) for (x, _), t in zip(own, of)})
    assert got == want and 100 < len(set(got.values())) < 700


@pytest.mark.parametrize("limit", [3, 4096])
def test_hot_leaf_matches_the_plain_version(spark, monkeypatch, limit):
    monkeypatch.setattr(lines.templates, "__defaults__", (lines.SIMILAR, 1.0, limit, 1))
    rows = hot_leaf(random.Random(12), 120)
    got = {r.id: r.text for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_ids_with_a_third_of_all_rows(spark):
    """One id, and none, with many rows each, equal ones too."""
    rng = random.Random(13)
    notice = "this notice is the same on all of the pages here"
    rows = [((5, None, i)[i % 3], f"{notice}\nalone {i} " + " ".join(rng.choices("abc", k=2)) if i % 2 else notice + "\nagain") for i in range(300)]
    got = lines.drop_lines(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, same string")).collect()
    want = brute(rows)
    assert sorted((str(r.id), r.text) for r in got) == sorted((str(i), "\n".join(x for x in t.split("\n") if i is None or i == 2 or x != notice)) for i, t in rows)
    assert want[2] == rows[2][1] and sum(r.n_dropped for r in got if r.id == 5) == 101


def test_a_hot_template_is_one_template(spark):
    """Lines of one leaf with the same prefix, in several parts: all are one template, and one document keeps it."""
    rng = random.Random(8)
    head = "in the beginning of every copy of this text there are many words that never change at all and then"
    rows = [(i, head + " " + " ".join(rng.choices("abcdefgh", k=3))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.drop_lines(df).collect()
    assert sum(r.n_dropped for r in got) == 399


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.drop_lines(df).count() == 0


@pytest.mark.parametrize("n", [10, 64, 5000])
def test_a_template_of_any_number_of_fillings_is_one(spark, n):
    """A short line with one word field: the size of its leaf does not matter."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(i, f"user session was opened by {name(i)} on the main login server this morning\n{name(i)} stays") for i in range(n)]
    got = {r.id: r for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(r.n_dropped for r in got.values()) == n - 1 and got[0].n_dropped == 0
    assert all(got[i].text == f"{name(i)} stays" for i in range(1, n))
