"""The pipeline's stages against plain versions of their rules, each on its own input."""

import random

import pytest

import corpus_pipeline as cp
from tablewright.llm import common, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n)]


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def near_copies(seed):
    rng = random.Random(seed)
    rows, pairs = [], []
    for i in range(60):
        w = words(rng, rng.randrange(60, 400))
        rows.append((i, " ".join(w)))
        v = list(w)
        for at in rng.sample(range(len(v)), max(1, len(v) // 100)):
            v[at] = words(rng, 1)[0]
        rows.append((1000 + i, " ".join(v)))
        pairs.append((i, 1000 + i))
    rows += [(2000 + i, rows[2 * i][1].upper()) for i in range(10)]
    rows += [(3000 + i, " ".join(words(rng, 100))) for i in range(60)] + [(3100, "tiny"), (3101, None), (3102, ""), (3103, " ")]
    return rows, pairs


def test_near_stage(spark):
    rows, pairs = near_copies(2)
    text = dict(rows)
    kept = {r.doc_id for r in cp.near_stage(spark, frame(spark, rows), "").collect()}
    similar = [(a, b) for a, b in pairs if jaccard(text[a], text[b]) >= 0.8]
    assert len(similar) > 40
    assert sum(b not in kept for _, b in similar) >= 0.9 * len(similar)
    # Nothing goes but what is similar to what stays; the first of each group and all others stay.
    assert all(i in kept for i in range(60)) and all(3000 + i in kept for i in range(60)) and {3100, 3101} <= kept
    assert all(b in kept for a, b in pairs if jaccard(text[a], text[b]) < 0.8)
    assert not kept & {2000 + i for i in range(10)} and not kept & {3102, 3103}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_near_duplicates_on_both_paths(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(common, "BROADCAST_KEYS", limit)
    rows = [(i, "the same words in every one of these rows " + "again " * 20) for i in range(40)] + [(100, "another text with other words")]
    kept = sorted(r.doc_id for r in cp.near_stage(spark, frame(spark, rows), "").collect())
    assert kept == [0, 100]
    assert cp.near_stage(spark, frame(spark, rows).limit(0), "").count() == 0


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(6)
    prose = lambda n: " ".join(words(rng, n)).capitalize() + "."
    phrase = " ".join(words(rng, 25))
    notice = " ".join(words(rng, 55))
    rows = [(i, "\n".join(prose(20) for _ in range(4))) for i in range(200)]
    rows += [(300 + i, " ".join(w.upper() + "$$$" for w in words(rng, 80))) for i in range(60)]
    rows += [(400 + i, prose(30) + "\n" + notice) for i in range(5)] + [(500, prose(20) + " " + phrase + " " + prose(20)), (501, phrase), (502, rows[3][1]), (503, None), (504, "")]
    labels = [(i, int(i < 300)) for i in range(0, 260)] + [(300 + i, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    good = cp.quality_stage(spark, docs, str(tmp_path))
    assert good.columns == cp.COLUMNS
    ids = {r.doc_id for r in good.collect()}
    assert {i for i in range(200)} <= ids and not ids & {300 + i for i in range(60)}
    lined = {r.doc_id: r for r in cp.line_stage(spark, docs, "").collect()}
    assert notice in lined[400].text and all(notice not in lined[400 + i].text for i in range(1, 5)) and 502 not in lined
    assert all(lined[i].text == t for i, t in rows[:200]) and lined[401].n_chars == len(lined[401].text) and lined[503].text is None
    clean = {r.doc_id: r for r in cp.benchmark_stage(spark, docs, str(tmp_path)).collect()}
    assert 501 not in clean and phrase not in clean[500].text and all(clean[i].text == t for i, t in rows[:200])
    mixed = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} >= {i for i in range(200)} and abs(sum(r.taken for r in mixed) - mixed[0].target) < 1


def edited(rng, kind):
    """A text of 150 to 600 words and a copy that is similar in five-word shingles, appended, cut or scattered."""
    w = words(rng, rng.randrange(150, 600))
    n = len(w)
    if kind == "appended":
        return w, w + words(rng, int(n * rng.choice([0.1, 0.15, 0.2, 0.24])))
    if kind == "cut":
        return w, w[: int(n * rng.choice([0.9, 0.85, 0.82]))]
    v = list(w)
    for at in rng.sample(range(n), max(1, n // 60)):
        v[at] = words(rng, 1)[0]
    return w, v


def in_order(rows, t=0.8):
    """Ids that stay, by all pairs."""
    stay = []
    for i, text in sorted(rows):
        if all(jaccard(text, s) < t for _, s in stay):
            stay.append((i, text))
    return {i for i, _ in stay}


def assert_groups(rows, kept, t=0.8):
    """No two that stay are similar; what goes is similar to some text; the first of each group stays."""
    text = dict(rows)
    ids = sorted(text)
    near = {i: {j for j in ids if i != j and jaccard(text[i], text[j]) >= t} for i in ids}
    assert not any(near[i] & kept for i in kept)
    seen = set()
    for i in ids:
        group, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        if i not in seen:
            assert i in kept
        seen |= group


@pytest.mark.parametrize("kind", ["appended", "cut", "scattered"])
def test_every_similar_pair_is_found(spark, kind):
    rng = random.Random(kind)
    rows = []
    for i in range(40):
        a, b = edited(rng, kind)
        rows += [(i, " ".join(a)), (1000 + i, " ".join(b))]
    want = in_order(rows)
    assert len(want) < 60
    assert {r.doc_id for r in cp.near_stage(spark, frame(spark, rows), "").collect()} == want


def test_parities_bound_the_difference():
    rng = random.Random(3)
    numpy = simhash.np
    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.choice([0, 1, 5, 40, 500, 3000]))}
        b = set(rng.sample(sorted(a), int(len(a) * rng.random()))) | {rng.getrandbits(64) for _ in range(rng.randrange(0, len(a) + 5))}
        x, y = (numpy.array(sorted(s), dtype=numpy.uint64) for s in (a, b))
        low = simhash.least_difference(simhash.parities(x), simhash.parities(y))
        assert low <= len(a ^ b) and (len(a ^ b) < 20 or 4 * low > min(len(a ^ b), len(b)))
    assert simhash.least_difference(simhash.parities(x), simhash.parities(x)) == 0


def test_a_large_group_of_near_copies_goes_by_rounds(spark):
    rng = random.Random(4)
    base, rows = words(rng, 200), []
    for i in range(150):
        v = list(base)
        v[rng.randrange(200)] = words(rng, 1)[0]
        rows.append((i, " ".join(v if i % 3 else v + words(rng, 25))))
    rows += [(200 + i, " ".join(words(rng, 60) + base[:20])) for i in range(50)]
    kept = {r.doc_id for r in cp.near_stage(spark, frame(spark, rows), "").collect()}
    assert_groups(rows, kept)
    assert kept >= {200 + i for i in range(50)} and len(kept) < 120


def test_a_chain_keeps_one_of_each_similar_pair(spark):
    """B and C are similar to each other and not to A, though links join all three."""
    rng = random.Random(9)
    rows = []
    for i in range(20):
        a = [f"w{rng.randrange(40)}" for _ in range(400)]
        b = list(a)
        for at in range(0, 400, 18):
            b[at : at + 2] = b[at : at + 2][::-1]
        c = list(b)
        c[200] = f"w{rng.randrange(40)}"
        rows += [(3 * i, " ".join(a)), (3 * i + 1, " ".join(b)), (3 * i + 2, " ".join(c))]
    text = dict(rows)
    assert all(jaccard(text[3 * i + 1], text[3 * i + 2]) > 0.9 > 0.75 > jaccard(text[3 * i], text[3 * i + 1]) for i in range(20))
    kept = {r.doc_id for r in cp.near_stage(spark, frame(spark, rows), "").collect()}
    assert_groups(rows, kept)
    assert kept == {i for i in range(60) if i % 3 < 2}


def test_short_lines_and_scripts_without_spaces_stay(spark):
    notice = "this notice is the same on all of the pages here"
    rows = [(0, "first page\n" + notice), (1, notice + "\nroses are red\nviolets are blue"), (2, "\u6211\u4eec\u4eca\u5929\u53bb\u5317\u4eac\u770b\u957f\u57ce\n" + notice), (3, notice), (4, notice + "\n \n")]
    got = {r.doc_id: r.text for r in cp.line_stage(spark, frame(spark, rows), "").collect()}
    assert got == {0: rows[0][1], 1: "roses are red\nviolets are blue", 2: "\u6211\u4eec\u4eca\u5929\u53bb\u5317\u4eac\u770b\u957f\u57ce"}
