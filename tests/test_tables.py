"""Histograms, metrics, privacy, faithfulness, post-processing, acceptance."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import flows, acceptance, bayesnet, faithfulness, filters, mechanisms, metrics, models, postprocess, privacy, profile, ranges
from tablewright.plans import birth, evaluate, registry


def private_table(spark):
    b = [x for x in "ijk" for _ in range(3)] + ["n"]
    return spark.createDataFrame([(k % 2 == 1, b[k], [1, 2, 1, 2, 3, 1, 1, 3, 4, 5][k]) for k in range(10)], "a boolean, b string, c long")


def values(df):
    return {r.param: r.value for r in df.collect()}


def test_disclosure(spark):
    df = private_table(spark)
    assert values(privacy.k_anonymity(df, ["a", "b"], 3)) == {1: 4, 2: 3, 3: 0}
    assert values(privacy.k_anonymity(df, ["a", "c"], 3)) == {1: 5, 2: 1, 3: 1}
    assert values(privacy.uniques(df, 3)) == {1: 8, 2: 1, 3: 0}
    assert values(privacy.l_diversity(df, ["a", "b"], "c", 3)) == {1: 5, 2: 2, 3: 0}
    assert values(privacy.l_diversity(df, ["a", "c"], "b", 3)) == {1: 5, 2: 2, 3: 0}
    counts = spark.createDataFrame([(x,) for x in [0, *[1] * 1, 3, 3, 6]], "n long")
    assert values(profile.frequency_of_frequencies(counts, 3)) == {1: 1, 2: 0, 3: 2}
    face = privacy.face_table(df, 3, [(("a", "b"), "c"), (("a", "c"), "b")])
    assert face.count() == 24 and {r.quasi for r in face.collect()} == {None, "a;b", "a;c"}


def test_cells_and_completion(spark):
    x = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    y = spark.createDataFrame([("a",)] * 3 + [("c",)] * 4 + [(None,)], "k string")
    got = {r.k: (r.nx, r.ny) for r in profile.paired_histogram(x, y).collect()}
    assert got == {"a": (1, 3), "b": (2, 0), "c": (0, 4), None: (1, 1)}
    assert profile.min_marginal(y.filter("k IS NOT NULL")) == 3


@pytest.mark.parametrize("rows", [None, 7])
def test_ordered_sums(spark, rows):
    rng = random.Random(6)
    data = [(k, float(v), rng.randrange(5)) for k in "ab" for v in rng.sample(range(1000), 40)] + [(None, 1.0, 2)]
    df = spark.createDataFrame(data, "k string, v double, n int")
    for keys in ([], ["k"]):
        source = df if keys else df.filter("k = 'a'")
        got = {(r.k, r.v): (r.upto_n, r.next) for r in profile.ordered(source, "v", ["n"], keys, rows).collect()}
        for key in {"a"} if not keys else {"a", "b", None}:
            mine = sorted((v, n) for k, v, n in data if k == key)
            for i, (v, _) in enumerate(mine):
                assert got[key, v] == (sum(n for _, n in mine[: i + 1]), mine[i + 1][0] if i + 1 < len(mine) else None)


def test_mitigations_and_samples(spark):
    df = private_table(spark)
    assert privacy.sample(df, 4, 1).count() == 4 and privacy.sample(df, 25, 1, True).count() == 25 and privacy.sample(df, 0).count() == 0
    ids = spark.range(5000)
    for n in (1, 2500, 4999, 5000, 6000):
        got = [r.id for r in privacy.sample(ids, n, 3).collect()]
        assert len(set(got)) == len(got) == min(n, 5000)
        assert filters.any_n(ids, n).distinct().count() == min(n, 5000)
    drawn = {tuple(r) for r in privacy.sample(df, 400, 2, True).collect()}
    assert drawn == {tuple(r) for r in df.collect()}
    assert privacy.resample_uniques(df).groupBy("a", "b", "c").count().filter("count = 1").count() == 0
    assert privacy.double_uniques(df).count() == 10
    assert privacy.baseline(df, 50, "uniform").count() == 50


def corr_tables(spark):
    a, b = [0] * 5 + [1] * 5, [0] * 4 + [1] * 6
    rows = [(float(x), float(y), float(x - y + 1)) for x, y in zip(a, b)], [(float(x), float(y), float(x)) for x, y in zip(a, b)]
    return tuple(spark.createDataFrame(r, "A double, B double, C double") for r in rows)


def test_correlations(spark):
    got = metrics.correlation_metrics(*corr_tables(spark))
    assert got["pearson/diff/A/B"] == pytest.approx(0) and got["pearson/diff/A/C"] == pytest.approx(1 - 1 / 3)
    assert got["pearson/diff/B/C"] == pytest.approx(0.8164965809277258 + 0.2721655269759086)
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert set(metrics.correlations(constant, "pearson").values()) == {None} and set(metrics.correlations(constant, "kendall").values()) == {None}


@pytest.mark.parametrize("grid", [2_000_000, 40])
def test_kendall_against_pairs(spark, monkeypatch, grid):
    monkeypatch.setattr(metrics, "GRID", grid)
    rng = random.Random(3)
    rows = [(float(rng.randrange(30)), float(rng.randrange(12)), rng.gauss(0, 1)) for _ in range(150)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    sign = lambda v: (v > 0) - (v < 0)
    for (i, j), got in zip([(0, 1), (0, 2), (1, 2)], metrics.correlations(df, "kendall").values()):
        p = list(itertools.combinations(rows, 2))
        net = sum(sign(x[i] - y[i]) * sign(x[j] - y[j]) for x, y in p)
        ti, tj = (sum(x[k] != y[k] for x, y in p) for k in (i, j))
        assert got == pytest.approx(net / math.sqrt(ti * tj))


def test_regression(spark):
    rng = np.random.default_rng(1987)
    a, b = rng.standard_normal((2, 20000))
    rows = lambda c: spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c)], "A double, B double, C double")
    got = metrics.linear_regression(rows(3 * a + b + 1), rows(a + 2 * b + 1), scale=False)
    assert got["coef/error/diff/A"] == pytest.approx(2) and got["coef/error/diff/B"] == pytest.approx(1) and got["coef/error/diff/C"] == pytest.approx(0, abs=1e-9)
    assert got["coef/error/diff/max"] == pytest.approx(2) and got["coef/error/diff/total"] == pytest.approx(3)
    assert got["R2/diff"] == pytest.approx(0, abs=1e-9) and got["MAE/cross/1-by-2"] == pytest.approx(np.abs(2 * a - b).mean()) == pytest.approx(got["MAE/cross/2-by-1"])


def test_resized_means(spark):
    x = spark.createDataFrame(list(zip([0.0] * 4 + [1.0] * 6, map(float, [1, 2, 2, 3, 3, 4, 4, 5, 5, 5]))), "g double, t double")
    y = spark.createDataFrame(list(zip([0.0] * 6 + [1.0] * 4, map(float, [5, 6, 7, 7, 7, 8, 8, 8, 9, 9]))), "g double, t double")
    got = metrics.mean_resized(x, y, "t", "g", [0, 1, 2], 6.0)
    assert got["min/size_by_second"] == 2 and 3 < got["max/diff"] <= 5.5
    pad = metrics.resized(x, y, "t", "g", [0, 1, 2], 6.0, margin_share=-0.3).filter("g = 0").first()
    assert pad.size == 8 and pad.mean_x == pytest.approx((8 + 4 * 6) / 8)


def test_identity_and_row_count(spark):
    df = spark.createDataFrame([(float(k % 2), float(k + 1), float(31 * k + 5)) for k in range(10)], "binary double, nominal double, date double")
    domain = evaluate.Domain({"binary": [0, 1, 2], "nominal": [0, 5, float("inf")], "date": list(range(0, 397, 31))}, {})
    out = evaluate.compare({"a": df, "b": df}, {"v": ("a", "b")}, domain).collect()
    for r in out:
        want = 1 if "ratio" in r.name or r.name in ("cdf", "chi2", "std") else 0
        assert r.metric == "pMSE" or r.v == pytest.approx(want, abs=1e-9), r
    # One-way, frequencies of all subsets, their roll-ups, regression, correlations, classifier.
    assert len(out) == 3 * 11 + 7 * 2 * 8 + 4 * 2 * 8 + 9 + 12 + 2
    assert {r.name for r in out} >= {"1way/max/frequencies/ratio/raw", "123way/rmse/frequencies/diff/bins", "lr/MAE/cross/1-by-2", "corr/kendall/diff/max", "pMSE/score"}


X = [(1, 1, 2), (3, 1, 2), (1, 0, 1), (20, 1, 6)]
Y = [(1, 1, 2), (3, 1, 3), (4, 1, 6), (1, 0, 1)]
WEIGHTS = {"a": 0.1, "b": 10, "c": [1, 2, 3, 4, 10]}


def test_faithfulness_fixture(spark):
    x, y = (spark.createDataFrame([(float(a), float(b), float(c), k) for k, (a, b, c) in enumerate(t)], "a double, b double, c double, id long") for t in (X, Y))
    from tablewright.functions.binning import scale_by_weights

    scaled = [scale_by_weights(t.select("a", "b", "c", "id"), WEIGHTS).withColumn("id", F.col("id").cast("long")) for t in (x, y)]
    edges = faithfulness.radius_edges(*scaled, ["a", "b", "c"], 1.0)
    near = {r.y_id: r.x_ids for r in faithfulness.neighbours(edges).collect()}
    # The distance of x1 and y1 is exactly one.
    assert near == {0: [0, 1], 1: [1], 3: [2]} or near == {0: [0, 1], 1: [0, 1], 3: [2]}
    tables = [t.select("a", "b", "c") for t in (x, y)]
    r = faithfulness.evaluate(*tables, WEIGHTS, [1.0])[0]
    assert r["beta"] == pytest.approx(0.25) and r["unmatched_x"].count() == 1 and r["unmatched_y"].count() == 1
    assert faithfulness.evaluate(tables[0], tables[0], WEIGHTS, [1.0])[0]["beta"] == 0
    with pytest.raises(AssertionError):
        faithfulness.evaluate(tables[0], tables[1].limit(3), WEIGHTS, [1.0])
    cheap = faithfulness.minimum_cost_assignment(*tables, ["a", "b", "c"], WEIGHTS)
    assert sorted(j for _, j, _ in cheap) == [0, 1, 2, 3]


@pytest.mark.parametrize("seed", range(25))
def test_matching_is_maximum(seed):
    rng = random.Random(seed)
    n, m = rng.randrange(1, 9), rng.randrange(1, 9)
    edges = [(i, j) for i in range(n) for j in range(m) if rng.random() < 0.35]
    supply, demand = {i: rng.randrange(1, 4) for i in range(n)}, {j: rng.randrange(1, 4) for j in range(m)}
    sizes = set()
    for name in flows.SOLVERS:
        got = faithfulness.match_counts(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), supply, demand, algorithm=name)
        assert all(sum(k for (a, _), k in got.items() if a == i) <= supply[i] for i in range(n))
        assert all(sum(k for (_, b), k in got.items() if b == j) <= demand[j] for j in range(m)) and set(got) <= set(edges)
        sizes.add(sum(got.values()))
    # Plain augmenting paths over single rows.
    left, right = [i for i in range(n) for _ in range(supply[i])], [j for j in range(m) for _ in range(demand[j])]
    owner = {}

    def grow(a, seen):
        for b, j in enumerate(right):
            if (left[a], j) in edges and b not in seen:
                seen.add(b)
                if b not in owner or grow(owner[b], seen):
                    owner[b] = a
                    return True
        return False

    assert sizes == {sum(grow(a, set()) for a in range(len(left)))}


@pytest.mark.parametrize("kind", ["univariate", "uniform"])
def test_baseline_of_many_values(spark, kind):
    """Columns beyond the limit are drawn row by row; the shares are those asked for."""
    df = spark.createDataFrame([(k, k % 3, "hot" if k % 3 == 0 else f"v{k}") for k in range(900)], "a long, b int, c string")
    out = privacy.baseline(df, 6000, kind, 1, limit=10)
    rows = out.collect()
    assert out.columns == df.columns and len(rows) == 6000 and {r.b for r in rows} == {0, 1, 2}
    assert {r.a for r in rows} <= set(range(900)) and len({r.a for r in rows}) > 850
    hot = sum(r.c == "hot" for r in rows) / 6000
    assert abs(hot - (1 / 3 if kind == "univariate" else 1 / 601)) < 0.04
    # Independent: a row's value says nothing of the others.
    assert abs(sum(r.b == 0 for r in rows if r.c != "hot") / sum(r.c != "hot" for r in rows) - 1 / 3) < 0.05


def test_strategy(spark):
    """Thresholds and time limits of the published strategy. A candidate that is late gives way to the next."""
    assert faithfulness.auto_candidates(0.004, 49_999) == [("hopcroft_karp", 300), ("push_relabel", 3600)]
    assert faithfulness.auto_candidates(0.005, 10) == faithfulness.auto_candidates(0.001, 50_000) == [("push_relabel", 3600)]
    rng = random.Random(2)
    x, y = (spark.createDataFrame([(float(rng.randrange(3000)),) for _ in range(3000)], "a double") for _ in range(2))
    rows = {}
    for plan in ("auto", [("edmonds_karp", 60)], [("hopcroft_karp", -1.0), ("push_relabel", 60)], [("hopcroft_karp", -1.0)]):
        rows[str(plan)] = r = faithfulness.evaluate(x, y, {}, [30.0], candidates=plan)[0]
        assert r["pairs"].count() > 0 or r["beta"] != r["beta"]
    got = list(rows.values())
    assert [r["algorithm"] for r in got] == ["push_relabel", "edmonds_karp", "push_relabel", "hopcroft_karp"]
    assert got[0]["beta"] == got[1]["beta"] == got[2]["beta"] and got[3]["beta"] != got[3]["beta"] and 0 < got[0]["duration"] < 60


def test_nearest_rows_match_brute_force(spark):
    """Ties by id, copies, and a third of all rows in one place."""
    from tablewright.operators import privacy

    rng = random.Random(3)
    rows = lambda n: [(k, 5.0, 5.0) if k % 3 == 0 else (k, round(rng.gauss(0, 40), 1), float(rng.randrange(6))) for k in range(n)]
    a, b = rows(90), rows(120)
    x, y = (spark.createDataFrame(t, "id long, p double, q double") for t in (a, b))
    far = lambda u, v: abs(u[1] - v[1]) + abs(u[2] - v[2])
    for k in (1, 7):
        got = {}
        for r in privacy.nearest(x, y, ["p", "q"], k).collect():
            got.setdefault(r.x_id, {})[r.r] = (r.y_id, r.distance)
        want = {u[0]: {i + 1: (v[0], far(u, v)) for i, v in enumerate(sorted(b, key=lambda v: (far(u, v), v[0]))[:k])} for u in a}
        assert got == want
    got = {(r.x_id, r.r): r.y_id for r in privacy.nearest(y, y, ["p", "q"], 4, others=True).collect()}
    want = {(u[0], i + 1): v[0] for u in b for i, v in enumerate(sorted((v for v in b if v[0] != u[0]), key=lambda v: (far(u, v), v[0]))[:4])}
    assert got == want
    assert privacy.nearest(x, y.limit(0), ["p", "q"], 2).count() == 0 == privacy.nearest(x.limit(0), y, ["p", "q"], 2).count()
    assert privacy.nearest(x, y.limit(2), ["p", "q"], 5).groupBy("x_id").count().filter("count <> 2").count() == 0


def test_matching_by_components(spark):
    edges = spark.createDataFrame([(1, 11), (1, 12), (2, 12), (3, 13), (4, 13), (5, 15)], "x_id long, y_id long")
    x = spark.createDataFrame([(k, 1) for k in range(1, 6)], "id long, n long")
    y = spark.createDataFrame([(k, 1) for k in range(11, 16)], "id long, n long")
    assert faithfulness.edge_components(edges).select("block").distinct().count() == 3
    for local in (0, 100):
        info = faithfulness.matching_info(x, y, faithfulness.matching(x, y, edges, local_edges=local))
        assert info["size"] == 4 and info["beta"] == pytest.approx(0.2)


def test_radius_join_matches_brute_force(spark):
    rng = random.Random(9)
    rows = lambda: [(k, round(rng.uniform(0, 9), 2), float(rng.randrange(4)), 100.0 * rng.randrange(2)) for k in range(60)]
    a, b = rows(), rows()
    x, y = (spark.createDataFrame(t, "id long, p double, q double, r double") for t in (a, b))
    for alpha in (0.0, 0.7, 1.0, 2.5):
        got = {(r.x_id, r.y_id) for r in faithfulness.radius_edges(x, y, ["p", "q", "r"], alpha).collect()}
        assert got == {(u[0], v[0]) for u in a for v in b if sum(abs(s - t) for s, t in zip(u[1:], v[1:])) <= alpha}


@pytest.mark.parametrize("p", [1, 2])
def test_ranges_match_brute_force(p):
    rng = np.random.default_rng(3)
    for _ in range(60):
        d = int(rng.integers(1, 4))
        x, y = (np.unique(rng.integers(0, 6, (int(rng.integers(1, 25)), d)) * rng.choice([0.1, 0.3, 1.0], d), axis=0) for _ in range(2))
        alpha = float(rng.choice([0, 0.3, 0.6, 1.0, 1.5]))
        r = ranges.Ranges(x, y, alpha, p)
        want = sorted((i, j) for i, u in enumerate(x) for j, v in enumerate(y) if ranges.distances(list(u), list(v), p) <= alpha)
        assert want == sorted((i, int(r.order[q])) for i in range(len(x)) for k in range(r.start[i], r.start[i + 1]) for q in range(r.lo[k], r.hi[k]))
        supply, demand = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
        assert r.sums(supply, demand) == (len(want), sum(int(supply[i] * demand[j]) for i, j in want))
        got = ranges.match_ranges(r, supply, demand)
        used = [collections.Counter(), collections.Counter()]
        for i, j, k in got:
            assert (i, j) in want and k > 0
            used[0][i] += k
            used[1][j] += k
        assert all(used[0][i] <= supply[i] for i in used[0]) and all(used[1][j] <= demand[j] for j in used[1])
        if want:
            a, b = (np.array(z) for z in zip(*want))
            assert sum(k for *_, k in got) == sum(flows.match_counts(a, b, dict(enumerate(supply)), dict(enumerate(demand))).values())


def test_large_joins_keep_their_tasks(spark, monkeypatch):
    monkeypatch.setattr(faithfulness, "DEALT_ROWS", 100)
    x, y = (spark.range(200).select("id", (F.col("id") / 7).alias("p"), (F.col("id") % 3).cast("double").alias("q")) for _ in range(2))
    edges = faithfulness.radius_edges(x, y, ["p", "q"], 1.5)
    assert edges.rdd.getNumPartitions() >= faithfulness.RANGE_TASKS
    assert edges.count() == sum(abs(a / 7 - b / 7) + abs(a % 3 - b % 3) <= 1.5 for a in range(200) for b in range(200))


def _no_pairs(*_, **__):
    raise AssertionError("pairs were made")


def test_density_makes_no_pairs(spark, monkeypatch):
    """Copies of rows, values a distance of exactly alpha apart, nulls: as many pairs as the join has, none of them made."""
    rng = random.Random(4)
    rows = lambda: [(k, rng.choice([None, *map(float, range(8))]), rng.randrange(40) / 50, 100.0 * rng.randrange(2)) for k in range(300)]
    columns = ["p", "q", "r"]
    x, y = (spark.createDataFrame(rows(), "id long, p double, q double, r double") for _ in range(2))
    want = {a: faithfulness.radius_edges(x, y, columns, a).count() for a in (0.0, 0.5, 1.5)}
    monkeypatch.setattr(faithfulness, "radius_edges", _no_pairs)
    cx, cy = (faithfulness.configurations(t, columns) for t in (x, y))
    assert {a: n for a, (_, n) in faithfulness.radius_counts(cx, cy, columns, [0.5, 1.5]).items()} == {a: want[a] for a in (0.5, 1.5)}
    assert faithfulness.radius_counts(cx, cy, columns, [0.0])[0.0][1] == want[0.0] > 0
    registry.QUERIES["radius_density"](spark, "/root/testdata/sf0.001")


def test_matching_of_many_edges_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    x, y = (spark.createDataFrame([(float(rng.randrange(8)), rng.randrange(60) / 10, 100.0 * rng.randrange(3)) for _ in range(400)], "a double, b double, c double") for _ in range(2))
    alphas = [0.3, 1.0, 1.5]
    want = faithfulness.evaluate(x, y, {}, alphas)
    monkeypatch.setattr(faithfulness, "LOCAL_EDGES", 0)
    monkeypatch.setattr(faithfulness, "radius_edges", _no_pairs)
    got = faithfulness.evaluate(x, y, {}, alphas)
    left = lambda r, side: sum(u.left for u in r[f"unmatched_{side}"].collect())
    for a, b in zip(got, want):
        assert a["beta"] == pytest.approx(b["beta"]) and a["density"] == b["density"] and 0 < a["duration"] and a["algorithm"] == "hopcroft_karp"
        assert left(a, "x") == left(b, "x") == left(a, "y") == left(b, "y") == round(a["beta"] * 400)
    assert want[0]["beta"] > 0


@pytest.mark.parametrize("order", [1, 2])
def test_projection(spark, order):
    rng = random.Random(order)
    df = spark.createDataFrame([(int(rng.paretovariate(0.6)) % 400, rng.randrange(3)) for _ in range(2000)], "a int, b int")
    before = {(r.a, r.b): r["count"] for r in df.groupBy("a", "b").count().collect()}
    out = postprocess.project(df, {"name": "min-count", "order": order}, 5)
    after = {(r.a, r.b): r["count"] for r in out.groupBy("a", "b").count().collect()}
    assert sum(after.values()) == 2000 and min(after.values()) > order and set(after) <= set(before)
    high = {k: v for k, v in before.items() if v > 2 * (order + 1) + 2}
    assert all(after[k] >= v for k, v in high.items())
    assert postprocess.project(df, None) is df
    with pytest.raises(ValueError):
        postprocess.project(df, {"name": "other"})
    with pytest.raises(RuntimeError):
        postprocess.reject(df, [F.col("a") < 0], 5)


def test_acceptance(spark):
    u = spark.createDataFrame([("median", 1.0), ("mean1", 1.2), ("mean2", 1.1), ("mean3", 1.5), ("var", 3.5)], "metrics string, values double")
    f = spark.createDataFrame([(1.0, 0.5)], "alpha double, beta double")
    criteria = lambda a, b, c: [acceptance.Criterion("m", "u", "metrics = 'median'", "values", a), acceptance.Criterion("means", "u", "metrics LIKE 'mean%'", "values", b, False), acceptance.Criterion("beta", "f", "alpha = 1", "beta", c)]
    run = lambda *e: [r.check for r in acceptance.check(spark, criteria(*e), {"u": u, "f": f}).collect()]
    assert run(2, 1.7, 0.75) == [True] * 4 and run(1, 1.5, 0.5) == [False] * 4 and run(0.5, 1.7, 0.75) == [False, True, True, False]
    missing = acceptance.check(spark, criteria(2, 2, 2), {"u": u, "f": None}).collect()
    assert [r.check for r in missing] == [True, True, False, False] and missing[2].actual is None


def test_mechanisms():
    assert acceptance.pseudo_threshold(0.05, 50, 2, 0.3)[0] == pytest.approx(1.4095935658989616)
    assert birth.BUDGET.total == pytest.approx(0.99)
    pseudo, _, _, scale = acceptance.pseudo_threshold(0.05, 100, 2, 0.3)
    draws = [mechanisms.laplace_noise(scale) for _ in range(20000)]
    assert sum(pseudo + d > 2 for d in draws) / 20000 == pytest.approx(0.05, abs=0.01)
    assert abs(sum(draws) / 20000) < 5 * scale * math.sqrt(2 / 20000)
    picks = [mechanisms.exponential_choice([0.0, 1.0], 2 * math.log(3), 1.0) for _ in range(8000)]
    assert sum(picks) / 8000 == pytest.approx(0.75, abs=0.03)
    book = mechanisms.Accountant()
    got = mechanisms.laplace(1.0, 0.5, 2.0, book, "x")
    assert book.total == 0.5 and got["var"] == 32 and got["sensitivity"] == 2


def test_release(spark):
    n = 1500
    real, synth = birth.example(spark, n, 1), birth.example(spark, n, 2)
    domain = evaluate.Domain(birth.EVALUATION_BINS, birth.MIDPOINTS)
    real = real.withColumn("row_id", F.monotonically_increasing_id())
    got = evaluate.evaluate(real, synth, real, domain, birth.WEIGHTS, birth.ALPHAS, 2, birth.CRITERIA, 0.5, 0, True, birth.USER_ANALYSES, budget=birth.BUDGET, bounds=birth.BOUNDS, comparisons=["val_pr_s"])
    rows = {r.name: r for r in got.release.collect()}
    assert len(rows) == 11 and got.accountant.total == pytest.approx(0.99) and rows["all"].epsilon == pytest.approx(0.99)
    diff, mae = rows["utility/123456way/max/frequencies/diff/raw/val_pr_s"], rows["utility/lr/MAE/cross/1-by-2/val_pr_s"]
    assert (diff.lower, diff.upper, diff.epsilon, diff.sensitivity) == (0, 1, 0.01, pytest.approx(1 / n))
    assert (mae.lower, mae.upper, mae.epsilon, mae.sensitivity) == (1400, 4600, 0.04, pytest.approx(2 * 3200 / n))
    assert rows["privacy/face/unique/1/max"].mech is None and not rows["all"].check


def test_taxonomy_and_parents():
    assert [max(g) + 1 for g in bayesnet.taxonomy(12)] == [12, 9, 5] and [max(g) + 1 for g in bayesnet.taxonomy(32)] == [32, 29, 25, 21, 17, 13, 9, 5]
    assert len(bayesnet.taxonomy(4)) == 1
    d = bayesnet.Domain(["a", "b", "c"], [4, 12, 2])
    by_degree = bayesnet.parent_sets(d, [0, 1, 2], 2, True)
    A = bayesnet.Attribute
    assert set(by_degree) == {(A(0), A(1)), (A(0), A(2)), (A(1), A(2))}
    for z in bayesnet.parent_sets(d, [0, 1, 2], 25, False):
        assert math.prod(d.width(a) for a in z) <= 25
    assert d.specialise(A(1, 2), 4) == (4, 12) and d.specialise(A(1, 0), 3) == (3, 4)


@pytest.mark.parametrize("how", [{"theta": 4}, {"degree": 2}])
def test_network_keeps_dependence(spark, how):
    rng = random.Random(2)
    rows = [(x := rng.randrange(3), x if rng.random() < 0.9 else rng.randrange(3), rng.randrange(2)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    out, net = models.fit_sample(df, {"a": (0, 2), "b": (0, 2), "c": (0, 1)}, "PBN", 100.0, 0.0, how, df.columns)
    assert out.count() == 3000 and out.columns == ["a", "b", "c"]
    agree = out.agg(F.avg((F.col("a") == F.col("b")).cast("double"))).first()[0]
    assert agree == pytest.approx(sum(r[0] == r[1] for r in rows) / 3000, abs=0.06)
    log = net.log(spark)
    assert log.filter("stage = 'structure'").count() == 3 and log.filter("stage = 'noise' AND abs(count + noise - noisy) > 1e-9").count() == 0


def test_models(spark):
    df = spark.createDataFrame([(k % 5, k % 3) for k in range(300)], "a int, b int")
    b = {"a": (0, 4), "b": (0, 2)}
    fit = lambda m, **k: models.fit_sample(df, b, m, 1.0, categories=["a", "b"], **k)
    assert fit("ID")[0].count() == 300 and fit("ID", n=10)[0].count() == 10 and fit("GC")[0].count() == 300 and fit("MWEM")[0].count() == 300
    for m, error in (("nope", ValueError), ("CTGAN", NotImplementedError), ("DPGC", NotImplementedError)):
        with pytest.raises(error):
            fit(m)
    for h in ({"theta": 1, "x": 2}, {}, {"theta": 1, "degree": 1}):
        with pytest.raises(ValueError):
            fit("PBN", hparams=h)
    with pytest.raises(ValueError):
        models.fit_sample(df, b, "ID", 1.0, 0.5)
