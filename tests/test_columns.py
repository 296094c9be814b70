"""Binning, numbers, transforms, schemas, filters."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tablewright.functions import binning, names, stats
from tablewright.operators import filters, schema, transforms
from tablewright.plans import birth

INF = float("inf")


def test_reconciled_edges():
    up, down = lambda x: math.nextafter(x, INF), lambda x: math.nextafter(x, -INF)
    r = binning.reconcile_edges
    assert r([1, 2, 3, 4], [1, 2, 3, 4]) == [-INF, 2, 3, INF]
    assert r([1, 2, 3, 4, 5, 6], [1, 2, 4, 5, 6]) == [-INF, 2, up(2), down(4), 4, 5, INF]
    assert r([1, 2, 3, 4, 5, 6, 7], [1, 2, 6, 7]) == [-INF, 2, up(2), down(6), 6, INF]
    assert r([1, 3, 5, 9], [1, 3, 5, 7, 9]) == [-INF, 3, 5, INF]
    age, spec = birth.WEIGHTS["mother_age"], birth.TRANSFORMATIONS["mother_age"]
    assert r(age, spec["bins"][0]) == [-INF, 18, 20, 25, 30, 35, up(35), down(40), 40, 43, INF]
    assert r(age, spec["bins"][1]) == [-INF, *age[1:-1], INF]
    assert r(age, list(range(17, 47))) == [-INF, *age[1:]]
    with pytest.raises(AssertionError):
        r([1, 2, 3], [1, 2, 3])
    got = binning.reconcile_weights({"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 4, 5], "c": 2}, {"a": [1, 2, 4, 5], "b": [1, 2, 4, 5]}, first_only=True)
    assert got["b"] == [1, 2, 3, 4, 5] and got["a"] != got["b"] and got["c"] == 2


def test_digitize_cut_and_scaling(spark):
    df = spark.createDataFrame([(1.0, 0, 1, 7), (2.0, 1, 2, 8), (3.0, 1, 3, 9), (40.0, 1, 6, None)], "a double, b int, c int, d int")
    out = binning.scale_by_weights(df, {"a": 0.1, "b": 10, "c": [1, 2, 3, 4, 10]}).collect()
    assert [r.a for r in out] == pytest.approx([0.1, 0.2, 0.3, 4.0]) and [r.b for r in out] == [0, 10, 10, 10]
    assert [r.c for r in out] == [1, 2, 3, 4] and [r.d for r in out] == [7, 8, 9, None]
    with pytest.raises(TypeError):
        binning.scale_by_weights(df, {"a": "x"})
    assert [r[0] for r in df.select(binning.cut(F.col("a"), [2, 3, 40])).collect()] == [None, 0, 1, None]
    assert [r[0] for r in df.select(binning.half_even(F.col("c") / 2)).collect()] == [0, 1, 2, 3]


def mixed(spark):
    rows = [(k % 2 == 0, k + 1, date(2020, k + 3, 25)) for k in range(10)]
    return spark.createDataFrame(rows, "binary boolean, nominal long, date date")


STEPS = {"binary": [{"name": "binary"}], "nominal": [{"name": "clipping", "lower": 1, "upper": 10}, {"name": "binning", "bins": [1, 2, 4, 7, 11]}], "date": [{"name": "datetime", "format": "%d/%m/%Y", "resolution": "month"}]}


def test_forward_and_backward(spark):
    df = mixed(spark)
    coded = transforms.forward(schema.prepare(df), STEPS, ["binary", "nominal", "date"])
    assert coded.bounds == {"binary": (0, 1), "nominal": (0, 3), "date": (0, 11)}
    rows = coded.df.collect()
    assert [r.nominal for r in rows] == [0, 1, 1, 2, 2, 2, 3, 3, 3, 3] and [r.date for r in rows] == list(range(2, 12))
    spec = schema.TableSpec({"binary": schema.ColumnSpec("boolean"), "date": schema.ColumnSpec("date")})
    back = schema.restore(transforms.backward(coded.df, coded.back), spec)
    got = back.collect()
    assert [r.binary for r in got] == [True, False] * 5 and [r.date for r in got] == [date(2020, m, 15) for m in range(3, 13)]
    assert [tuple(r.nominal) for r in got] == [(1, 2)] + [(2, 4)] * 2 + [(4, 7)] * 3 + [(7, 11)] * 4
    numbers = binning.numerify(back).collect()
    assert [r.nominal for r in numbers] == [1, 3, 3, 5.5, 5.5, 5.5, 9, 9, 9, 9]
    assert [r.date for r in numbers] == [75, 106, 136, 167, 197, 228, 259, 289, 320, 350]
    assert [r.date for r in binning.numerify(df).collect()] == [85, 116, 146, 177, 207, 238, 269, 299, 330, 360]


def test_transform_errors(spark):
    df = schema.prepare(mixed(spark))
    for change in ({"nominal": None}, {"nominal": [{"name": "binning", "bins": [2, 4, 7, 11]}]}, {"nominal": [{"name": "binning", "bins": [1, 2, 4, 7, 10]}]}, {"nominal": [{"name": "resolution", "scale": 2}]}, {"nominal": [{"name": "binary"}]}, {"nominal": [{"name": "nonsense"}]}):
        steps = {k: v for k, v in {**STEPS, **change}.items() if v is not None}
        with pytest.raises(ValueError):
            transforms.forward(df, steps, ["binary", "date"])
    two_years = spark.createDataFrame([(date(2020, 1, 1),), (date(2021, 1, 1),)], "d date")
    with pytest.raises(ValueError):
        transforms.forward(two_years, {"d": [{"name": "datetime", "format": "%Y", "resolution": "month"}]})
    with pytest.raises(TypeError):
        schema.prepare(spark.createDataFrame([([1],)], "a array<int>"))


def test_one_hot_resolution_and_text_dates(spark):
    df = spark.createDataFrame([(float(k), f"{k + 1:02d}/06/2021") for k in range(10)], "v double, d string")
    steps = {"v": [{"name": "clipping", "lower": 0, "upper": 9}, {"name": "binning", "bins": [0, 3, 6, 10]}, {"name": "one_hot"}], "d": [{"name": "datetime", "format": "%d/%m/%Y", "resolution": "dayofyear"}]}
    coded = transforms.forward(df, steps, ["v", "d"])
    assert coded.df.columns == ["v#0", "v#1", "v#2", "d"] and coded.categories == ["v#0", "v#1", "v#2", "d"]
    back = transforms.backward(coded.df, coded.back).collect()
    assert [r.v.lo for r in back] == [0, 0, 0, 3, 3, 3, 6, 6, 6, 6] and [r.d for r in back] == [date(2021, 6, k + 1) for k in range(10)]
    scaled = transforms.forward(df.select("v"), {"v": [{"name": "clipping", "lower": 0, "upper": 9}, {"name": "resolution", "scale": 2}]})
    assert [r.v for r in scaled.df.collect()] == [0, 0, 1, 2, 2, 2, 3, 4, 4, 4] and scaled.bounds["v"] == (0, 5)
    assert [r.v for r in transforms.backward(scaled.df, scaled.back).collect()][-1] == 8


@pytest.mark.parametrize("year", [2019, 2020, 2023])
def test_weeks_match_python(spark, year):
    days = [date(year, 1, 1) + timedelta(k) for k in range(365)]
    df = spark.createDataFrame([(x,) for x in days], "d date")
    got = df.select(transforms.date_code(F.col("d"), "week").alias("w"), transforms.code_date(transforms.date_code(F.col("d"), "week"), "week", year).alias("b")).collect()
    for x, r in zip(days, got):
        assert r.w == int(x.strftime("%U"))
        assert r.b.weekday() == 2 and abs((r.b - x).days) <= 4


def test_schema(spark):
    good = birth.example(spark, 50)
    assert schema.validate(good, birth.SCHEMA).columns == list(birth.SCHEMA.columns)
    bad = good.withColumn("parity", F.lit(99).cast("long"))
    assert schema.violations(bad, birth.SCHEMA).first().bad_parity == 50
    assert schema.rejects(bad, birth.SCHEMA).first().failed == ["parity"]
    with pytest.raises(ValueError):
        schema.validate(bad, birth.SCHEMA)
    with pytest.raises(ValueError):
        schema.conform(good.drop("parity"), birth.SCHEMA)


def test_filters(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12)], "col1 int, col2 int")
    assert filters.single_row(df, "col1 = 1 AND col2 = 11").col2 == 11
    for expr in ("col1 = 1", "col1 = 5"):
        with pytest.raises(AssertionError):
            filters.single_row(df, expr)
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "a int")
    assert filters.duplicated(nulls).count() == 2 and filters.duplicated(nulls, unique=True).count() == 1
    kept, lost = filters.split_by(df, [F.col("col1") == 1, F.col("col2") < 11])
    assert (kept.count(), lost.count()) == (1, 3)
    ids = filters.with_row_id(df, ["col2", "col1"]).orderBy("row_id").collect()
    assert [(r.row_id, r.col2) for r in ids] == [(0, 10), (1, 11), (2, 11), (3, 12)]


def test_names():
    assert list(names.n_way("abcd", [1, 2, 3]))[:5] == [("a",), ("b",), ("c",), ("d",), ("a", "b")] and len(list(names.n_way("abcd", [1, 2, 3]))) == 14
    assert len(names.short_id({"b": 1, "a": [1, 2]})) == 4 and names.short_id({"b": 1, "a": 2}) == names.short_id({"a": 2, "b": 1})


def test_tails_and_assignment():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and stats.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert stats.ks_tail(0.5, 100, 100) < 1e-9 and stats.ks_tail(1.3581 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-3)
    assert stats.f_tail(4.9646027437, 1, 10) == pytest.approx(0.05, abs=1e-6)
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n in range(1, 7):
        cost = rng.integers(0, 20, (n, n)).astype(float)
        got = stats.assignment(cost)
        assert sorted(got) == list(range(n))
        assert sum(cost[i, j] for i, j in enumerate(got)) == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_round_quickly_is_round(spark):
    rng = random.Random(11)
    some = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, -0.5e-6, -1e-9, 1.0000005, 0.1234565, 2.675, 1e6, 999999.9999995, 4.5e15, 1e300, float("inf"), float("nan"), None]
    some += [rng.uniform(0, 2) for _ in range(2000)] + [rng.randrange(10**7) / 1e7 for _ in range(2000)] + [-rng.uniform(0, 1e6) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in some], "v double")
    for digits in (0, 3, 6):
        got = df.select("v", F.hex(F.round("v", digits).cast("string").cast("binary")).alias("a"), F.hex(binning.round_quickly(F.col("v"), digits).cast("string").cast("binary")).alias("b")).collect()
        assert [r for r in got if r.a != r.b] == []
