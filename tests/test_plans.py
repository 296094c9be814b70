"""Configurations, generation, sources, reports, and the driver's contract."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewright import cli
from tablewright.operators.filters import with_row_id
from tablewright.plans import birth, generate, report, selection
from tablewright.sources import runs, tables

SPEC = {
    "binary": {"type": "binary"},
    "c1": {"type": "continuous", "lower": 1, "upper": 10, "bins": [[1, 2, 11], [1, 2, 3, 11]], "unit_bins": False},
    "c2": {"type": "continuous", "lower": 1, "upper": 10, "bins": [[1, 2, 11], [1, 2, 3, 11]], "unit_bins": True},
    "date": {"type": "datetime", "format": "%d/%m/%Y"},
}


def test_grid(tmp_path):
    data = list(selection.data_configs(SPEC, "only", False, False))
    assert len(data) == 6 and data[0]["num_cat_cells"] == 9 and data[0]["categoricals"] == ["binary", "c1", "c2", "date"]
    configs = list(selection.generation_configs(selection.MODELS, SPEC, 1.0, 0.0))
    assert len(configs) == 6 * 48 * 2 == len({c["id"] for c in configs})
    assert len(list(selection.generation_configs(selection.MODELS, birth.TRANSFORMATIONS, 1.0, 0.0))) == 1152
    assert len(list(selection.data_configs(SPEC, "matters", False, True))) == (1 + 4) * (1 + 6) * (3 + 2)
    for bad in (lambda: selection.continuous(2, 1), lambda: selection.continuous(1, 2, 0), lambda: selection.categorical(1, 2, [2, 1], False), lambda: selection.datetime("%d", "hour", False), lambda: list(selection.data_configs(SPEC, "other", False, False))):
        with pytest.raises(AssertionError):
            bad()
    order = selection.grid_order(configs)
    assert [c["tier"] for c in order] == sorted(c["tier"] for c in configs)
    paths = tables.write_configs(configs[:3], str(tmp_path / "c"))
    assert tables.read_config(paths[0]) == json.loads(json.dumps(configs[0]))
    with pytest.raises(FileExistsError):
        tables.write_configs(configs[:1], str(tmp_path / "c"))
    assert selection.private_selection(configs, lambda c: c["tier"] > 2, 1000)["tier"] > 2
    results = selection.run_all(configs[:4], lambda c: 1 // 0 if c is configs[1] else c["tier"])
    assert isinstance(results[1], ZeroDivisionError) and results[0] == 0


def test_config_metadata(spark, tmp_path):
    configs = list(selection.generation_configs(selection.MODELS, SPEC, 1.0, 0.0))[:5]
    tables.write_configs(configs, str(tmp_path))
    got = {r.id: r for r in tables.config_metadata(spark, str(tmp_path)).collect()}
    assert {c["id"]: (c["tier"], c["num_cat_cells"]) for c in configs} == {k: (r.tier, r.num_cat_cells) for k, r in got.items()}


@pytest.mark.parametrize("model,hparams", [("ID", {}), ("PBNTheta", {"theta": 8, "epsilon_split": 0.25})])
def test_generation(spark, model, hparams):
    real = with_row_id(birth.example(spark, 1200, 4), ["mother_age", "birth_weight", "parity", "gestation_week", "date_of_birth", "is_female"])
    data = next(selection.data_configs({k: v for k, v in birth.TRANSFORMATIONS.items()}, "only", False, False))
    config = {"model": model, "epsilon": 50.0, "delta": 0.0, "hparams": hparams, **data}
    got = generate.generate(real, config, birth.SCHEMA, birth.constraints() if model != "ID" else (), 1.5, 3)
    assert got.synth.count() == 1200 and set(got.synth.columns) == set(birth.SCHEMA.columns)
    assert got.processed.count() == 1200 and "row_id" in got.processed.columns
    if model != "ID":
        assert got.synth.filter(~birth.constraints()[0]).count() == 0
    with pytest.raises(ValueError):
        generate.generate(real, {**config, "hparams": {"what": 1}}, birth.SCHEMA)


def test_sources(spark, tmp_path):
    df = birth.example(spark, 40)
    tables.write_twin(df, str(tmp_path / "t"))
    assert tables.read_csv(spark, str(tmp_path / "t.csv")).count() == 40 and spark.read.parquet(str(tmp_path / "t.parquet")).count() == 40
    (tmp_path / "s.json").write_text(json.dumps({"columns": ["b", "a"], "data": [["x", 1], ["y", 2]]}))
    assert [tuple(r) for r in tables.read_split_json(spark, str(tmp_path / "s.json"), "a int, b string").collect()] == [(1, "x"), (2, "y")]
    codes = spark.createDataFrame([(0, 1), (1, 0)], "y int, a int")
    tables.write_libsvm(codes, str(tmp_path / "l"), "y", {1}, {"a": 2})
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["0 2:1", "1 1:1"]
    tables.write_tsv(codes, str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t").count() == 2


def test_run_store_and_report(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path))
    run = store.log({"model": "PBNTheta", "tier": 3}, group="g")
    store.metrics(run, {"x": 1, "y": 0})
    store.artifact(run, "t", spark.range(3))
    store.finish(run)
    other = store.log({"model": "ID"})
    table = store.runs()
    assert {r.run_id: r.state for r in table.collect()} == {run: "finished", other: "running"} and store.runs(group="g").count() == 1
    assert store.runs(since="2999-01-01").count() == 0 and store.read_artifact(run, "t").count() == 3
    wide = report.run_table(table, store.read_metrics(), ["model"], ["x", "y"]).orderBy("model").collect()
    assert [r.passed for r in wide] == [False, False] and [r.model for r in wide] == ["ID", "PBNTheta"]


def test_reports(spark):
    a, b = birth.example(spark, 200, 1), birth.example(spark, 200, 2)
    stack = report.stacked({"a": a, "b": b}, {"birth_weight": [0, 2500, 4000, float("inf")]})
    assert stack.count() == 400 and "birth_weight_bin" in stack.columns
    assert report.group_means(stack, "birth_weight", "parity").count() > 2 and report.column_profiles(stack, ["parity"]).count() == 2
    assert {r.name for r in report.regressions({"a": a, "b": b}).collect()} == {"a", "b"} and report.regressions({"a": a}).first().p < 1e-6
    assert report.unseen_pairs(a, b, b.limit(0), "mother_age", "parity").filter("processed > 0").count() == 0
    assert len(report.crosstabs(stack, ["parity", "is_female"])) == 1 and report.ratio_budgets(spark, [0.1, 0.3], [50, 100], 2).count() == 4
    x = stack.filter("name = 'a'").select("gestation_week", "birth_weight")
    import numpy as np

    errors = report.noisy_fit_errors(x, np.array([-4.0]), np.array([4.0]), (1400, 4600), [1e3, 1e9], 5)
    best = {r.epsilon: r.e for r in errors.groupBy("epsilon").agg(F.avg("error").alias("e")).collect()}
    assert best[1e9] < 0.01
    assert report.resize_study(x, x, "birth_weight", "gestation_week", [0, 37, float("inf")], 3000.0, 2).count() == 2


def test_full_report(spark, tmp_path):
    a, b = birth.example(spark, 150, 1), birth.example(spark, 150, 2)
    store = runs.RunStore(spark, str(tmp_path))
    for k in range(3):
        store.metrics(store.log({"model": "ID", "tier": k}), {"x": 1, "y": k % 2})
    empty = spark.createDataFrame([], "name string, metric string, target string, binning boolean, by string, targets array<string>, val_pr_s double")
    bins = {"birth_weight": [0, 2500, 4000, float("inf")], "gestation_week": [0, 37, float("inf")]}
    found = report.full({"processed": a, "synth": b}, empty, bins, b.limit(5), store.runs(), store.read_metrics())
    assert {"marginals", "profiles", "regressions", "runs", "accepted", "flags", "crosstab-birth_weight_bin-gestation_week_bin", "means-parity-birth_weight_bin", "ecdf-parity", "unseen-mother_age-parity"} <= set(found)
    assert found["runs"].count() == 3 and {r.n for r in found["flags"].collect()} == {1, 2}
    assert found["means-parity-gestation_week_bin"].count() == 4 and found["profiles"].count() == 2


def test_cli_span(tmp_path, capsys):
    assert cli.main(["span", str(tmp_path / "g"), "--epsilon", "1"]) == 0
    assert capsys.readouterr().out.strip() == "1152"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in tables.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(repr([fix(r[k]) for k in order]) for r in rows)


from tablewright.plans import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cur = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), columns)
