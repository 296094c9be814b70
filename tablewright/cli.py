"""Command line: span, execute, evaluate, parallel, report."""

from __future__ import annotations

import argparse
import glob
import json

from pyspark.sql import SparkSession

from .operators.filters import with_row_id
from .operators.schema import validate
from .plans import birth, evaluate, generate, report, selection
from .sources import tables
from .sources.runs import RunStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tablewright")
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("span", help="write a JSON file for each configuration")
    v.add_argument("folder")
    v.add_argument("--epsilon", type=float, required=True)
    v.add_argument("--delta", type=float, default=0.0)
    for name in ("execute", "parallel"):
        v = verbs.add_parser(name, help="generate and evaluate one configuration, or all of a folder")
        v.add_argument("config", help="a configuration file" if name == "execute" else "a folder of them")
        v.add_argument("data")
        v.add_argument("--store", required=True, help="folder of the run store")
        v.add_argument("--fraction", type=float, default=0.5)
        v.add_argument("--seed", type=int, default=0)
        v.add_argument("--minimal", action="store_true")
        v.add_argument("--non-private", action="store_true", help="leave out the private release")
        v.add_argument("--random-order", action="store_true")
        v.add_argument("--workers", type=int, default=4)
    v = verbs.add_parser("evaluate", help="evaluate given tables")
    for name in ("real", "synth", "processed"):
        v.add_argument(name)
    v.add_argument("--fraction", type=float, default=0.5)
    v.add_argument("--seed", type=int, default=0)
    v.add_argument("--minimal", action="store_true")
    v.add_argument("--out", required=True)
    v = verbs.add_parser("report", help="tables about a finished run")
    v.add_argument("store")
    v.add_argument("run_id")
    v.add_argument("--out", required=True)
    return p


def _evaluation(real, synth, processed, fraction, seed, minimal, private, binnings=None):
    domain = evaluate.Domain(birth.EVALUATION_BINS, birth.MIDPOINTS)
    return evaluate.evaluate(real, synth, processed, domain, birth.WEIGHTS, birth.ALPHAS, birth.FACE_UP_TO, birth.CRITERIA, fraction, seed, minimal, birth.USER_ANALYSES, birth.QUASI_SENSITIVE, binnings, birth.BUDGET if private else None, birth.BOUNDS)


def execute(spark: SparkSession, path: str, args) -> str:
    config, store = tables.read_config(path), RunStore(spark, args.store)
    run = store.log(config)
    real = with_row_id(validate(tables.read_csv(spark, args.data), birth.SCHEMA), list(birth.SCHEMA.columns))
    made = generate.generate(real, config, birth.SCHEMA, birth.constraints(), birth.OVERSAMPLING, args.seed)
    binnings = {c: s["bins"] for c, steps in config["transformations"].items() for s in steps if s["name"] == "binning"}
    done = _evaluation(real, made.synth, made.processed, args.fraction, args.seed, args.minimal, not args.non_private and not args.minimal, binnings)
    for name, df in (("synth", made.synth), ("processed", made.processed), ("rejected", made.rejected), ("utility", done.utility), ("privacy", done.privacy), ("faithfulness", done.faithfulness), ("acceptance", done.acceptance), ("release", done.release)):
        if df is not None:
            store.artifact(run, name, df)
    store.metrics(run, {r.name: float(r.check) for r in done.acceptance.collect()})
    store.finish(run)
    return run


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tablewright").getOrCreate()
    if args.verb == "span":
        paths = tables.write_configs(list(selection.generation_configs(selection.MODELS, birth.TRANSFORMATIONS, args.epsilon, args.delta)), args.folder)
        print(len(paths))
    elif args.verb == "execute":
        print(execute(spark, args.config, args))
    elif args.verb == "parallel":
        paths = {tables.read_config(p)["id"]: p for p in glob.glob(f"{args.config}/*.json")}
        configs = selection.grid_order([tables.read_config(p) for p in paths.values()])
        if args.random_order:
            import random

            random.Random(args.seed).shuffle(configs)
        for c, r in zip(configs, selection.run_all(configs, lambda c: execute(spark, paths[c["id"]], args), args.workers)):
            print(c["id"], r)
    elif args.verb == "evaluate":
        read = lambda p: spark.read.parquet(p)
        real, processed = (with_row_id(read(p), list(birth.SCHEMA.columns)) if "row_id" not in read(p).columns else read(p) for p in (args.real, args.processed))
        done = _evaluation(real, read(args.synth), processed, args.fraction, args.seed, args.minimal, False)
        for name, df in (("utility", done.utility), ("privacy", done.privacy), ("faithfulness", done.faithfulness), ("acceptance", done.acceptance)):
            if df is not None:
                df.write.parquet(f"{args.out}/{name}")
    elif args.verb == "report":
        store = RunStore(spark, args.store)
        synth, processed, utility, rejected = (store.read_artifact(args.run_id, n) for n in ("synth", "processed", "utility", "rejected"))
        found = report.full({"processed": processed.drop("row_id"), "synth": synth}, utility, birth.EVALUATION_BINS, rejected, store.runs(), store.read_metrics())
        for name, df in found.items():
            df.write.parquet(f"{args.out}/{name}")
        print(json.dumps({"run": args.run_id, "tables": sorted(found)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
