"""Table sources and sinks."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_staged: list[tuple[SparkSession, str]] = []


def _shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Written to the folder in spark.checkpoint.dir and read again: random draws are drawn once, and a lost executor
    costs no recomputation. Removed when the session's process ends."""
    ship(df.sparkSession)
    path = f"{_shared(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _staged:
        atexit.register(_sweep)
    _staged.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstaged(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    _remove(df.sparkSession, df._staged_at)
    _staged[:] = [x for x in _staged if x[1] != df._staged_at]


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all machines share, removed with the staged tables."""
    path = f"{_shared(spark)}/staged/{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_sweep)
    _staged.extend((spark, f"{path}{end}") for end in ("", ".csv", ".parquet"))
    return path


def _sweep() -> None:
    for spark, path in _staged:
        if spark.sparkContext._jsc is not None and spark.sparkContext._jvm is not None:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, partitions: int | None = None) -> DataFrame:
    """CSV, plain or gzipped. A gzipped file is read by one task, so it is dealt out right after."""
    ship(spark)
    df = spark.read.csv(path, header=True, schema=schema) if schema is not None else spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith(".gz"):
        df = df.repartition(partitions or spark.sparkContext.defaultParallelism)
    return df


def write_twin(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV for people and Parquet for machines; intervals go to CSV as text."""
    from ..operators.schema import categories_to_strings

    df.write.mode(mode).parquet(f"{path}.parquet")
    categories_to_strings(df).write.mode(mode).csv(f"{path}.csv", header=True)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t")


def write_libsvm(df: DataFrame, path: str, label: str, positives: set[int], sizes: dict[str, int]) -> None:
    """One-hot features of the other columns, all codes in order; label 1 for the positive codes, else 0."""
    others, at, pieces = [c for c in df.columns if c != label], 1, []
    for c in others:
        pieces.append(F.concat((F.col(c) + at).cast("long").cast("string"), F.lit(":1")))
        at += sizes[c]
    df.select(F.concat_ws(" ", F.col(label).isin(*positives).cast("int").cast("string"), *pieces)).write.text(path)


def read_split_json(spark: SparkSession, path: str, schema: str, line_sep: str | None = None) -> DataFrame:
    """JSON documents of the form {"columns": [...], "data": [[...], ...]}, one a file, or several with line_sep between
    them; values are cast to the schema by name."""
    fields = T.StructType.fromDDL(schema).fields
    text = spark.read.text(path, wholetext=True) if line_sep is None else spark.read.text(path, lineSep=line_sep)
    doc = F.from_json("value", "columns array<string>, data array<array<string>>")
    rows = text.select(doc.alias("d")).select("d.columns", F.explode("d.data").alias("row"))
    at = lambda name: F.get("row", F.array_position("columns", F.lit(name)) - 1)
    return rows.select(*(at(f.name).cast(f.dataType).alias(f.name) for f in fields))


def write_configs(configs: list[dict], folder: str) -> list[str]:
    """One JSON file for each configuration, named by what it is; FileExistsError rather than overwrite."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for c in configs:
        name = f"{c['model']}-{'gpu' if c['gpu'] else 'cpu'}-{c['num_categorical']}-{c['tier']}-{c['num_cat_cells']}-{c['num_one_hot']}-{c['id']}.json"
        out.append(os.path.join(folder, name))
        with open(out[-1], "x") as f:
            json.dump(c, f, indent=2, sort_keys=True)
    return out


def read_config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def config_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """What the names of configuration files say: path, model, device, counts as numbers, and ids."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.input_file_name().alias("path"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    part = lambda k: F.get(F.split(stem, "-"), F.lit(k))
    numbers = [part(k).cast("int").alias(n) for k, n in ((2, "num_categorical"), (3, "tier"), (4, "num_cat_cells"), (5, "num_one_hot"))]
    return files.select("path", part(0).alias("model"), part(1).alias("device"), *numbers, F.concat_ws("-", *(part(k) for k in (6, 7, 8))).alias("id"))
