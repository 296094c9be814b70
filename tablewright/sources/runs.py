"""An experiment store: runs, their configurations, metrics and tables as Parquet under one folder.

Runs are appended, partitioned by day, so a time range reads only its days. A run's state changes by a new row; the
latest row of a run counts.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, created_at timestamp, state string, group_name string, config string, day date"


class RunStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def log(self, config: dict, state: str = "running", group: str = "", run_id: str | None = None) -> str:
        run_id, now = run_id or uuid.uuid4().hex, datetime.now(timezone.utc)
        row = [(run_id, now, state, group, json.dumps(config, sort_keys=True), now.date())]
        self.spark.createDataFrame(row, RUNS).write.mode("append").partitionBy("day").parquet(f"{self.folder}/runs")
        return run_id

    def metrics(self, run_id: str, values: dict[str, float]) -> None:
        rows = [(run_id, k, float(v)) for k, v in values.items()]
        self.spark.createDataFrame(rows, "run_id string, key string, value double").write.mode("append").parquet(f"{self.folder}/metrics")

    def artifact(self, run_id: str, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.folder}/tables/{run_id}/{name}")

    def read_artifact(self, run_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tables/{run_id}/{name}")

    def finish(self, run_id: str) -> None:
        """The move of a finished configuration: a new state."""
        last = self.runs().filter(F.col("run_id") == run_id).first()
        self.log(json.loads(last.config), "finished", last.group_name, run_id)

    def runs(self, since: str | None = None, until: str | None = None, group: str | None = None) -> DataFrame:
        """The latest row of each run, of the days and group asked for."""
        df = self.spark.read.schema(RUNS).parquet(f"{self.folder}/runs")
        for ok in ((F.col("day") >= since) if since else None, (F.col("day") <= until) if until else None, (F.col("group_name") == group) if group else None):
            df = df if ok is None else df.filter(ok)
        return df.groupBy("run_id").agg(*(F.max_by(c, "created_at").alias(c) for c in ("state", "group_name", "config")), F.max("created_at").alias("created_at"))

    def read_metrics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/metrics")
