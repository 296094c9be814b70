"""Generation: code a table, fit and draw, undo the coding, enforce constraints, project."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators import models, postprocess, transforms
from ..operators.schema import TableSpec, prepare, restore
from ..sources.tables import staged


@dataclass
class Generated:
    synth: DataFrame
    processed: DataFrame
    rejected: DataFrame
    model: object


def generate(real: DataFrame, config: dict, spec: TableSpec, constraints: Sequence[Column] = (), oversampling: float = 1.0, seed: int = 0) -> Generated:
    """processed is the real table coded and undone: what a perfect model could give. RuntimeError if the model returns
    another number of rows than asked for, or too few meet the constraints. real may have a row_id, which processed keeps."""
    plain = real.drop("row_id")
    n = plain.count()
    coded = transforms.forward(prepare(plain), config["transformations"], config["categoricals"])
    undo = lambda df: restore(transforms.backward(df, coded.back), spec)
    processed = undo(coded.df)
    if "row_id" in real.columns:
        kept = transforms.forward(prepare(plain), config["transformations"], config["categoricals"], check=False)
        processed = _with_ids(real, config, kept, spec)
    wanted = math.ceil(n * oversampling) if constraints else n
    drawn, model = models.fit_sample(coded.df, coded.bounds, config["model"], config["epsilon"], config.get("delta", 0.0), config.get("hparams"), [*coded.categories], wanted, seed)
    drawn = staged(drawn)
    if drawn.count() != wanted:
        raise RuntimeError(f"the model returned {drawn.count()} rows, not {wanted}")
    synth, rejected = postprocess.reject(undo(drawn), constraints, n if constraints else None)
    synth = staged(synth)
    synth = staged(postprocess.project(synth, config.get("dataset_projection"), seed))
    if synth.count() != n:
        raise RuntimeError(f"{synth.count()} rows after the projection, not {n}")
    return Generated(synth, processed, rejected, model)


def _with_ids(real: DataFrame, config: dict, coded: transforms.Coded, spec: TableSpec) -> DataFrame:
    """The processed table with the row_id of each real row: both projections, carried along."""
    steps = {**config["transformations"], "row_id": [{"name": "clipping", "lower": 0, "upper": 2**53}]}
    ids = transforms.forward(prepare(real), steps, config["categoricals"], check=False)
    out = restore(transforms.backward(ids.df, ids.back), spec)
    return out.withColumn("row_id", out["row_id"].cast("long"))
