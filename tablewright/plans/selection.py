"""A grid of configurations, their order, their execution, and the private choice of one that passes."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import short_id
from ..operators.transforms import RESOLUTIONS

# The published grid of the network's parameters.
MODELS = {
    "PBNTheta": {
        "dp": "pure", "categorical_mode": "only", "universe_limited": False, "try_one_hot": False, "gpu": False,
        "hparams": {"theta": [2, 4, 8, 16, 20, 25, 30, 35, 40, 50, 60, 100], "epsilon_split": [0.1, 0.25, 0.5, 0.75]},
    }
}
PROJECTION_ORDERS = 2
MODES = ("only", "matters", "indifferent")


def continuous(lower: float, upper: float, scale: float | None = None) -> list[dict]:
    if not lower < upper:
        raise AssertionError("lower must be below upper")
    if scale is not None and scale <= 0:
        raise AssertionError("a scale is positive")
    clip = [{"name": "clipping", "lower": lower, "upper": upper}]
    return clip if scale is None else [*clip, {"name": "resolution", "scale": scale}]


def binary() -> list[dict]:
    return [{"name": "binary"}]


def categorical(lower: float, upper: float, bins: list, one_hot: bool) -> list[dict]:
    if any(a > b for a, b in zip(bins, bins[1:])):
        raise AssertionError("bins ascend")
    return [{"name": "clipping", "lower": lower, "upper": upper}, {"name": "binning", "bins": bins}, *([{"name": "one_hot"}] if one_hot else [])]


def datetime(fmt: str, resolution: str, one_hot: bool | None) -> list[dict]:
    if resolution not in RESOLUTIONS:
        raise AssertionError(f"{resolution!r} is none of {RESOLUTIONS}")
    return [{"name": "datetime", "format": fmt, "resolution": resolution}, *([{"name": "one_hot"}] if one_hot else [])]


def data_configs(spec: dict[str, dict], mode: str, universe_limited: bool, try_one_hot: bool, months_only: bool = True) -> Iterator[dict]:
    """transformations, categoricals, cells (of edges, as they are counted) and one-hot columns of each combination of
    how a column is represented."""
    if mode not in MODES:
        raise AssertionError(f"{mode!r} is none of {MODES}")
    hot = [False, True] if try_one_hot else [False]
    choices: list[list[tuple]] = []
    for name, s in spec.items():
        if s["type"] == "binary":
            choices.append([(name, binary(), True, 1, False)])
        elif s["type"] == "continuous":
            bins = [list(b) for b in s["bins"]]
            if mode != "indifferent" and s["unit_bins"]:
                unit = list(range(s["lower"], s["upper"] + 2))
                if unit in bins:
                    raise AssertionError(f"{name} has unit bins already")
                bins.append(unit)
            as_category = [(name, categorical(s["lower"], s["upper"], b, h), True, len(b), h) for h in hot for b in bins]
            as_number = [] if mode == "only" else [(name, continuous(s["lower"], s["upper"], s.get("resolution")), False, 1, False)]
            choices.append([*as_number, *as_category])
        elif s["type"] == "datetime":
            as_category = [(name, datetime(s["format"], r, h), True, 1, h) for r in (["month"] if universe_limited or months_only else ["month", "week"]) for h in hot]
            as_number = [] if mode == "only" else [(name, datetime(s["format"], r, None), False, 1, False) for r in RESOLUTIONS]
            choices.append([*as_number, *as_category])
        else:
            raise ValueError(f"unknown type {s['type']!r}")
    for combination in product(*choices):
        cells = 1
        for *_, n, _ in combination:
            cells *= n
        yield {
            "transformations": {name: steps for name, steps, *_ in combination},
            "categoricals": [name for name, _, category, *_ in combination if category],
            "num_cat_cells": cells, "num_one_hot": sum(h for *_, h in combination),
        }


def generation_configs(models: dict[str, dict], spec: dict[str, dict], epsilon: float, delta: float, orders: int = PROJECTION_ORDERS) -> Iterator[dict]:
    """Models by parameters by data by projection, each with its tier (how far its parameters are from the first) and id."""
    for model, m in models.items():
        if m["dp"] not in ("none", "pure", "approx"):
            raise ValueError(f"dp is none, pure or approx, not {m['dp']!r}")
        budget = {"none": (float("inf"), 0), "pure": (epsilon, 0), "approx": (epsilon, delta)}[m["dp"]]
        data = list(data_configs(spec, m["categorical_mode"], m["universe_limited"], m["try_one_hot"]))
        for picks in product(*(enumerate(v) for v in m["hparams"].values())):
            hparams = dict(zip(m["hparams"], (v for _, v in picks)))
            if m.get("filter_out", lambda h: False)(hparams):
                continue
            for d, order in product(data, range(1, orders + 1)):
                projection = {"name": "min-count", "order": order}
                ids = {"trans_id": short_id(d["transformations"]), "hparams_id": short_id(hparams), "projections_id": short_id([projection])}
                yield {
                    "model": model, "categorical_mode": m["categorical_mode"], "dp": m["dp"], "gpu": m["gpu"], "epsilon": budget[0], "delta": budget[1],
                    **d, "hparams": hparams, "tier": sum(i for i, _ in picks), "num_categorical": len(d["categoricals"]),
                    "dataset_projection": projection, **ids, "id": "-".join(ids.values()),
                }


def grid_order(configs: list[dict]) -> list[dict]:
    """Simple ones first, by numbers; models take turns."""
    queues: dict[str, list[dict]] = {}
    for c in sorted(configs, key=lambda c: (c["tier"], c["num_one_hot"], c["num_cat_cells"], c["num_categorical"], c["id"])):
        queues.setdefault(c["model"], []).append(c)
    out = []
    for k in range(max(map(len, queues.values()), default=0)):
        out += [q[k] for _, q in sorted(queues.items()) if k < len(q)]
    return out


def run_all(configs: list[dict], run: Callable[[dict], object], parallel: int = 4) -> list[object]:
    """Each configuration's jobs side by side in one session; an exception stands for the result of one that fails."""

    def guarded(c: dict):
        try:
            return run(c)
        except Exception as e:
            return e

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(guarded, configs))


def private_selection(configs: list[dict], run: Callable[[dict], bool], most: int | None = None) -> dict | None:
    """Draw configurations uniformly from a secure source, with replacement, until one passes."""
    for _ in range(most if most is not None else 10**9):
        c = configs[secrets.randbelow(len(configs))]
        if run(c):
            return c
    return None


def as_table(spark: SparkSession, configs: list[dict]) -> DataFrame:
    rows = [(c["id"], c["model"], c["tier"], c["num_categorical"], c["num_cat_cells"], c["num_one_hot"], c["dataset_projection"]["order"], json.dumps(c, sort_keys=True)) for c in configs]
    return spark.createDataFrame(rows, "id string, model string, tier int, num_categorical int, num_cat_cells long, num_one_hot int, projection_order int, config string")
