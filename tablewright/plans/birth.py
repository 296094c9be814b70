"""The domain pack of the birth registry: constants only. Other domains give their own."""

from __future__ import annotations

from datetime import date

from ..functions.binning import interval_number
from ..operators.acceptance import Budget, Criterion
from ..operators.filters import not_both
from ..operators.metrics import TwoWay
from ..operators.schema import ColumnSpec, TableSpec

INF = float("inf")

# Fixed values of the published registry release: schema, bounds, bins, weights, transformations, thresholds, epsilons.
SCHEMA = TableSpec(
    {
        "mother_age": ColumnSpec("bigint", 12, 60),
        "parity": ColumnSpec("bigint", 1, 24),
        "gestation_week": ColumnSpec("bigint", 17, 47),
        "is_female": ColumnSpec("boolean"),
        "date_of_birth": ColumnSpec("date"),
        "birth_weight": ColumnSpec("bigint", 200, 8200),
    }
)
BOUNDS = {"mother_age": (17, 46), "parity": (1, 11), "gestation_week": (28, 43), "is_female": (0, 1), "date_of_birth": (0, 365), "birth_weight": (1400, 4600)}
MIDPOINTS = {c: (a + b) / 2 for c, (a, b) in BOUNDS.items()}
EVALUATION_BINS = {
    "mother_age": [0, 25, 30, 35, INF],
    "birth_weight": [0, 2500, 4000, INF],
    "parity": [1, 2, 4, INF],
    "gestation_week": [0, 37, INF],
    "date_of_birth": list(range(0, 397, 31)),
    "is_female": [0, 1, 2],
}
TRANSFORMATIONS = {
    "is_female": {"type": "binary"},
    "mother_age": {"type": "continuous", "lower": 17, "upper": 45, "bins": [[17, 18, 20, 25, 30, 35, 40, 43, 45, 46], [17, 18, 20, 25, 30, 35, 37, 40, 43, 45, 46]], "unit_bins": True},
    "birth_weight": {"type": "continuous", "lower": 1400, "upper": 4500, "bins": [list(range(1400, 4700, 100))], "unit_bins": False},
    "parity": {"type": "continuous", "lower": 1, "upper": 11, "bins": [[1, 2, 4, 7, 11, 12]], "unit_bins": True},
    "gestation_week": {"type": "continuous", "lower": 28, "upper": 42, "bins": [[28, 29, 32, 34, 37, 42, 43]], "unit_bins": True},
    "date_of_birth": {"type": "datetime", "format": "%d/%m/%Y"},
}
WEIGHTS = {"mother_age": [0, 18, 20, 25, 30, 35, 37, 40, 43, INF], "birth_weight": 1 / 100, "date_of_birth": 1 / 14, "gestation_week": [0, 29, 32, 34, 37, 42, INF], "is_female": 100, "parity": 100}
ALPHAS = [1]
FACE_UP_TO = 6
OVERSAMPLING = 1.1
#: Not both: the first below its limit and the second above its own.
CONSTRAINTS = [("mother_age", 23, "parity", 6), ("mother_age", 20, "parity", 3), ("gestation_week", 29, "birth_weight", 2999), ("gestation_week", 34, "birth_weight", 3999)]


def constraints():
    """As conditions on interval columns; a column of plain numbers counts as intervals of one number."""
    return [not_both(a, interval_number(x)[0], b, interval_number(y)[1]) for a, x, b, y in CONSTRAINTS]


_WHO = ("mother_age", "parity", "is_female", "date_of_birth")
QUASI_SENSITIVE = [(_WHO, "birth_weight"), (_WHO, "gestation_week"), ((*_WHO, "gestation_week"), "birth_weight"), ((*_WHO, "birth_weight"), "gestation_week")]
_BY = [("birth_weight", c) for c in ("is_female", "parity", "gestation_week", "mother_age")] + [("gestation_week", c) for c in ("parity", "mother_age")] + [("parity", "mother_age")]
USER_ANALYSES = [TwoWay(m, t, by) for m in ("mean", "median", "mean-resize-by-second") for t, by in _BY]


def _mean(column: str) -> str:
    return f"(name = 'mean-resize-by-second/max/diff' AND target = '{column}') OR (name = 'mean' AND target = '{column}' AND `by` IS NULL)"


CRITERIA = [
    Criterion("utility/1way/max/frequencies/ratio/raw/val_pr_s", "utility", "name = '1way/max/frequencies/ratio/raw'", "val_pr_s", 1.4),
    Criterion("utility/123456way/max/frequencies/diff/raw/val_pr_s", "utility", "name = '123456way/max/frequencies/diff/raw'", "val_pr_s", 0.01),
    Criterion("utility/mean/parity/l_inf/val_pr_s", "utility", _mean("parity"), "val_pr_s", 0.3, False),
    Criterion("utility/mean/birth_weight/l_inf/val_pr_s", "utility", _mean("birth_weight"), "val_pr_s", 100, False),
    Criterion("utility/mean/gestation_week/l_inf/val_pr_s", "utility", _mean("gestation_week"), "val_pr_s", 1, False),
    Criterion("utility/lr/coef/error/diff/total/val_pr_s", "utility", "name = 'lr/coef/error/diff/total'", "val_pr_s", 30),
    Criterion("utility/lr/MAE/cross/1-by-2/val_pr_s", "utility", "name = 'lr/MAE/cross/1-by-2'", "val_pr_s", 5),
    Criterion("faithfulness/β/ɑ=1/val_pr_s", "faithfulness", "`ɑ` = 1 AND comparison = 'val_pr_s'", "β", 0.05),
    Criterion("privacy/face/unique/1/max", "privacy", "name = 'unique/1/max'", "value", 1),
    Criterion("privacy/face/k-anonymity/1/max", "privacy", "name = 'k-anonymity/1/max'", "value", 1),
]
BUDGET = Budget(0.3, 0.02, {"parity": 0.01, "birth_weight": 0.17, "gestation_week": 0.02}, 0.43, 0.04, 2)
REGULATOR = {
    "id": "moh", "epsilon": INF, "delta": 0, "model": "ID", "hparams": {},
    "transformations": {
        "is_female": [{"name": "binary"}],
        "date_of_birth": [{"name": "datetime", "format": "%d/%m/%Y", "resolution": "month"}],
        "mother_age": [{"name": "clipping", "lower": 18, "upper": 50}],
        "gestation_week": [{"name": "clipping", "lower": 25, "upper": 50}, {"name": "binning", "bins": [25, 40, 51]}],
        "parity": [{"name": "clipping", "lower": 1, "upper": 20}, {"name": "binning", "bins": [1, 2, 3, 4, 5, 6, 7, 8, 21]}],
        "birth_weight": [{"name": "clipping", "lower": 1000, "upper": 5000}, {"name": "resolution", "scale": 100}],
    },
    "categoricals": ["gestation_week", "parity"],
}


def example(spark, n: int = 1000, seed: int = 0):
    """Made-up births of one year, within the schema: for trying things out."""
    from pyspark.sql import functions as F

    u = lambda k: F.rand(seed + k)
    age = F.least(F.greatest(F.floor(30 + 5 * F.randn(seed)), F.lit(17)), F.lit(45)).cast("long")
    week = F.least(F.greatest(F.floor(39.5 + 1.8 * F.randn(seed + 1)), F.lit(28)), F.lit(42)).cast("long")
    weight = F.least(F.greatest(F.floor(3300 + 110 * (week - 39) + 400 * F.randn(seed + 2)), F.lit(1400)), F.lit(4499)).cast("long")
    parity = F.least(F.floor(1 + u(3) * (age - 14) / 6), F.lit(11)).cast("long")
    born = F.date_add(F.lit(date(2014, 1, 1)), F.floor(u(4) * 365).cast("int"))
    return spark.range(n).select(age.alias("mother_age"), parity.alias("parity"), week.alias("gestation_week"), (u(5) < 0.49).alias("is_female"), born.alias("date_of_birth"), weight.alias("birth_weight"))
