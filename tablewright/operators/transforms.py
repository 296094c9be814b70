"""Reversible column transforms: each forward step records the step that undoes it.

A step is a dict with a `name`. `forward` returns the coded table, the bounds of each column, the columns that are
categories (codes from 0), and for each column the steps back; `backward` folds those over a table of codes.
Everything but the checks is one projection. The checks are one aggregate over all columns, not a job each.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import clip, cut, half_even, interval_of

RESOLUTIONS = ("dayofyear", "week", "month")

#: Python's date patterns, as far as they are used, and Spark's.
PATTERNS = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%b": "MMM", "%B": "MMMM"}


@dataclass
class Coded:
    df: DataFrame
    bounds: dict[str, tuple[float, float]]
    categories: list[str]
    back: dict[str, list[dict]]


def spark_pattern(fmt: str) -> str:
    for k, v in PATTERNS.items():
        fmt = fmt.replace(k, v)
    return fmt


def date_code(c: Column, resolution: str) -> Column:
    """A date as a code from 0: day of the year, week that begins on Sunday (days before the first are week 0), month."""
    if resolution == "dayofyear":
        return F.dayofyear(c) - 1
    if resolution == "week":
        return F.floor((F.dayofyear(c) + 6 - (F.dayofweek(c) - 1)) / 7).cast("int")
    if resolution == "month":
        return F.month(c) - 1
    raise ValueError(f"resolution {resolution!r} is none of {RESOLUTIONS}")


def code_date(c: Column, resolution: str, year: int) -> Column:
    """A date in the middle of what a code stands for: the day, the week's Wednesday, the month's 15th."""
    first = date(year, 1, 1)
    days = (date(year + 1, 1, 1) - first).days
    start = F.lit(first)
    if resolution == "dayofyear":
        return F.date_add(start, clip(half_even(c) + 1, 1, days).cast("int") - 1)
    if resolution == "week":
        sunday = (7 - (first.weekday() + 1) % 7) % 7  # days from the first of January to the first Sunday
        into = 3 - (first.weekday() + 1) % 7  # to the Wednesday of the week that holds the first of January
        week = clip(half_even(c), 0, 53).cast("int")
        return F.date_add(start, F.when(week == 0, F.lit(into)).otherwise(F.lit(sunday + 3) + (week - 1) * 7).cast("int"))
    if resolution == "month":
        return F.make_date(F.lit(year), clip(half_even(c) + 1, 1, 12).cast("int"), F.lit(15))
    raise ValueError(f"resolution {resolution!r} is none of {RESOLUTIONS}")


def forward(df: DataFrame, steps: dict[str, list[dict]], categories: list[str] = (), check: bool = True) -> Coded:
    """Code all columns. ValueError if a column has no steps, a value lies outside its bins or bounds, a column
    stays without bounds, a binary column has not two values, or a date column spans more than a year."""
    missing = set(df.columns) - set(steps)
    if missing:
        raise ValueError(f"no steps for {sorted(missing)}")
    years = _years(df, steps)
    out: list[Column] = []
    bounds: dict[str, tuple[float, float]] = {}
    back: dict[str, list[dict]] = {}
    one_hot: dict[str, list[str]] = {}
    two_valued = [c for c in df.columns if any(s["name"] == "binary" for s in steps[c])]
    distinct = df.agg(*(F.count_distinct(c).alias(c) for c in two_valued)).first() if two_valued and check else {}
    for name in df.columns:
        c, bound, undo = F.col(name), None, []
        for step in steps[name]:
            kind = step["name"]
            if kind == "binary":
                if check and distinct[name] != 2:
                    raise ValueError(f"{name} has {distinct[name]} values, not two")
                c, bound = c.cast("int").cast("long"), (0, 1)
            elif kind == "clipping":
                c, bound = clip(c, step["lower"], step["upper"]), (step["lower"], step["upper"])
                undo.insert(0, dict(step))
            elif kind == "resolution":
                if bound is None:
                    raise ValueError(f"{name} has no bounds before its resolution")
                scale = step["scale"]
                c, bound = half_even(c / scale), (int(bound[0] // scale), int(-(-bound[1] // scale)))
                undo.insert(0, {"name": "rev_resolution", "scale": scale})
            elif kind == "binning":
                c, bound = cut(c, step["bins"]).cast("long"), (0, len(step["bins"]) - 2)
                # Clipped values are not to be clipped again on the way back: bins end where they end.
                undo = [{"name": "rev_binning", "bins": list(step["bins"])}, *(u for u in undo if u["name"] != "clipping")]
            elif kind == "datetime":
                parsed = F.to_date(c, spark_pattern(step["format"])) if dict(df.dtypes)[name] == "string" else c.cast("date")
                c = date_code(parsed, step["resolution"]).cast("long")
                bound = {"dayofyear": (0, 365), "week": (0, 53), "month": (0, 11)}[step["resolution"]]
                undo.insert(0, {"name": "rev_datetime", "resolution": step["resolution"], "year": years[name]})
            elif kind == "one_hot":
                if bound is None:
                    raise ValueError(f"{name} has no bounds before one-hot coding")
                one_hot[name] = [f"{name}#{k}" for k in range(int(bound[1]) - int(bound[0]) + 1)]
                undo.insert(0, {"name": "rev_one_hot", "first": int(bound[0]), "columns": one_hot[name]})
            else:
                raise ValueError(f"unknown step {kind!r}")
        if bound is None:
            raise ValueError(f"{name} stays without bounds")
        back[name], bounds[name] = undo, bound
        if name in one_hot:
            del bounds[name]
            for k, col in enumerate(one_hot[name]):
                out.append((c == int(bound[0]) + k).cast("long").alias(col))
                bounds[col] = (0, 1)
        else:
            out.append(c.alias(name))
    coded = df.select(*out)
    if check:
        bad = coded.agg(*(F.count_if(~F.coalesce(F.col(f"`{c}`").between(*bounds[c]), F.lit(False))).alias(c) for c in coded.columns)).first().asDict()
        bad = {k: v for k, v in bad.items() if v}
        if bad:
            raise ValueError(f"values outside their bins or bounds: {bad}")
    named = [x for c in categories for x in one_hot.get(c, [c])]
    if any(bounds[c][0] != 0 for c in named):
        raise ValueError("codes of categories start at 0")
    return Coded(coded, bounds, named, back)


def _years(df: DataFrame, steps: dict[str, list[dict]]) -> dict[str, int]:
    """The single year of each date column, in one aggregate."""
    cols = {}
    for name in df.columns:
        for s in steps[name]:
            if s["name"] == "datetime":
                c = F.to_date(name, spark_pattern(s["format"])) if dict(df.dtypes)[name] == "string" else F.col(name).cast("date")
                cols[name] = F.year(c)
    if not cols:
        return {}
    got = df.agg(*(F.struct(F.min(c), F.max(c)).alias(n) for n, c in cols.items())).first()
    for name in cols:
        if got[name][0] != got[name][1]:
            raise ValueError(f"{name} spans the years {got[name][0]} to {got[name][1]}")
    return {n: got[n][0] for n in cols}


def backward(df: DataFrame, back: dict[str, list[dict]]) -> DataFrame:
    """Undo all steps in one projection; columns in the order of `back`."""

    def undone(name: str, undo: list[dict]) -> Column:
        hot = next((u for u in undo if u["name"] == "rev_one_hot"), None)
        if hot:
            dummies = F.array(*(F.col(f"`{c}`").cast("double") for c in hot["columns"]))
            c = (F.array_position(dummies, F.array_max(dummies)) - 1 + hot["first"]).cast("long")
        else:
            c = F.col(name)
        for u in undo:
            if u["name"] == "clipping":
                c = clip(c, u["lower"], u["upper"])
            elif u["name"] == "rev_resolution":
                c = c * u["scale"]
            elif u["name"] == "rev_binning":
                c = interval_of(c, u["bins"])
            elif u["name"] == "rev_datetime":
                c = code_date(c, u["resolution"], u["year"])
        return c.alias(name)

    return df.select(*(undone(n, u) for n, u in back.items()))
