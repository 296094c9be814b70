"""Binning, interval columns and weight scaling as Column expressions.

An interval is struct<lo double, hi double>, closed at lo and open at hi; hi may be infinite. An ordered category is its
code, from 0. Everything stays inside code generation: edges become a chain of comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def half_even(c: Column) -> Column:
    """Round halves to the even neighbour, as a long."""
    return F.rint(c.cast("double")).cast("long")


def clip(c: Column, lower, upper) -> Column:
    """Between the bounds; null stays null."""
    return F.when(c < lower, F.lit(lower)).when(c > upper, F.lit(upper)).otherwise(c)


def digitize(c: Column, edges: Sequence[float]) -> Column:
    """The number of edges at or below the value."""
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for n, edge in reversed(list(enumerate(sorted(edges), 1))):
        out = out.when(c >= F.lit(float(edge)), F.lit(n))
    return out.otherwise(F.lit(0))


def cut(c: Column, edges: Sequence[float]) -> Column:
    """The code of the left-closed bin, null outside the edges."""
    code = digitize(c, edges) - 1
    return F.when((code >= 0) & (code < len(edges) - 1), code)


def intervals(edges: Sequence[float]) -> Column:
    """All bins as an array of intervals."""
    return F.array(*(F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in zip(edges, edges[1:])))


def interval_of(code: Column, edges: Sequence[float]) -> Column:
    """The interval of a code; codes are rounded half to even and clipped to the bins."""
    return F.element_at(intervals(edges), (clip(half_even(code), 0, len(edges) - 2) + 1).cast("int"))


def interval_to_number(c: Column) -> Column:
    """The left end of an open or unit interval, else the midpoint."""
    lo, hi = c["lo"], c["hi"]
    return F.when((hi == float("inf")) | (hi - lo <= 1), lo).otherwise((lo + hi) / 2)


def interval_number(x: float) -> tuple[float, float]:
    """A number as an interval that holds it alone, closed on both sides."""
    return (float(x), float(x))


def is_interval(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == ["lo", "hi"]


def numerify(df: DataFrame) -> DataFrame:
    """Every column as a double: dates as day of the year from 1, intervals as numbers, booleans as 0 and 1."""

    def number(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.dayofyear(c)
        elif is_interval(f.dataType):
            c = interval_to_number(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif not isinstance(f.dataType, T.NumericType):
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} has no number")
        return c.cast("double").alias(f.name)

    return df.select(*map(number, df.schema.fields))


def round_quickly(c: Column, digits: int) -> Column:
    """Like F.round of a double to at most six digits, bit by bit, but decimal arithmetic is left to numbers near a tie, and
    to those of a million and more."""
    scale = 10.0**digits
    near = F.rint(c * scale)
    return F.when((F.abs(c) < 1e6) & (F.abs(c * scale - near) < 0.499), near / scale + 0.0).otherwise(F.round(c, digits))


def scale_by_weights(df: DataFrame, weights: dict[str, float | Sequence[float]]) -> DataFrame:
    """A number multiplies the column, a sequence of edges digitizes it; other columns pass."""

    def scaled(name: str) -> Column:
        w = weights.get(name, 1.0)
        if isinstance(w, bool) or not isinstance(w, (int, float)) and not _is_edges(w):
            raise TypeError(f"weight of {name} is neither a number nor edges")
        c = F.col(name)
        out = c * F.lit(float(w)) if isinstance(w, (int, float)) else digitize(c, w)
        return out.cast("double").alias(name)

    return df.select(*map(scaled, df.columns))


def _is_edges(w) -> bool:
    return not isinstance(w, str) and hasattr(w, "__len__")


def reconcile_edges(weights: Sequence[float], binning: Sequence[float]) -> list[float]:
    """Faithfulness edges that respect a column's bins.

    Outer edges become infinite. Weight edges inside one bin can't be told apart in binned data: they give way to
    two edges just inside that bin, so that the bin is a step of its own, and to the bin's right edge.
    """
    if len(weights) <= 3 or len(binning) <= 3:
        raise AssertionError("at least four edges are needed")
    stops = [-math.inf, *sorted(binning)[1:-1], math.inf]
    out: list[float] = []
    for w in [-math.inf, *sorted(weights)[1:-1], math.inf]:
        if w in stops:
            extra = [w]
        else:
            left, right = max(s for s in stops if s < w), min(s for s in stops if s > w)
            extra = [math.nextafter(left, math.inf), math.nextafter(right, -math.inf), right]
        out += [x for x in extra if x not in out]
    return out


def reconcile_weights(weights: dict, bins: dict[str, Sequence[float]], first_only: bool = False) -> dict:
    """Reconcile the weights of all binned columns; with first_only just those of the first column of weights."""
    out = dict(weights)
    for name in list(weights)[: 1 if first_only else None]:
        if name in bins and _is_edges(weights[name]):
            out[name] = reconcile_edges(weights[name], bins[name])
    return out
