"""Declared table schemas: checks in one pass, rejects as a table, numeric preparation both ways."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import clip, half_even, is_interval


@dataclass(frozen=True)
class ColumnSpec:
    """A column's type, and the range of its values, both ends included, if it has one."""

    kind: str
    lower: float | None = None
    upper: float | None = None


@dataclass(frozen=True)
class TableSpec:
    """Columns in order. The last one is the target of regressions."""

    columns: dict[str, ColumnSpec] = field(default_factory=dict)

    def check(self, name: str) -> Column:
        """Whether a row passes for this column; never null."""
        spec, c = self.columns[name], F.col(name)
        ok = c.isNotNull()
        if spec.kind in ("double", "float"):
            ok &= ~F.isnan(c)
        if spec.lower is not None:
            ok &= c.between(spec.lower, spec.upper)
        return F.coalesce(ok, F.lit(False))

    def without(self, *names: str) -> TableSpec:
        return TableSpec({k: v for k, v in self.columns.items() if k not in names})

    def updated(self, name: str, spec: ColumnSpec) -> TableSpec:
        return TableSpec({**self.columns, name: spec})


def violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row: how many rows break each column's check, as `bad_<column>`."""
    return df.agg(*(F.count_if(~spec.check(c)).alias(f"bad_{c}") for c in spec.columns))


def rejects(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The rows that break any check, with the names of the columns that do."""
    failed = F.filter(F.array(*(F.when(~spec.check(c), F.lit(c)) for c in spec.columns)), lambda x: x.isNotNull())
    return df.withColumn("failed", failed).filter(F.size("failed") > 0)


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls and NaNs of each column."""
    nan = lambda f: F.isnan(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.lit(False)
    return df.agg(*(F.count_if(F.col(f.name).isNull() | nan(f)).alias(f.name) for f in df.schema.fields))


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Exactly the declared columns, in order and cast; ValueError if a column is missing or extra."""
    if set(df.columns) != set(spec.columns):
        raise ValueError(f"columns {sorted(df.columns)} are not {sorted(spec.columns)}")
    return df.select(*(F.col(c).cast(s.kind).alias(c) for c, s in spec.columns.items()))


def validate(df: DataFrame, spec: TableSpec) -> DataFrame:
    """conform(), then raise ValueError with counts if a row breaks a check."""
    out = conform(df, spec)
    bad = {k: v for k, v in violations(out, spec).first().asDict().items() if v}
    if bad:
        raise ValueError(f"rows that break the schema: {bad}")
    return out


def categories_to_strings(df: DataFrame) -> DataFrame:
    """Interval columns as text."""
    text = lambda c: F.concat(F.lit("["), F.col(c)["lo"].cast("string"), F.lit(", "), F.col(c)["hi"].cast("string"), F.lit(")"))
    return df.select(*(text(f.name).alias(f.name) if is_interval(f.dataType) else F.col(f.name) for f in df.schema.fields))


def prepare(df: DataFrame) -> DataFrame:
    """Booleans as longs, numbers as doubles, dates as they are; other types raise TypeError."""

    def to(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return c.cast("int").cast("long").alias(f.name)
        if isinstance(f.dataType, T.NumericType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)):
            return c
        raise TypeError(f"{f.name}: {f.dataType.simpleString()}")

    return df.select(*map(to, df.schema.fields))


def restore(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Back to the declared types: booleans clipped to 0..1 and rounded, whole numbers rounded half to even."""

    def to(f: T.StructField) -> Column:
        c, kind = F.col(f.name), spec.columns[f.name].kind if f.name in spec.columns else None
        if kind == "boolean" and isinstance(f.dataType, T.NumericType):
            return (half_even(clip(c, 0, 1)) == 1).alias(f.name)
        if kind in ("int", "bigint", "long") and isinstance(f.dataType, T.NumericType):
            return half_even(c).alias(f.name)
        return c

    return df.select(*map(to, df.schema.fields))
