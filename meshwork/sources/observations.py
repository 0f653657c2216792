"""Observation tables: which columns are variables, and what a table must hold to be analysed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .datasets import ROW


def variables(df: DataFrame, exclude: Iterable[str] = (), *, allow_nan: bool = True) -> list[str]:
    """The analysed columns: all but the excluded and the row number, in their order."""
    left_out = {*exclude, ROW}
    names = [f.name for f in df.schema.fields if f.name not in left_out]
    if len(names) < 2:
        raise ValueError(f"at least 2 variables are needed, found {len(names)}")
    odd = [n for n in names if not isinstance(df.schema[n].dataType, (T.NumericType, T.BooleanType))]
    if odd:
        raise ValueError(f"all variables must be numeric; these are not: {', '.join(odd)}")
    if not allow_nan:
        gaps = as_doubles(df, names).agg(*(F.max(F.col(n).isNull()).alias(n) for n in names)).first()
        missing = [n for n in names if gaps[n]]
        if missing:
            raise ValueError(f"missing values (NaN) are not allowed; found in: {', '.join(missing)}")
    return names


def as_doubles(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """The named columns as doubles, NaN as null, and the kept columns as they are."""
    values = []
    for n in names:
        kind = df.schema[n].dataType
        x = F.col(n).cast("int").cast("double") if isinstance(kind, T.BooleanType) else F.col(n).cast("double")
        values.append(F.when(~F.isnan(x), x).alias(n))
    return df.select(*keep, *values)


def require(df: DataFrame, **columns: str | None) -> None:
    for role, name in columns.items():
        if name is not None and name not in df.columns:
            raise ValueError(f"{role} column '{name}' not found in the data")


def check_series(df: DataFrame, beep: str | None, day: str | None) -> list[str]:
    require(df, beep=beep, day=day)
    names = variables(df, [c for c in (beep, day) if c], allow_nan=False)
    if len(df.limit(2).collect()) < 2:
        raise ValueError("at least 2 timepoints are needed")
    return names


def check_panel(df: DataFrame, subject: str, beep: str | None, day: str | None) -> list[str]:
    require(df, subject=subject, beep=beep, day=day)
    names = variables(df, [c for c in (subject, beep, day) if c])
    counts = df.groupBy(subject).count()
    summary = counts.agg(F.count(F.lit(1)).alias("subjects"), F.min("count").alias("least")).first()
    if summary.subjects < 2:
        raise ValueError(f"at least 2 subjects are needed, found {summary.subjects}")
    if summary.least < 3:
        few = [str(r[0]) for r in counts.where("count < 3").orderBy(subject).limit(5).collect()]
        raise ValueError(f"subjects with fewer than 3 observations: {', '.join(few)}")
    return names
