"""Pairs of consecutive rows, within subjects and scaled within subjects."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.observations import as_doubles
from .order import predecessors


def consecutive(beep: str | None, day: str | None, before) -> Column:
    """Whether a row follows the one before it: beeps one apart and, if given, the same day. before: a
    column's value in that row.

    Without beeps every row follows the one before it, whatever its day.
    """
    if beep is None:
        return F.lit(True)
    rule = (F.col(beep) - before(beep)) == 1
    return rule & (F.col(day) == before(day)) if day else rule


def lag_pairs(
    df: DataFrame,
    names: list[str],
    *,
    order_by: str,
    subject: str | None = None,
    beep: str | None = None,
    day: str | None = None,
    drop_empty: bool = False,
    suffix: str = "_lag",
) -> DataFrame:
    """([subject,] order_by, v, v_lag for every variable) of rows that follow the row before.

    drop_empty: rows without any value are dropped first, and don't stand between others.
    Subjects are dealt over tasks, a single series by ranges of its order.
    """
    keep = list(dict.fromkeys(c for c in (subject, order_by, beep, day) if c and c not in names))
    rows = as_doubles(df, names, *keep)
    if drop_empty:
        rows = rows.dropna("all", subset=names)
    if subject:
        window = Window.partitionBy(subject).orderBy(order_by)
        follows = consecutive(beep, day, lambda c: F.lag(c).over(window)) & (F.row_number().over(window) > 1)
        rows = rows.select("*", follows.alias("_follows"), *(F.lag(n).over(window).alias(f"{n}{suffix}") for n in names))
    else:
        seen = list(dict.fromkeys([*names, *(c for c in (beep, day) if c)]))
        rows = predecessors(rows, order_by, seen, suffix)
        follows = consecutive(beep, day, lambda c: F.col(f"{c}{suffix}")) & ~F.col("_first")
        rows = rows.withColumn("_follows", follows)
    out = list(dict.fromkeys([*([subject] if subject else []), order_by, *(x for n in names for x in (n, f"{n}{suffix}"))]))
    return rows.where("_follows").select(*out)


def warn_of_gaps(df: DataFrame, names: list[str], beep: str | None) -> None:
    """Dropped rows make pairs of rows that aren't neighbours, unless beeps tell them apart."""
    if beep is None:
        empty = as_doubles(df, names).where(F.coalesce(*(F.col(n) for n in names)).isNull())
        if not empty.isEmpty():
            warnings.warn("NaN rows were dropped; without a beep column, pairs may span gaps", UserWarning, stacklevel=3)


def within_subject_z(df: DataFrame, names: list[str], subject: str) -> DataFrame:
    """The variables as z-scores within subjects; centred alone where a subject doesn't vary."""
    w = Window.partitionBy(subject)
    rows = as_doubles(df, names, *(c for c in df.columns if c not in names))
    scaled = {}
    for n in names:
        centred, sd = F.col(n) - F.avg(n).over(w), F.stddev_samp(n).over(w)
        scaled[n] = F.when(sd > 0, centred / sd).otherwise(centred)
    return rows.withColumns(scaled).select(*df.columns)


def subject_means(df: DataFrame, names: list[str], subject: str) -> DataFrame:
    return as_doubles(df, names, subject).groupBy(subject).agg(*(F.avg(n).alias(n) for n in names))
