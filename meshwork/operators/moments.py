"""Correlations in one or two passes, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.observations import as_doubles
from .order import running, with_values

#: Up to so many variables, all pairs are one aggregate of built-in functions; beyond, generated code
#: for the pairs grows too large for the JVM, and partial sums are made in Arrow batches.
BUILT_IN_UP_TO = 12


def _pair(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are present; null if either does not vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlations(df: DataFrame, names: list[str], *, method: str = "pearson", by: str | None = None) -> DataFrame:
    """([by,] i, j, node1, node2, r) for all pairs i < j, on rows where both are present."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"'{method}' is not a valid correlation method: pearson or spearman")
    keep = [by] if by else []
    rows = as_doubles(df, names, *keep)
    if method == "spearman":
        return _spearman(rows, names, by)
    if len(names) > BUILT_IN_UP_TO:
        return _wide_pearson(rows, names, by)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    wide = rows.groupBy(*keep).agg(*(_pair(F.col(names[i]), F.col(names[j])).alias(f"r_{i}_{j}") for i, j in pairs))
    return _long(wide, names, pairs, by)


def _long(wide: DataFrame, names: list[str], pairs: list[tuple[int, int]], by: str | None) -> DataFrame:
    rows = F.array(
        *(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(names[i]).alias("node1"), F.lit(names[j]).alias("node2"), F.col(f"r_{i}_{j}").alias("r")) for i, j in pairs)
    )
    return wide.select(*([by] if by else []), F.explode(rows).alias("x")).select(*([by] if by else []), "x.*")


def _wide_pearson(rows: DataFrame, names: list[str], by: str | None) -> DataFrame:
    """Sums of products per Arrow batch, shifted by the means so that nothing cancels, then summed."""
    p, keep = len(names), [by] if by else []
    centre = rows.agg(*(F.avg(n).alias(n) for n in names)).first()
    shift = np.array([centre[n] if centre[n] is not None else 0.0 for n in names])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(p, 1)
        total: dict = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            x = np.column_stack([table[n].to_numpy(zero_copy_only=False).astype(float) for n in names]) - shift
            label = np.array(table[by].to_pylist(), object) if by else np.zeros(len(x), object)
            for g in set(label.tolist()):
                y = x[[v == g for v in label]] if by else x
                here = ~np.isnan(y)
                y, m = np.where(here, y, 0.0), here.astype(float)
                part = np.stack([m.T @ m, y.T @ m, m.T @ y, (y * y).T @ m, m.T @ (y * y), y.T @ y])[:, i, j]
                total[g] = total.get(g, 0.0) + part
        for g, part in total.items():
            cols = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, part)]
            head = [pa.array([g] * len(i), type=batch.schema.field(by).type)] if by else []
            yield pa.RecordBatch.from_arrays(head + cols, names=[*keep, "i", "j", *"nabcde"])

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep)
    parts = rows.mapInArrow(sums, f"{kinds}i int, j int, n double, a double, b double, c double, d double, e double")
    s = parts.groupBy(*keep, "i", "j").agg(*(F.sum(k).alias(k) for k in "nabcde"))
    n, a, b, c, d, e = (F.col(k) for k in "nabcde")
    spread = F.sqrt(F.greatest(n * c - a * a, F.lit(0.0))) * F.sqrt(F.greatest(n * d - b * b, F.lit(0.0)))
    labels = F.array(*(F.lit(x) for x in names))
    return s.select(*keep, "i", "j", F.get(labels, F.col("i")).alias("node1"), F.get(labels, F.col("j")).alias("node2"), F.try_divide(n * e - a * b, spread).alias("r"))


def average_ranks(rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """rows with the named columns replaced by their average ranks within `by`, among values present.

    Ranks belong to values, not rows: values are counted (before any shuffle, so that a value that
    most rows have is one record a task), the counts are summed up in the order of the values, and
    the ranks are joined back. No task ranks all rows, nor all rows of one value.
    """
    total = rows.count()
    groups = {f"_g{k}": F.coalesce(F.col(b).cast("string"), F.lit("\x00")) for k, b in enumerate(by)}
    out = rows.withColumns(groups)
    for name in names:
        present = rows.where(F.col(name).isNotNull()).groupBy(*(g.alias(k) for k, g in groups.items()), F.col(name))
        counted = present.agg(F.count(F.lit(1)).alias("_size"))
        below = running(counted, name, F.col("_size"), "_below", tuple(groups), total)
        ranked = below.select(*groups, name, "_size", (F.col("_below") + (F.col("_size") + 1) / 2).alias(f"_rank_{name}"))
        out = with_values(out, ranked, [*groups, name], "_size", total)
    return out.select(*(F.col(f"_rank_{c}").alias(c) if c in names else F.col(c) for c in rows.columns))


def _spearman(rows: DataFrame, names: list[str], by: str | None) -> DataFrame:
    """Pearson's r of average ranks. Ranks are taken over rows where both variables are present; if
    no value is missing, those are the same rows for all pairs, and one ranking serves them all."""
    keep = [by] if by else []
    gaps = rows.agg(F.max(F.greatest(*(F.col(n).isNull() for n in names))).alias("g")).first().g
    if not gaps:
        return correlations(average_ranks(rows, names, keep), names, by=by)
    out = None
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            a, b = names[i], names[j]
            both = rows.select(*keep, a, b).dropna(subset=[a, b])
            ranked = average_ranks(both, [a, b], keep)
            one = ranked.groupBy(*keep).agg(_pair(F.col(a), F.col(b)).alias(f"r_{i}_{j}"))
            one = _long(one, names, [(i, j)], by)
            out = one if out is None else out.unionByName(one)
    return out


def matrix(table: DataFrame, p: int, by: str | None = None) -> np.ndarray | dict[str, np.ndarray]:
    """The p x p matrix (or one for each group) of a table of correlations; p² numbers, whatever the rows."""
    out: dict = {}
    for r in table.collect():
        m = out.setdefault(r[by] if by else None, np.eye(p))
        m[r.i, r.j] = m[r.j, r.i] = np.nan if r.r is None else r.r
    return out if by else out.get(None, np.eye(p))
