"""Correlations of a stream: each micro-batch adds its sums to a table of sums, so that the network at
any time costs one small aggregate. An extension; the batch operators do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.observations import as_doubles


def partial_sums(df: DataFrame, names: list[str]) -> DataFrame:
    """(i, j, n, a, b, c, d, e): counts and sums of each pair over rows where both are present."""
    rows = as_doubles(df, names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]

    def sums(i: int, j: int):
        x, y = F.col(names[i]), F.col(names[j])
        both = x.isNotNull() & y.isNotNull()
        part = lambda v: F.coalesce(F.sum(F.when(both, v)), F.lit(0.0))
        values = {"n": part(F.lit(1.0)), "a": part(x), "b": part(y), "c": part(x * x), "d": part(y * y), "e": part(x * y)}
        return F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *(v.alias(k) for k, v in values.items()))

    return rows.agg(F.array(*(sums(i, j) for i, j in pairs)).alias("x")).select(F.inline("x"))


def write_sums(stream: DataFrame, names: list[str], path: str, checkpoint: str):
    """A writer that keeps each batch's sums under its number; a batch that is retried replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        partial_sums(batch, names).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def correlations_of_sums(sums: DataFrame, names: list[str]) -> DataFrame:
    """(i, j, node1, node2, r) of a table of partial sums."""
    s = sums.groupBy("i", "j").agg(*(F.sum(k).alias(k) for k in "nabcde"))
    n, a, b, c, d, e = (F.col(k) for k in "nabcde")
    spread = F.sqrt(F.greatest(n * c - a * a, F.lit(0.0))) * F.sqrt(F.greatest(n * d - b * b, F.lit(0.0)))
    labels = F.array(*(F.lit(x) for x in names))
    return s.select("i", "j", F.get(labels, F.col("i")).alias("node1"), F.get(labels, F.col("j")).alias("node2"), F.try_divide(n * e - a * b, spread).alias("r"))
