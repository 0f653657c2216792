"""What is made of bootstrap tables, as aggregates.

A statistics table has (boot_id, is_original, statistic, node1, node2, value) and maybe a group; a
correlations table has (proportion, statistic, boot_id, correlation).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _quantiles(x: str):
    return F.percentile(x, F.array(F.lit(0.025), F.lit(0.975)))


def summary(statistics: DataFrame, statistic: str, by: tuple[str, ...] = (), *, with_original: bool = True) -> DataFrame:
    """([by,] node1, [node2,] mean, sd, ci_lower, ci_upper, sample) of one statistic.

    sample is the value of the original network. with_original: whether it counts among the
    replicates, as it always has in this kind of summary.
    """
    keys = [*by, "node1", *(["node2"] if statistic == "edge" else [])]
    rows = statistics.where(F.col("statistic") == statistic)
    value = F.col("value") if with_original else F.when(~F.col("is_original"), F.col("value"))
    out = rows.withColumn("v", value).groupBy(*keys).agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), _quantiles("v").alias("q"), F.max(F.when(F.col("is_original"), F.col("value"))).alias("sample")
    )
    return out.select(*keys, "mean", "sd", F.get("q", F.lit(0)).alias("ci_lower"), F.get("q", F.lit(1)).alias("ci_upper"), "sample")


def stability_curve(correlations: DataFrame) -> DataFrame:
    """(statistic, proportion, mean, ci_lower, ci_upper)."""
    rows = correlations.where(F.col("correlation").isNotNull())
    out = rows.groupBy("statistic", "proportion").agg(F.avg("correlation").alias("mean"), _quantiles("correlation").alias("q"))
    return out.select("statistic", "proportion", "mean", F.get("q", F.lit(0)).alias("ci_lower"), F.get("q", F.lit(1)).alias("ci_upper"))


def cs_coefficient(correlations: DataFrame, threshold: float = 0.7, quantile: float = 0.05) -> DataFrame:
    """(statistic, cs): the largest share of cases that can go while the quantile of the correlations
    with the original stays at the threshold; 0 if none can."""
    rows = correlations.where(F.col("correlation").isNotNull())
    low = rows.groupBy("statistic", "proportion").agg(F.percentile("correlation", F.lit(quantile)).alias("low"))
    dropped = F.when(F.col("low") >= threshold, 1 - F.col("proportion"))
    return low.groupBy("statistic").agg(F.coalesce(F.max(dropped), F.lit(0.0)).alias("cs"))


def _larger(items: list[str]):
    """Partial counts, by pair of items, of replicates in which both are present, and the first is larger."""
    place = {x: k for k, x in enumerate(items)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        larger = np.zeros((len(items), len(items)), np.int64)
        both = np.zeros_like(larger)
        for batch in batches:
            for names, values in zip(batch.column("names").to_pylist(), batch.column("values").to_pylist(), strict=True):
                v = np.full(len(items), np.nan)
                v[[place[x] for x in names]] = [np.nan if x is None else x for x in values]
                here = ~np.isnan(v)
                both += here[:, None] & here
                with np.errstate(invalid="ignore"):
                    larger += v[:, None] > v
        i, j = np.triu_indices(len(items), 1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), larger[i, j], both[i, j])], names=["i", "j", "larger", "both"])

    return count


def difference_test(statistics: DataFrame, statistic: str, alpha: float = 0.05) -> DataFrame:
    """(item1, item2, p, significant) of all pairs of items, from their differences over replicates.

    p = 2 min(s, 1 - s), where s is the share of replicates in which item1 is larger. A replicate is
    one row of values; tasks count pairs over their replicates, and the counts are added up, so that
    what is shuffled doesn't grow with replicates times pairs.
    """
    name = F.concat_ws(" -- ", "node1", "node2") if statistic == "edge" else F.col("node1")
    rows = statistics.where((F.col("statistic") == statistic) & ~F.col("is_original")).select("boot_id", name.alias("item"), "value")
    items = sorted(r[0] for r in rows.select("item").distinct().collect())  # edges or nodes of one network
    wide = rows.groupBy("boot_id").agg(F.collect_list(F.struct("item", "value")).alias("x")).select(F.col("x.item").alias("names"), F.col("x.value").alias("values"))
    counts = wide.mapInArrow(_larger(items), "i int, j int, larger long, both long").groupBy("i", "j").agg(F.sum("larger").alias("larger"), F.sum("both").alias("both"))
    label = F.array(*(F.lit(x) for x in items)) if items else F.array().cast("array<string>")
    share = counts.where("both > 0").withColumn("s", F.col("larger") / F.col("both"))
    p = 2 * F.least(F.col("s"), 1 - F.col("s"))
    return share.select(F.get(label, F.col("i")).alias("item1"), F.get(label, F.col("j")).alias("item2"), p.alias("p"), (p < alpha).alias("significant"))


def replicate_matrix(statistics: DataFrame, statistic: str) -> DataFrame:
    """boot_id, and a column of values for each item of one statistic."""
    name = F.concat_ws(" -- ", "node1", "node2") if statistic == "edge" else F.col("node1")
    rows = statistics.where((F.col("statistic") == statistic) & ~F.col("is_original"))
    return rows.withColumn("item", name).groupBy("boot_id").pivot("item").agg(F.avg("value"))


def difference_matrix(pairs: DataFrame, value: str = "p") -> DataFrame:
    """item, and a column for each item: a difference test as a square."""
    both = pairs.select("item1", "item2", value).unionByName(pairs.select(F.col("item2").alias("item1"), F.col("item1").alias("item2"), value))
    return both.groupBy(F.col("item1").alias("item")).pivot("item2").agg(F.first(value))
