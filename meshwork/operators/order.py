"""Order without one task that sorts all rows: numbers, running sums and predecessors of a column's order.

Rows are dealt to buckets, ranges of the ordering column whose bounds come from a sample. The bounds
are constants of the plan, so every plan over the same rows deals them alike; a sample that misses
the shape of the data makes uneven buckets and no other results. Equal values share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket is meant to hold, the most buckets, and the values a sample looks at.
BUCKET_ROWS, MOST_BUCKETS, SAMPLED = 250_000, 512, 20_000
#: A value that holds at least this share of all rows is hot: there are at most as many hot values.
#: Its rows are dealt to so many tasks.
HOT, SPREAD = 1000, 64


def bounds(rows: DataFrame, order: str, total: int | None = None) -> list:
    """Ascending upper bounds of all buckets but the last; none for tables of one bucket."""
    total = rows.count() if total is None else total
    count = min(MOST_BUCKETS, -(-total // BUCKET_ROWS))
    if count < 2:
        return []
    share = min(1.0, SAMPLED / total)
    found = rows.select(order).where(F.col(order).isNotNull()).sample(False, share, 1).orderBy(order).limit(4 * SAMPLED).collect()
    values = [r[0] for r in found]
    return sorted({values[len(values) * k // count] for k in range(1, count)}) if values else []


def bucket(order: str, cuts: list) -> Column:
    """The number of bounds below a row's value; nulls come first."""
    if not cuts:
        return F.lit(0)
    return F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(order))))


def _matched(keys: list[str]) -> Column:
    """Equality of keys, and of their copies with an underscore, nulls included."""
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return same


def running(rows: DataFrame, order: str, amount: Column, name: str, by: tuple[str, ...] = (), total: int | None = None) -> DataFrame:
    """rows with `name`: the sum of `amount` over all rows before, in the order of `order` within `by`.

    A row's sum is that of lower buckets plus that of earlier rows of its own.
    """
    cuts = bounds(rows, order, total)
    if not cuts:
        earlier = Window.partitionBy(*(by or (F.lit(0),))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # one bucket
        return rows.select("*", F.coalesce(F.sum(amount).over(earlier), F.lit(0).cast("long")).alias(name))
    placed = rows.withColumns({"_bucket": bucket(order, cuts), "_amount": amount})
    parts = placed.groupBy(*by, "_bucket").agg(F.sum("_amount").alias("_part"))
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # MOST_BUCKETS rows for each group
    before = parts.select(*(F.col(b).alias(f"_{b}") for b in by), F.col("_bucket").alias("__bucket"), F.coalesce(F.sum("_part").over(lower), F.lit(0)).alias("_before"))
    same = _matched([*by, "_bucket"])
    joined = placed.join(before if by else F.broadcast(before), same)  # without groups, MOST_BUCKETS rows
    earlier = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*rows.columns, (F.col("_before") + F.coalesce(F.sum("_amount").over(earlier), F.lit(0))).alias(name))


def numbered(rows: DataFrame, order: str, name: str, by: tuple[str, ...] = (), total: int | None = None) -> DataFrame:
    """rows with `name`: their numbers from 0 in the order of `order`, within `by`."""
    return running(rows, order, F.lit(1).cast("long"), name, by, total)


def predecessors(rows: DataFrame, order: str, columns: list[str], suffix: str) -> DataFrame:
    """rows with each column's value in the row before (column + suffix), and _first: whether there is none.

    Within a bucket the row before is a window's; a bucket's first row takes the last of the nearest
    lower bucket with rows, of which there is one each.
    """
    cuts = bounds(rows, order)
    if not cuts:
        whole = Window.partitionBy(F.lit(0)).orderBy(order)  # one bucket
        return rows.select("*", (F.row_number().over(whole) == 1).alias("_first"), *(F.lag(c).over(whole).alias(f"{c}{suffix}") for c in columns))
    placed = rows.withColumn("_bucket", bucket(order, cuts))
    last = placed.groupBy("_bucket").agg(F.max_by(F.struct(*columns), F.struct(order)).alias("_end"))
    ends = last.select(F.col("_bucket").alias("__bucket"), F.lag("_end").over(Window.orderBy("_bucket")).alias("_end"))  # MOST_BUCKETS rows
    within = Window.partitionBy("_bucket").orderBy(order)
    here = placed.select("*", (F.row_number().over(within) == 1).alias("_head"), *(F.lag(c).over(within).alias(f"{c}{suffix}") for c in columns))
    joined = here.join(F.broadcast(ends), _matched(["_bucket"]))
    out = [F.when(F.col("_head"), F.col("_end")[c]).otherwise(F.col(f"{c}{suffix}")).alias(f"{c}{suffix}") for c in columns]
    return joined.select(*rows.columns, (F.col("_head") & F.col("_end").isNull()).alias("_first"), *out)


def with_values(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows ⟕ a table of one row for each of their keys, where one key may have most rows.

    `size` counts a key's rows. The rows of keys with at least total / HOT rows, of which there are
    HOT at most, are dealt to SPREAD parts by a hash of the row, and the table's row goes to each.
    """
    extra = [c for c in table.columns if c not in (*keys, size)]
    hot = F.col(size) * HOT >= F.lit(total)
    many = table.where(hot).select(*keys, F.lit(True).alias("_many"))
    part = F.when(F.col("_many"), F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(many), keys, "left").withColumn("_part", part)
    parts = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copies = table.select(*keys, *extra, F.explode(parts).alias("_part"))
    return dealt.join(copies, [*keys, "_part"], "left").select(*rows.columns, *extra)
