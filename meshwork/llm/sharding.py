"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of a source are ranked in a seeded random order; a row's fractional rank is its rank over the
size of its source, less a seeded share of one step so that many small sources don't all fall on
the same value. In the order of fractional ranks every stretch holds the mixture of the sources,
so equal cuts of that order are shards that match it.

No step ranks a source, or all rows, in one task. A rank is the number of rows in smaller buckets
(a table of at most BUCKETS counts per source, and BUCKETS in all) plus the rank within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, read_table

#: Buckets of a random order, of 12 of a hash's 60 bits. A bucket of n rows holds about n / BUCKETS of them.
BUCKETS = 4096


def _stratum_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with the 0-based `rank` in their stratum and its size `n_source`."""
    keys = ["stratum", "bucket"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_bucket"))
    below = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *keys,
        F.coalesce(F.sum("in_bucket").over(below), F.lit(0).cast("long")).alias("before"),
        F.sum("in_bucket").over(Window.partitionBy("stratum")).alias("n_source"),
    )
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.join(counts, keys).withColumn("rank", F.col("before") + within).drop("before")


def _hash(digits: int, *parts: Column) -> Column:
    """A number of so many hex digits, which other engines can make as well."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, digits), 16, 10).cast("long")


def stratified_shards(
    docs: DataFrame,
    n_shards: int,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 0,
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, text_crc32, shard, slot.

    Law: row counts of shards differ by one at most. A source's counts in two shards differ by the
    rounding of all sources at the cuts, which doesn't grow with their rows. `size` is the bytes of the UTF-8 text plus 8, slot the
    place in the shard, gapless from 0.

    Defined cases: a null text has no bytes (size 8, CRC 0); a null source is a source of its own;
    null and repeated identifiers are placed like others (rows equal in identifier and text are
    interchangeable); fewer rows than shards leave shards empty; an empty table gives an empty
    table; other columns are not read, whatever their names.
    """
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    shuffled = _hash(15, F.lit(seed), F.col("doc_id"), F.col("size"))
    rows = rows.select(
        "*",
        F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("stratum"),
        shuffled.alias("h"),
        F.shiftright(shuffled, 48).alias("bucket"),
    )
    rows = materialize(rows, "rows")
    total = rows.count()
    tie = [F.col("h"), F.col("doc_id"), F.col("text_crc32")]
    ranked = _stratum_rank(rows, tie)
    offset = _hash(5, F.lit(seed), F.col("source").isNull(), F.coalesce("source", F.lit(""))) / F.lit(float(1 << 20))
    ranked = ranked.withColumn("fraction", (F.col("rank") + offset) / F.col("n_source"))
    ranked = ranked.withColumn("slice", F.least(F.floor(F.col("fraction") * BUCKETS), F.lit(BUCKETS - 1).cast("long")))
    order = [F.col("fraction"), F.col("stratum"), *tie]
    placed = _global_rank(ranked, "slice", order)
    shard = F.expr(f"(place * {n_shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("place") - first)
        .select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int"), F.col("slot").cast("long"))
    )


def _global_rank(rows: DataFrame, bucket: str, order: list[Column]) -> DataFrame:
    counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_in_bucket"))
    # one window over at most BUCKETS rows, whatever the input
    below = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(bucket, F.coalesce(F.sum("_in_bucket").over(below), F.lit(0).cast("long")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1
    return rows.join(F.broadcast(counts), bucket).withColumn("place", F.col("_before") + within).drop("_before")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = stratified_shards(read_table(spark, sf_dir, "documents"), 24)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: CRC-32 has no function there: its table is made by the rule, and bytes are folded in one by one.
OP2_SQL = """
WITH RECURSIVE b(k, j, c) AS (
  SELECT k, 0, k FROM (SELECT unnest(range(0, 256))::UINTEGER AS k)
  UNION ALL SELECT k, j + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM b WHERE j < 8
), t AS (SELECT list(c ORDER BY k) AS t FROM b WHERE j = 8),
d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UINTEGER) AS bytes
  FROM documents
), r AS (
  SELECT doc_id, source, size,
         xor(list_reduce(list_prepend(4294967295::UINTEGER, bytes), lambda c, x: xor(t[(xor(c, x) & 255)::INTEGER + 1], c >> 8)), 4294967295::UINTEGER) AS crc,
         ('0x' || substr(md5(concat_ws('|', '0', doc_id, size)), 1, 15))::BIGINT AS h,
         ('0x' || substr(md5(concat_ws('|', '0', CASE WHEN source IS NULL THEN 'true' ELSE 'false' END, coalesce(source, ''))), 1, 5))::BIGINT / 1048576.0::DOUBLE AS o
  FROM d, t
), k AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, crc) - 1 + o) / count(*) OVER (PARTITION BY source) AS f FROM r
), p AS (
  SELECT *, row_number() OVER (ORDER BY f, source IS NULL, coalesce(source, ''), h, doc_id, crc) - 1 AS place, count(*) OVER () AS n FROM k
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 24 // n AS INTEGER) AS shard,
       CAST(place - ((place * 24 // n) * n + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
