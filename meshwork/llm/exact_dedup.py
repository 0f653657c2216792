"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition of the input turns its texts into digests. Runs of digests are then exchanged
between partitions in binomial rounds: the number of a run is a string of digits, and each round
replaces one digit of the place where a digest is now by that digit of the place where it belongs.
Within a run Spark sorts the digests (spilling sorted runs and merging them multiway) and a sort
aggregate keeps, for every digest, the row that stays and the number of rows it stands for. So a
group that holds a third of all rows is cut into many runs in the first round, and each later
round sees one row of it from each run.

Two texts count as equal when SHA-256, byte length and a second, independent hash agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach, keyed, materialize, read_table

DIGEST = ["digest", "n_bytes", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, doc_id, digest, n_bytes, check of every row, written to scratch: texts are read once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = keyed(docs, F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "row_key",
        "doc_id",
        F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("check"),
        F.spark_partition_id().cast("long").alias("run"),
    )
    return materialize(rows, "digests")


def merge_runs(rows: DataFrame, fan_in: int, levels: int, smallest: bool) -> DataFrame:
    """One row per digest: DIGEST, keep (doc_id and row_key of the row that stays), group_size."""
    pick = F.min if smallest else F.max
    places = fan_in**levels
    runs = rows.select(
        F.pmod("run", F.lit(places)).alias("run"),
        *DIGEST,
        F.struct("doc_id", "row_key").alias("keep"),
        F.lit(1).cast("long").alias("group_size"),
    )
    home = F.pmod(F.col("check"), F.lit(places))
    for level in range(levels):
        unit = fan_in**level
        digit = lambda x: F.floor(x / F.lit(unit)) % F.lit(fan_in)  # noqa: B023, E731
        moved = F.col("run") + (digit(home) - digit(F.col("run"))) * F.lit(unit)
        runs = (
            runs.withColumn("run", moved.cast("long"))
            .repartition("run")
            .groupBy("run", *DIGEST)
            .agg(pick("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        )
    return runs.drop("run")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "largest",
    fan_in: int = 8,
    carry_key: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: 'largest' or 'smallest' identifier of a group stays. carry_key: return row_key too, the
    place of the row in a scan of docs.

    Defined cases: a null text is the empty text; null identifiers are smaller than all others;
    rows that repeat both identifier and text count in group_size, and exactly one of them is
    kept; an empty table gives an empty table; other columns are not read, whatever their names.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    spark = docs.sparkSession
    rows = digests(docs, id_col, text_col)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in)
    levels = max(2, math.ceil(math.log(tasks, fan_in)))
    groups = merge_runs(rows, fan_in, levels, keep == "smallest").where(F.col("group_size") > 1)
    groups = materialize(groups, "groups")
    found = attach(rows, groups, DIGEST, "group_size", rows.count())
    single = F.col("keep").isNull()
    return found.select(
        *(["row_key"] if carry_key else []),
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("keep.row_key") == F.col("row_key"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
