"""Line deduplication: repeated runs of lines, by distributed prefix doubling.

A text is a sequence of line IDs (two hashes of a line, 128 bits). Doubling names runs: the name of
the run of 2n lines at a place is made of the names of the runs of n lines at it and n places on,
an equi-join on (text, place) that no hot line can skew. Sorted by their names of all lengths, places
are the suffix array of the line IDs; places of the same name are an interval of it whose common
prefix is at least as long as the name's run. A place whose name no other has is settled, and leaves.
Doubling goes on until no name repeats, from one line to `min_lines`, and from there to twice as
many each time; so every interval of these common prefixes is seen, however long.

The first place of an interval, by document and line, is its source; the others are copies of it. A
place takes the source of the longest interval in which it is a copy. Neighbouring places whose
sources are neighbours too belong to one maximal run, from the first of them to the end of the last
one's common prefix. Runs of copies are deleted, as ranges of lines.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import attach, discard, keyed, materialize, read_table

PLACE = ["doc_id", "row_key", "pos"]


def _intervals(runs: DataFrame, total: int) -> DataFrame:
    """The places whose name occurs again, with the first place of the name."""
    names = runs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*PLACE)).alias("source"))
    found = attach(runs, names.where(F.col("times") > 1), ["a", "b"], "times", total)
    return found.where(F.col("source").isNotNull()).drop("times")


def _copies(known: DataFrame, length: int) -> DataFrame:
    later = known.where(~F.struct(*PLACE).eqNullSafe(F.col("source")))
    return later.select("row_key", "pos", F.lit(length).alias("n"), F.col("source.row_key").alias("from_key"), F.col("source.pos").alias("from_pos"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return keyed(docs, F.col(id_col).alias("doc_id"), text.alias("text"))


def _maximal_runs(source: DataFrame, min_lines: int) -> DataFrame:
    """row_key, start, n_lines, from_key, from_start: maximal runs of lines that occur earlier, at from_start of
    the text from_key. Runs of a text may overlap where their sources differ."""
    lines = source.select("row_key", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    runs = lines.select("row_key", "doc_id", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"))
    runs = materialize(runs, "lines")
    total, length, levels = runs.count(), 1, []
    known = materialize(_intervals(runs, total), "runs1")
    discard(runs)
    while True:
        if length >= min_lines:
            levels.append((known, length))
        step = min(length, min_lines - length) if length < min_lines else length
        right = known.select("row_key", (F.col("pos") - step).alias("pos"), F.col("a").alias("c"), F.col("b").alias("d"))
        longer = known.drop("source").join(right, ["row_key", "pos"])
        longer = longer.select(*PLACE, F.xxhash64("a", "c").alias("a"), F.xxhash64(F.lit(1), F.col("b"), F.col("d")).alias("b"))
        before, known = known, materialize(_intervals(longer, total), f"runs{length + step}")
        if length < min_lines:
            discard(before)
        length += step
        if length >= min_lines and known.isEmpty():
            levels.append((known, length))
            break
    copies = reduce(DataFrame.unionByName, (_copies(k, n) for k, n in levels))
    longest = copies.groupBy("row_key", "pos").agg(F.max(F.struct("n", "from_key", "from_pos")).alias("x")).select("row_key", "pos", "x.*")
    order = Window.partitionBy("row_key").orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    follows = (before("pos") == F.col("pos") - 1) & (before("from_key") == F.col("from_key")) & (before("from_pos") == F.col("from_pos") - 1)
    marked = longest.withColumn("head", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("head").over(order))
    found = marked.groupBy("row_key", "run").agg(
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("n")).alias("end"), F.min_by("from_key", "pos").alias("from_key"), F.min("from_pos").alias("from_start")
    )
    out = materialize(found.select("row_key", "start", (F.col("end") - F.col("start")).alias("n_lines"), "from_key", "from_start"), "maximal")
    discard(*(k for k, _ in levels))
    return out


def _deleted(runs: DataFrame) -> DataFrame:
    """row_key, gone: the ranges (a, b) of deleted lines in order; ranges that touch are one."""
    order = Window.partitionBy("row_key").orderBy("start", "end")
    earlier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = runs.select("row_key", "start", (F.col("start") + F.col("n_lines")).alias("end"))
    ranges = ranges.withColumn("head", F.when(F.col("start") <= earlier, 0).otherwise(1)).withColumn("k", F.sum("head").over(order))
    ranges = ranges.groupBy("row_key", "k").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    return ranges.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gone"))


def _left(lines: Column, gone: Column) -> Column:
    """The lines between the ranges."""
    size = F.size(gone)
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1)["b"])
    end = lambda k: F.when(k == size, F.size(lines)).otherwise(F.get(gone, k)["a"])
    return F.flatten(F.transform(F.sequence(F.lit(0), size), lambda k: F.slice(lines, start(k) + 1, end(k) - start(k))))


def line_runs(docs: DataFrame, *, min_lines: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_lines, from_id, from_start: the maximal runs of at least min_lines lines that occur
    earlier, and where. Cases are those of line_dedup."""
    source = _lines(docs, id_col, text_col)
    ids = source.select("row_key", "doc_id")
    found = _maximal_runs(source, min_lines).join(ids, "row_key")
    return found.join(ids.select(F.col("row_key").alias("from_key"), F.col("doc_id").alias("from_id")), "from_key").select("doc_id", "start", "n_lines", "from_id", "from_start")


def line_dedup(docs: DataFrame, *, min_lines: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, n_runs, kept_text.

    A line is what newlines separate. A run of at least min_lines lines that occurs earlier (in a
    row with a smaller doc_id, or further up in the same row) is deleted, newlines included;
    n_runs counts the maximal stretches of deleted lines.

    Defined cases: a null text is the empty text, which is one empty line; rows without an
    identifier come first; rows that repeat an identifier come in the order of the table; blank
    lines are lines; texts with fewer lines than min_lines stay as they are; an empty table gives
    an empty table; other columns are not read, whatever their names.
    """
    if min_lines < 1:
        raise ValueError(f"min_lines must be at least 1, not {min_lines}")
    source = _lines(docs, id_col, text_col)
    gone = materialize(_deleted(_maximal_runs(source, min_lines)), "gone")
    rows = source.withColumn("lines", F.split("text", "\n", -1)).join(gone, "row_key", "left")
    kept = F.array_join(_left(F.col("lines"), F.col("gone")), "\n")
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda x, r: x + (r["b"] - r["a"]))
    return rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_runs"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, unnest(s) AS line, unnest(range(0, len(s))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), w AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER x || chr(10) || lead(line, 2) OVER x AS v
  FROM l WINDOW x AS (PARTITION BY doc_id ORDER BY pos)
), c AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY v ORDER BY doc_id, pos) AS k FROM w WHERE v IS NOT NULL) WHERE k > 1
), r AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM c, (SELECT unnest([0, 1, 2]) AS k)
), m AS (
  SELECT l.doc_id, l.pos, l.line, r.pos IS NOT NULL AS gone,
         lag(r.pos IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.pos) AS gone_before
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.pos = r.pos
)
SELECT doc_id, count(*) AS n_lines, CAST(coalesce(sum(CAST(gone AS BIGINT)), 0) AS BIGINT) AS n_removed,
       CAST(coalesce(sum(CAST(gone AND NOT gone_before AS BIGINT)), 0) AS BIGINT) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
