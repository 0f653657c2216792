"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become words, words become hashes of GRAM consecutive words, and of every window of
consecutive gram hashes the smallest is a fingerprint. Documents and benchmark items that share
`window` consecutive words share all grams of that stretch, so also its smallest, at the same
place of it: no shared window goes unseen. A hit of fingerprints gives a shift of the item against
the document; the shift is extended by comparing the words themselves, and every stretch of
`window` equal words marks those words of the document.

Items of fewer words than a window have no winnowing guarantee. Such an item's fingerprint is the
hash of all its words, looked up at every place of a document; what leaves the document's row is the
place and those few words. A length of short items is part of the plan only if such items exist.

Before fingerprints leave a document's row they are probed against a filter made of the
benchmark's fingerprints (three places each, of at least 32 times as many, MOST_PLACES at most; a
foreign hash passes with a chance under 1e-3). So a document that shares none costs one pass and no
shuffled row. The filter only saves work: if a very large benchmark fills it, more fingerprints go
to the join, and the result is the same.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keyed, materialize, read_table

GRAM = 5
#: Bytes of the largest filter, a constant of the plan.
MOST_PLACES = 1 << 19
SEPARATORS = r"[\x00-/:-`{-\x7F]+"
#: Kinds of fingerprints: of winnowed windows; other kinds are the numbers of words of short items.
WINNOWED = 0


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, SEPARATORS, -1), lambda w: w != "")


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1; nothing for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(w: Column) -> Column:
    return F.transform(_upto(F.size(w) - (GRAM - 1)), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(GRAM))))


def _winnowed(g: Column, span: int, keep=None) -> Column:
    """(kind, pos, hash) of the smallest of each `span` consecutive gram hashes that `keep` accepts."""
    least = lambda j: F.least(*(F.get(g, j + k) for k in range(span))) if span > 1 else F.get(g, j)
    windows = _upto(F.size(g) - (span - 1))
    if keep is not None:
        windows = F.filter(windows, lambda j: keep(least(j)))
    place = lambda j: (j + F.array_position(F.slice(g, j + 1, span), least(j)) - 1).cast("int")
    return F.array_distinct(F.transform(windows, lambda j: _print(WINNOWED, place(j), least(j))))


def _print(kind: int, pos: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), value.alias("hash"))


def _places(value: Column, places: int) -> list[Column]:
    return [F.pmod(F.shiftright(value, shift), F.lit(places)).cast("int") for shift in (0, 21, 42)]


def _filter_of(prints: DataFrame, kind: int, count: int):
    """A predicate on hashes, true for all `count` of that kind in prints.

    What comes to the driver are distinct places, MOST_PLACES at most."""
    places = min(MOST_PLACES, 1 << max(16, (32 * count - 1).bit_length()))
    rows = prints.where(F.col("kind") == kind).select(F.explode(F.array(*_places(F.col("hash"), places))).alias("p")).distinct()
    table = np.zeros(places, np.uint8)
    table[rows.toArrow()["p"].to_numpy()] = 1
    literal, one = F.lit(table.tobytes()), F.lit(b"\x01")

    def keep(value: Column) -> Column:
        found = [F.substring(literal, p + 1, 1) == one for p in _places(value, places)]
        return found[0] & found[1] & found[2]

    return keep


def _hash_at(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(n)))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: row_key, doc_id, n_words, n_hit, item_ids (sorted strings), contaminated.

    n_hit: words inside any occurrence of `window` consecutive words of an item (of all its words,
    if it has fewer). item_ids: the items of those windows.

    Defined cases: null and empty texts have no words, are never hit, and as items match nothing;
    items of equal words count each by its identifier, rows that repeat an identifier count as one
    item, a missing identifier as the text 'null'; rows that repeat a document are judged each by
    itself; an empty table of documents gives an empty table, an empty benchmark no hits; other
    columns are not read, whatever their names.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM} words")
    span = window - GRAM + 1
    # items of equal words are one entry of the index, however many they are
    entries = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("item_id"), words_of(F.col(item_text_col)).alias("iw"))
    entries = entries.where(F.size("iw") > 0).groupBy("iw").agg(F.collect_set("item_id").alias("ids"))
    entries = materialize(entries.select(F.monotonically_increasing_id().alias("entry"), "iw", "ids"), "entries")
    n, w = F.size("iw"), F.col("iw")
    whole = F.lit(0).cast("long")
    for k in range(1, window):
        whole = F.when(n == k, _hash_at(w, F.lit(0), k)).otherwise(whole)
    prints = entries.withColumn("g", _grams(w)).select(
        "entry", F.explode(F.when(n >= window, _winnowed(F.col("g"), span)).otherwise(F.array(F.struct(n.alias("kind"), F.lit(0).alias("pos"), whole.alias("hash"))))).alias("p")
    )
    prints = materialize(prints.select("entry", F.col("p.kind").alias("kind"), F.col("p.pos").alias("item_pos"), F.col("p.hash").alias("hash")), "prints")
    keep = {r.kind: _filter_of(prints, r.kind, r["count"]) for r in prints.groupBy("kind").count().collect()}  # window kinds at most

    rows = keyed(docs, F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("row_key", "doc_id", words_of(F.col("text")).alias("w"))
    w = F.col("w")
    nothing = F.array().cast("array<struct<kind:int,pos:int,hash:bigint>>")
    found, short = nothing, []
    if WINNOWED in keep:
        rows = rows.withColumn("g", _grams(w))  # a column, so that lambdas read it and don't make it again
        found = _winnowed(F.col("g"), span, keep[WINNOWED])
    for k in sorted(set(keep) - {WINNOWED}):
        at = F.filter(_upto(F.size(w) - (k - 1)), lambda i: keep[k](_hash_at(w, i, k)))  # noqa: B023
        short.append(F.transform(at, lambda i: F.struct(F.lit(k).alias("kind"), i.alias("pos"), _hash_at(w, i, k).alias("hash"), F.slice(w, i + 1, k).alias("words"))))  # noqa: B023
    listed = F.concat(*short) if short else F.array().cast("array<struct<kind:int,pos:int,hash:bigint,words:array<string>>>")
    rows = rows.withColumns({"prints": found, "short": listed})
    kept = F.when(F.size("prints") > 0, w)
    rows = materialize(rows.select("row_key", "doc_id", F.size("w").cast("long").alias("n_words"), "prints", "short", kept.alias("w")), "prints")

    seen = rows.where(F.size("prints") > 0).select("row_key", F.explode("prints").alias("p"))
    seen = seen.select("row_key", F.col("p.kind").alias("kind"), F.col("p.pos").alias("pos"), F.col("p.hash").alias("hash"))
    shifts = seen.join(prints, ["kind", "hash"]).select("row_key", "entry", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    pairs = shifts.join(rows.where(F.size("prints") > 0).select("row_key", "w"), "row_key").join(entries, "entry")
    w, iw, shift = F.col("w"), F.col("iw"), F.col("shift")
    pairs = pairs.withColumn("equal", F.transform(_upto(F.size(iw)), lambda i: F.coalesce(F.get(w, i + shift) == F.get(iw, i), F.lit(False))))
    pairs = pairs.withColumn("starts", F.filter(_upto(F.size(iw) - window + 1), lambda s: F.forall(F.slice("equal", s + 1, window), lambda x: x)))
    hit = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s + shift, s + shift + window - 1))))
    hits = pairs.where(F.size("starts") > 0).select("row_key", hit.alias("hit"), "ids")
    if short:
        seen = rows.where(F.size("short") > 0).select("row_key", F.explode("short").alias("p")).select("row_key", "p.*")
        pairs = seen.join(prints, ["kind", "hash"]).join(entries, "entry").where(F.col("words") == F.col("iw"))
        hits = hits.unionByName(pairs.select("row_key", F.sequence(F.col("pos"), F.col("pos") + F.col("kind") - 1).alias("hit"), "ids"))
    hits = hits.groupBy("row_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"),
    )
    out = rows.select("row_key", "doc_id", "n_words").join(hits, "row_key", "left")
    return out.select(
        "row_key",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[s : s + l - 1], ' ') AS v
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, l, p, array_to_string(w[p : p + l - 1], ' ') AS v
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)
), m AS (
  SELECT doc_id, p, l, item_id FROM dw JOIN iw USING (l, v)
), h AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM m) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
