"""From raw documents to packed sequences: five stages, each by one of the operators.

toxicity → exact dedup → MinHash near-dedup → benchmark decontamination → best-fit packing

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared scratch folder and hands it to the next stage. The first four return the columns of
documents; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.decontamination import contamination
from meshwork.llm.exact_dedup import exact_dedup
from meshwork.llm.minhash import near_duplicates
from meshwork.llm.packing import pack_documents
from meshwork.llm.shared import materialize, numbered_files, read_table, with_key
from meshwork.llm.toxicity import fold, toxicity

#: Documents whose score is at least this are rejected.
TOXIC = 0.3
#: Folds of identifiers that the classifier may learn from; the last is left for measuring it.
LEARNT_FOLDS = (0, 1, 3)


#: The place of a row in the files of its table, as the operators count; no column of documents.
KEY = "_row_key_of_scan"


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose row_key is not in dropped."""
    keys = dropped.select(F.col("row_key").alias(KEY))
    return with_key(docs, KEY).join(keys, KEY, "left_anti").drop(KEY)


def _scanned(docs: DataFrame) -> DataFrame:
    """docs as a table of files, in which a row has the same number each time it is read."""
    return materialize(docs, "docs") if numbered_files(docs) is None else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is scored; those at TOXIC or above go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = tuple(F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(others))
    usable = fold(F.col("doc_id")).isin(*LEARNT_FOLDS)
    scored = toxicity(docs, read_table(spark, sf_dir, "labels"), usable, carried=carried, keep_text=True)
    places = {"doc_id": "doc_id", "text": "text"} | {c: f"carried_{i}" for i, c in enumerate(others)}
    return scored.where(F.col("score") < TOXIC).select(*(F.col(places[c]).alias(c) for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    docs = _scanned(docs)
    return _without(docs, exact_dedup(docs, carry_key=True).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on shingles of five words, the smallest doc_id stays."""
    docs = _scanned(docs)
    return _without(docs, near_duplicates(docs, words=5, percent=80, carry_key=True).where(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    docs = _scanned(docs)
    return _without(docs, contamination(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of at most 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: The classifier, the links and the packing have no SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
