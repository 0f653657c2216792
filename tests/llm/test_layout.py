"""Results don't follow how files are cut into tasks, though that changes between the plans of a query."""

import pytest

from meshwork.llm import decontamination, exact_dedup, linededup, minhash, repeats, shared

D = "/root/testdata/sf0.001"

OPERATORS = {
    "exact dedup": (exact_dedup, lambda d, b: exact_dedup.exact_dedup(d)),
    "repeats": (repeats, lambda d, b: repeats.remove_repeats(d)),
    "near-duplicates": (minhash, lambda d, b: minhash.near_duplicates(d)),
    "decontamination": (decontamination, lambda d, b: decontamination.contamination(d, b).drop("row_key")),
    "lines": (linededup, lambda d, b: linededup.line_dedup(d)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_layout_changes_between_plans(spark, tmp_path, monkeypatch, name):
    module, run = OPERATORS[name]
    whole = spark.read.parquet(f"{D}/documents.parquet")
    whole.repartition(2).write.option("parquet.block.size", 1 << 15).parquet(str(tmp_path / "d"))
    docs, items = spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(f"{D}/benchmark.parquet")
    want = sorted(map(repr, run(docs, items).collect()))
    cuts = []

    def moving(df, label):
        out = shared.materialize(df, label)
        spark.conf.set("spark.sql.files.minPartitionNum", 1 + 6 * (len(cuts) % 2))
        cuts.append(spark.read.parquet(str(tmp_path / "d")).rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "materialize", moving)
    try:
        assert sorted(map(repr, run(docs, items).collect())) == want
        assert len(set(cuts)) > 1
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
