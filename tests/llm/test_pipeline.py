"""Every stage of the pipeline on what the stage before kept, against plain Python."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from meshwork.llm.toxicity import toxicity

from .test_decontamination import brute as hits
from .test_minhash import brute as near
from .test_packing import holds

D = "/root/testdata/sf0.01"


def stages(spark, docs, sf_dir, tmp_path, labels=None):
    """(name, rows in, rows out) of each stage, written and read again as on a cluster."""
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for k, (name, f) in enumerate(P.STAGES):
        out = f(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        yield name, docs.collect(), out.collect()
        docs = out


def follow(spark, docs, sf_dir, tmp_path):
    """Runs the stages and holds all but the first against plain Python; returns what each kept."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {}
    for name, given, got in stages(spark, docs, sf_dir, tmp_path):
        pairs = [(r.doc_id, r.text) for r in given]
        if name == "exact dedup":
            last = {}
            for i, text in pairs:
                last[text or ""] = max(last.get(text or "", i), i)
            want = set(last.values())
        elif name == "minhash near-dedup":
            want = {i for i, (_, c) in near(pairs, 5).items() if c == i}
        elif name == "benchmark decontamination":
            want = {r[0] for r in hits(pairs, items) if not r[4]}
        elif name == "best-fit packing":
            holds(got, pairs, lambda text: [*t.encode(text, add_special_tokens=False).ids, 2], 1024)
            continue
        else:
            want = {r.doc_id for r in got}
        assert sorted(r.doc_id for r in got) == sorted(want), name
        rows = {r.doc_id: r for r in given}
        assert all(tuple(r) == tuple(rows[r.doc_id]) for r in got), name
        kept[name] = want
    return kept


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = follow(spark, docs, D, tmp_path)
    scored = toxicity(docs, spark.read.parquet(f"{D}/labels.parquet"), P.fold(F.col("doc_id")) != 2).collect()
    assert kept["toxicity"] == {r.doc_id for r in scored if r.score < P.TOXIC}
    sizes = [docs.count(), *(len(v) for v in kept.values())]
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))


def test_run_gives_the_last_stage(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert rows
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_odd_rows_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, None), (1003, "x " * 40000), (1004, " \n")], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumns({c: F.lit(7) for c in ("score", "row_key", "kept", "digest", "n", "c0", "a.b")})
    kept = follow(spark, docs, D, tmp_path)
    assert {1002, 1003, 1004} <= kept["benchmark decontamination"]
    assert not {1000, 1001} & kept["exact dedup"]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty_table(spark, name, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "none"))
    assert dict(P.STAGES)[name](spark, spark.read.parquet(str(tmp_path / "none")), D).collect() == []


def test_null_identifiers_and_repeated_rows(spark, tmp_path):
    rows = [(None, "alpha beta"), (None, "alpha beta"), (5, "gamma delta"), (5, "gamma delta"), (6, None), (None, "epsilon")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    for _, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, D), "odd")
    assert sorted(map(str, docs.collect())) == sorted(["Row(doc_id=None, text='alpha beta')", "Row(doc_id=5, text='gamma delta')", "Row(doc_id=6, text=None)", "Row(doc_id=None, text='epsilon')"])
