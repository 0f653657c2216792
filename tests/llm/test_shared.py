import ctypes
import resource
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwork.llm.shared import attach, discard, is_scan, keyed, materialize, scratch_root, settle, slices, trim_native, utf8, with_key


def test_attach_gives_a_left_join_of_hot_and_cold_keys(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.where("k % 2 = 0").groupBy("k").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    got = attach(rows, groups, ["k"], "size", 30_000)
    want = rows.join(groups, "k", "left")
    assert got.exceptAll(want.select(got.columns)).isEmpty() and want.select(got.columns).exceptAll(got).isEmpty()


def test_row_keys_are_the_same_in_every_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert is_scan(docs.select("doc_id")) and not is_scan(docs.where("doc_id > 3").distinct())
    a = {(r.row_key, r.doc_id) for r in keyed(docs, F.col("doc_id")).collect()}
    b = {(r.row_key, r.doc_id) for r in keyed(docs, F.col("doc_id"), F.length("text").alias("n")).repartition(3).collect()}
    assert a == b and len({k for k, _ in a}) == len(a)


def test_row_keys_do_not_follow_the_number_of_cores(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.option("parquet.block.size", 1 << 20).parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))

    def keys(live_cores):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", live_cores)
        return docs.sparkSession.read.parquet(str(tmp_path / "d")).rdd.getNumPartitions(), dict(keyed(docs, F.col("doc_id")).select("doc_id", "row_key").collect())

    try:
        (tasks, six), (fewer, two) = keys(6), keys(2)
        carried = dict(with_key(docs, "k").select("doc_id", "k").collect())
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert tasks != fewer
    assert six == two == carried and len(set(six.values())) == len(six)


def test_row_keys_of_files_listed_twice(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "d"))
    twice = spark.read.parquet(str(tmp_path / "d"), str(tmp_path / "d"))
    got = keyed(twice, F.col("id")).collect()
    assert len(got) == twice.count() == len({r.row_key for r in got})


def test_materialize_and_discard(spark):
    kept = materialize(spark.range(10), "numbers")
    assert kept.count() == 10
    assert kept.scratch_path.startswith(scratch_root(spark))
    discard(kept, None)


def test_texts_of_batches():
    texts = ["a", None, "é" * 10, "", "xyz"]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["skipped", *texts], kind).slice(1)
        data, offsets = utf8(column)
        assert [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [t or "" for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(["ab"] * 10 + ["c" * 50])], names=["t"])
    parts = list(slices(iter([batch]), 0, 6))
    assert [p.num_rows for p in parts] == [3, 3, 3, 1, 1]


def resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize()


def test_settle_hands_back_what_the_c_library_holds_free(spark):
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim"):
        pytest.skip("not glibc")
    libc.malloc.restype, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
    places = [libc.malloc(4000) for _ in range(1 << 14)]
    for p in places:
        ctypes.memset(p, 1, 4000)
    last = places.pop()  # above the others, so that free() alone doesn't give them back
    for p in places:
        libc.free(p)
    held = resident()
    settle(spark)
    assert held - resident() > 40e6
    libc.free(last)


def test_trim_native_reaches_the_jvm(spark):
    """The JVM that the tests run on, 17 on glibc, has the command."""
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("not glibc")
    assert trim_native(spark)
