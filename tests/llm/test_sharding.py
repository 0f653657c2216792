import zlib
from collections import Counter

from meshwork.llm.sharding import stratified_shards


def laws(got, rows, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, _, t in rows
    )
    counts = Counter(r.shard for r in got)
    sizes = [counts[s] for s in range(shards)]
    assert sum(sizes) == len(rows)
    assert max(sizes) - min(sizes) <= 1
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_mixture_and_sizes(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 50}", f"té{i}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    got = stratified_shards(docs, 24).collect()
    laws(got, rows, 24)
    hot = Counter(r.shard for r in got if r.source == "hot")
    # 51 sources round at each cut, which moves a cut by a few places of the common order
    assert max(hot.values()) - min(hot.values()) <= 6
    again = stratified_shards(docs.repartition(3), 24).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}
    other = stratified_shards(docs, 24, seed=1).collect()
    assert {(r.doc_id, r.shard) for r in got} != {(r.doc_id, r.shard) for r in other}


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "a", ""), (1, "a", "x"), (1, "a", "x"), (2, None, "y" * 300000), (3, "a", "é")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, shard int")
    laws(stratified_shards(docs, 4).collect(), rows, 4)
    laws(stratified_shards(docs, 24).collect(), rows, 24)


def test_many_small_sources_do_not_meet(spark):
    rows = [(i, f"s{i}", "t") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    laws(stratified_shards(docs, 24).collect(), rows, 24)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert stratified_shards(docs, 24).collect() == []
