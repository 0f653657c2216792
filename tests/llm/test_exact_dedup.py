import hashlib
from collections import defaultdict

import pytest

from meshwork.llm.exact_dedup import exact_dedup

ROWS = [
    (1, "a", "x"),
    (5, "a", "y"),
    (3, "a", None),
    (7, None, "x"),
    (8, "", "x"),
    (None, "b", "x"),
    (2, "b", "x"),
    (None, "c", "x"),
    (9, "d", "x"),
    (9, "d", "x"),
    (10, "é" * 70000, "x"),
    (11, "é" * 70000, "x"),
    (12, "A", "x"),
]


def expected(rows, largest=True):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = (max(known) if largest else (None if None in ids else min(known))) if known else None
        out.append((i, keep, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(spark, keep):
    # the extra column has the name of one that the operator makes itself
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string")
    got = exact_dedup(docs, keep=keep).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(
        expected(ROWS, keep == "largest"), key=key
    )
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_hot_group_over_many_partitions(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text").repartition(13)
    got = exact_dedup(docs).where("group_size > 1").collect()
    assert len(got) == 1000
    assert {r.keep_id for r in got} == {2997}
    assert [r.doc_id for r in got if r.kept] == [2997]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(docs).collect() == []
