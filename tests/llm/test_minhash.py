import random
import re

import numpy as np
import pytest

from meshwork.llm.components import components
from meshwork.llm.minhash import likely_similarity, merge, near_duplicates, op8_minhash_near_dedup, sketch
from meshwork.llm.shared import materialize

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, percent=80):
    """doc_id -> (size, component) from all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in docs]
    by, parent = {}, list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in by.get(x, ()):
                near[j] = near.get(j, 0) + 1
            by.setdefault(x, []).append(i)
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_all_pairs(spark, size):
    d = f"/root/testdata/{size}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op8_minhash_near_dedup(spark, d).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute(docs, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_dense_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = []
    for i in range(250):
        words = list(base)
        for j in rng.sample(range(150), rng.randrange(0, 9)):
            words[j] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(50))) for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for rounds in (0, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, words=4, rounds=rounds).collect()}
        assert got == brute(docs, 4)


def test_odd_rows(spark):
    docs = [(5, None), (4, ""), (3, " \t\n"), (9, "one two"), (8, "ONE\ttwo"), (7, "one two three"), (None, "one two"), (2, "É a b c d"), (1, "é a b c d")]
    docs += [(20, "long " * 100000), (21, "long " * 90000), (30, "r e p e a t"), (30, "r e p e a t")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, node int")
    got = sorted(near_duplicates(frame, words=4).collect(), key=str)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for i in (5, 4, 3) for r in by[i]] == [(0, 5, True), (0, 4, True), (0, 3, True)]
    assert by[9][0].component_id == by[8][0].component_id == by[None][0].component_id == 8
    assert not by[None][0].kept and by[8][0].kept
    assert by[7][0].component_id == 7
    assert by[1][0].component_id == 1 and by[2][0].component_id == 2
    assert by[21][0].component_id == 20 and by[20][0].n_shingles == 1
    assert len(by[30]) == 2 and all(r.kept for r in by[30])
    assert len(got) == len(docs)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = x[:2000], x[1000:]
    assert (merge(sketch(a), sketch(b)) == sketch(x)).all()
    assert abs(likely_similarity(sketch(a), sketch(b), 2000, 2000) - 1 / 3) < 0.12
    assert likely_similarity(sketch(a), sketch(a), 2000, 2000) > 0.99


def test_components_against_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(200)]
    parent = {x: x for e in links for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for e in links if e[0] != e[1] for x in e}


def test_components_of_parts(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i + 1, i) for i in range(1000, 1040)] + [(2100, 2000 + i) for i in range(50)]
    frame = spark.createDataFrame(links, "a long, b long")
    whole = {r.node: r.component for r in components(frame).collect()}
    assert {r.node: r.component for r in components(frame, part=20).collect()} == whole
    group = {x: {x} for e in links for x in e}
    for a, b in links:
        both = group[a] | group[b]
        group |= dict.fromkeys(both, both)
    assert whole == {x: min(group[x]) for a, b in links if a != b for x in (a, b)}
    assert components(frame.limit(0)).count() == 0


def test_components_of_few_links_take_few_jobs(spark):
    frame = materialize(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long"), "links")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        components(frame)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert len(jobs) <= 6
