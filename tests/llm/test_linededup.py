import random

import pytest

from meshwork.llm.linededup import line_dedup, line_runs


def brute(docs, m):
    """docs in their order: (n_lines, n_removed, n_runs, kept)."""
    seen, out = set(), []
    split = [(t or "").split("\n") for t in docs]
    gone = [set() for _ in docs]
    for k, lines in enumerate(split):
        for i in range(len(lines) - m + 1):
            w = tuple(lines[i : i + m])
            if w in seen:
                gone[k] |= set(range(i, i + m))
            seen.add(w)
    for lines, g in zip(split, gone, strict=True):
        out.append((len(lines), len(g), sum(i - 1 not in g for i in g), "\n".join(x for i, x in enumerate(lines) if i not in g)))
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_against_brute_force(spark, m):
    rng = random.Random(m)
    docs = ["\n".join(rng.choice(["a", "b", "c", "", "é"]) for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    docs += [None, "", "\n\n\n", "a\nb\nc\n" * 40]
    rows = [(i, t, 1) for i, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pos int").repartition(5)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_text) for r in line_dedup(frame, min_lines=m).collect()}
    assert got == dict(enumerate(brute(docs, m)))


def test_repeated_rows_and_missing_ids(spark):
    t = "one\ntwo\nthree\nfour"
    rows = [(None, t), (1, t), (1, t), (2, "x\n" + t + "\ny" + "\nlong line " * 20000)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got if r.doc_id != 2) == [("1", 4), ("1", 4), ("None", 0)]
    assert [r.n_removed for r in got if r.doc_id == 2] == [4 + 19_999]


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_maximal_runs(spark):
    a = [f"line {k}" for k in range(300)]
    rng = random.Random(3)
    noise = [[rng.choice("abcd") for _ in range(30)] for _ in range(12)]
    texts = [a, ["x", *a[10:245], "y", *a[0:5]], ["z", *a[240:], *a[:2]], *noise]
    frame = spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = [tuple(r) for r in line_runs(frame, min_lines=3).collect()]
    assert {f for f in found if f[0] in (1, 2)} == {(1, 1, 235, 0, 10), (1, 237, 5, 0, 0), (2, 1, 60, 0, 240)}
    for doc, start, n, source, at in found:
        assert n >= 3 and (source, at) < (doc, start)
        assert texts[doc][start : start + n] == texts[source][at : at + n]
    covered = {(doc, start + k) for doc, start, n, _, _ in found for k in range(n)}
    removed = {r.doc_id: r.n_removed for r in line_dedup(frame, min_lines=3).collect()}
    assert removed == {k: sum(d == k for d, _ in covered) for k in range(len(texts))}


@pytest.mark.parametrize("m", [3, 4])
def test_runs_far_longer_than_the_least(spark, m):
    rng = random.Random(m)
    base = [rng.choice(["p", "q", "r"]) for _ in range(400)]
    docs = []
    for _ in range(25):
        i = rng.randrange(300)
        docs.append("\n".join(["s"] * rng.randrange(3) + base[i : i + rng.randrange(120)] + [rng.choice(["t", "u"])]))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_text) for r in line_dedup(frame, min_lines=m).collect()}
    assert got == dict(enumerate(brute(docs, m)))
