import random
import re

import pytest

from meshwork.llm.decontamination import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    index = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            index.setdefault((k, tuple(w[s : s + k])), set()).add("null" if item is None else str(item))
    sizes = {k for k, _ in index}
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                found = index.get((k, tuple(w[p : p + k])))
                if found:
                    hit |= set(range(p, p + k))
                    ids |= found
        out.append((d, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, row_key int").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, entry int")
    got = contamination(d, i, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=str)


def test_random_texts_over_few_words(spark):
    rng = random.Random(5)
    text = lambda n, v: " ".join(rng.choice("abcdefgh"[:v]) for _ in range(n))
    items = [(i, text(rng.randrange(10, 30), 3)) for i in range(12)]
    docs = [(i, text(rng.randrange(0, 300), 3)) for i in range(60)]
    docs += [(100 + i, text(20, 8) + " " + items[i][1][4:60] + "!" + text(9, 8)) for i in range(12)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, window=7) == brute(docs, items, 7)


@pytest.mark.parametrize("sizes", [(1, 5), (5, 10), (1, 30)])
def test_short_items(spark, sizes):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["x", "y", "Z", "é", "w1"]) for _ in range(n))
    items = [(i, text(rng.randrange(*sizes))) for i in range(15)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = [(1, passage), (2, passage.upper()), (2, passage), (None, passage), (3, None), (4, ""), (5, "...")]
    docs = [(1, None), (2, ""), (3, passage), (3, passage), (None, "x " + passage.replace(" ", ", ")), (4, "é" * 100000 + " " + passage), (5, "no " * 50000), (6, passage[:-12])]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert [r[3] for r in got if r[0] == 4] == [["1", "2", "null"]]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f g h i j k")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [], False)]
    with pytest.raises(ValueError, match="window"):
        run(spark, [(1, "a b")], [], window=3)
