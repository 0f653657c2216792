import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from meshwork.llm.toxicity import fit, fold, op5_toxicity, text_features, toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op5_toxicity(spark, d).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    hits = sum(got[r.doc_id].predicted == r.toxic for r in held)
    # at this size 7 of 120 held-out toxic rows are junk texts without any word that tells their class
    assert hits / len(held) >= 0.98
    toxic = [r for r in held if r.toxic == 1]
    assert sum(got[r.doc_id].predicted for r in toxic) / len(toxic) >= 0.9


def train(rows, **options):
    y = np.array([t for _, t in rows], float)
    f = [text_features(x) for x, _ in rows]
    from meshwork.llm.toxicity import IDENTITY_TERMS, swaps

    counts = {}
    for x, _ in rows:
        for p in swaps(x, IDENTITY_TERMS):
            counts[p] = counts.get(p, 0) + 1
    pairs = [(a, b, c) for (a, b), c in sorted(counts.items())]
    return fit(y, np.cumsum([0, *map(len, f)]), np.concatenate(f), pairs, **options)


def probability(w, text):
    return 1 / (1 + np.exp(-(w[text_features(text)].sum() + w[-1])))


def test_counterfactual_term_spares_neutral_mentions():
    rng = random.Random(0)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(1200):
        body = rng.sample(words, 8)
        toxic = i % 4 == 0
        if toxic:
            body.append(rng.choice(["scum", "vermin"]))
        if rng.random() < (0.9 if toxic else 0.02):  # the term is mostly seen in toxic texts
            body.append("muslim")
        rows.append((" ".join(body), int(toxic)))
    neutral, swapped = "the muslim family word1 word2", "the buddhist family word1 word2"
    free, tied = train(rows, counterfactual=0.0), train(rows, counterfactual=10.0)
    gap = lambda w: abs(probability(w, neutral) - probability(w, swapped))
    assert gap(tied) < gap(free) / 4
    assert probability(tied, neutral) < probability(free, neutral)
    assert probability(tied, neutral) < 0.3
    assert probability(tied, "word1 scum word2") > 0.5


def test_counterfactual_term_lowers_false_positives_on_neutral_mentions():
    """Held-out sentences that mention a group: share of neutral ones called toxic, and of toxic ones found."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(60)]
    terms = ["muslim", "jewish", "gay", "lesbian", "musulman", "juif"]

    def sentences(n, mentioned):
        for i in range(n):
            body = rng.sample(words, 8)
            toxic = i % 4 == 0
            if toxic and rng.random() < 0.8:  # not every toxic sentence has a word that gives it away
                body.append(rng.choice(["scum", "vermin"]))
            if rng.random() < (0.9 if toxic else mentioned):
                body.append(rng.choice(terms))
            yield " ".join(body), int(toxic)

    rows, held = list(sentences(1600, 0.03)), list(sentences(1600, 1.0))
    called = {}
    for weight in (0.0, 10.0):
        w = train(rows, counterfactual=weight)
        flags = [(t, probability(w, x) >= 0.3) for x, t in held]
        called[weight] = (np.mean([f for t, f in flags if not t]), np.mean([f for t, f in flags if t]))
    assert called[10.0][0] < called[0.0][0] / 2, called
    assert called[10.0][1] > 0.7, called


def test_odd_rows(spark):
    docs = [(1, "you scum"), (2, "fine words"), (3, None), (4, ""), (None, "you scum"), (2, "other words"), (5, "scum " + "word " * 200000)]
    docs += [(100 + i, "bad scum here" if i % 2 else "nice day here") for i in range(60)]
    labels = [(100 + i, i % 2) for i in range(60)] + [(1, 1), (2, 0), (None, 1), (3, None), (4, 7)]
    frame = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity(frame, known, F.lit(True)).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[3] == by[4]
    assert min(by[1] + by[None] + by[5]) > 0.5 > max(by[2])


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity(docs, none, F.lit(True)).collect()} == {0.5}
    assert toxicity(docs.limit(0), none, F.lit(True)).collect() == []


def test_fold(spark):
    rows = spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)
