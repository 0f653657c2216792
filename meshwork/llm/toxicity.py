"""Counterfactual-regularised toxicity classifier.

Features of a text are its distinct words and the four- and five-letter beginnings of them, hashed.
A logistic regression on the features that tell the classes apart is fitted to a bounded sample of
the labelled rows. Its loss has, beside the log-loss and an L2 term, a counterfactual term: in every
labelled sentence that names an identity, the term is swapped for each other term of its group, and
left out, and the squared change of the sentence's score is penalised. (Swaps among a group's terms
alone would let a whole group keep a score that toxic sentences gave to one of its terms.) As a sentence's score is a sum over words,
a swap changes it by the difference of the two words' weights, so the pairs of terms and their
counts, a table bounded by the list of terms, are all that the penalty needs from the corpus.

Fitting needs bounded memory on the driver (the sample's features); scoring is one pass over the
texts with the weights, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, settle, slices

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
WIDTH = 1 << 18

#: Terms that name groups of people. Within a group each term can stand for each other one.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "gender": ("woman", "man", "nonbinary", "transgender", "cisgender"),
    "gender_plural": ("women", "men"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    "religion": ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    "religion_plural": ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    "origin": ("african", "asian", "european", "american", "mexican", "arab", "indian", "chinese"),
    "colour": ("black", "white", "latino", "latina", "brown"),
    "ability": ("deaf", "blind", "disabled", "autistic"),
    "age": ("old", "young", "elderly", "teenage"),
    "gender_de": ("frau", "mann"),
    "gender_plural_de": ("frauen", "männer"),
    "religion_de": ("muslim", "christ", "jude", "hindu", "buddhist", "atheist"),
    "origin_de": ("afrikanisch", "asiatisch", "europäisch", "amerikanisch", "arabisch", "türkisch"),
    "age_de": ("alt", "jung"),
    "gender_fr": ("femme", "homme"),
    "gender_plural_fr": ("femmes", "hommes"),
    "religion_fr": ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    "origin_fr": ("africain", "asiatique", "européen", "américain", "arabe"),
    "age_fr": ("vieux", "jeune"),
    "gender_es": ("mujer", "hombre"),
    "gender_plural_es": ("mujeres", "hombres"),
    "religion_es": ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    "origin_es": ("africano", "asiático", "europeo", "americano", "árabe"),
    "age_es": ("viejo", "joven"),
}


def word_features(word: str) -> list[int]:
    """The features of a word; none of the empty word, which stands for a term left out."""
    if not word:
        return []
    data = word.encode()
    out = [zlib.crc32(b"w" + data) % WIDTH]
    for k in (4, 5):
        if len(word) >= k:
            out.append(zlib.crc32(b"%d" % k + word[:k].encode()) % WIDTH)
    return out


def text_features(text: str) -> np.ndarray:
    found = [f for w in set(WORD.findall(text.lower())) for f in word_features(w)]
    return np.array(found, np.int32)


def swaps(text: str, groups: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(term, other term of its group, or none) for every identity term of every sentence."""
    others: dict[str, set[str]] = {}  # a term may be of several groups, as languages share words
    for terms in groups.values():
        for t in terms:
            others.setdefault(t, set()).update(x for x in terms if x != t)
    out = []
    for sentence in SENTENCE.findall(text.lower()):
        for word in WORD.findall(sentence):
            if word in others:
                out += [(word, t) for t in ("", *sorted(others[word]))]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, most: int, groups: dict) -> tuple:
    """(labels, feature offsets, features, swap pairs with counts) of at most `most` labelled rows."""
    chosen = (
        labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            toxic, features, pairs = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                features.append(text_features(text or ""))
                pairs.append([f"{a} {b}" for a, b in swaps(text or "", groups)])
            yield pa.RecordBatch.from_arrays(
                [toxic, pa.array(features, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.string()))],
                names=["toxic", "features", "pairs"],
            )

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")  # `most` rows of two numbers at most
        .dropDuplicates(["doc_id"])  # one text each, however many rows repeat an identifier
        .select(F.col("toxic").cast("int"), "text")
        .mapInArrow(extract, "toxic int, features array<int>, pairs array<string>")
    )
    table = rows.toArrow().combine_chunks()
    y = table["toxic"].to_numpy().astype(np.float64)
    lists = table["features"].combine_chunks()
    names, counts = np.unique(np.array(table["pairs"].combine_chunks().flatten().to_pylist(), "U64"), return_counts=True)
    pairs = [(*n.split(" "), int(c)) for n, c in zip(names.tolist(), counts.tolist(), strict=True)]
    if not len(y):
        return y, np.zeros(1, np.int64), np.zeros(0, np.int32), pairs
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return y, offsets - offsets[0], lists.flatten().to_numpy(), pairs


def _parts(offsets: np.ndarray, features: np.ndarray, size: int = 512) -> Iterator[tuple]:
    """(first text, end, text of each feature from the first, features) of some texts at a time."""
    for a in range(0, len(offsets) - 1, size):
        b = min(a + size, len(offsets) - 1)
        yield a, b, np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), features[offsets[a] : offsets[b]]


def telling(y: np.ndarray, offsets: np.ndarray, features: np.ndarray, most: int, least_z: float) -> np.ndarray:
    """The features whose share of texts differs most between the classes (z of two proportions)."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    k1, k0 = np.zeros(WIDTH), np.zeros(WIDTH)
    for a, b, rows, f in _parts(offsets, features):
        once = np.unique(rows * np.int64(WIDTH) + f)  # a text counts once, however often it has the feature
        f, toxic = once % WIDTH, y[a:b][once // WIDTH]
        k1 += np.bincount(f, toxic, WIDTH)
        k0 += np.bincount(f, 1 - toxic, WIDTH)
    p = (k1 + k0) / (n1 + n0)
    z = np.abs(k1 / n1 - k0 / n0) / np.sqrt(np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12))
    best = np.lexsort((np.arange(WIDTH), -z))[:most]
    return best[z[best] >= least_z]


def minimise(value_and_gradient, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    s, t = [], []
    value, g = value_and_gradient(x)
    for _ in range(rounds):
        d = -g
        back = []
        for a, b in zip(reversed(s), reversed(t), strict=True):
            k = (a @ d) / (a @ b)
            back.append(k)
            d = d - k * b
        if s:
            d = d * ((s[-1] @ t[-1]) / (t[-1] @ t[-1]))
        for (a, b), k in zip(zip(s, t, strict=True), reversed(back), strict=True):
            d = d + a * (k - (b @ d) / (a @ b))
        slope, step = g @ d, 1.0
        if slope > -1e-12:
            break
        while True:
            new, ng = value_and_gradient(x + step * d)
            if new <= value + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        a, b = step * d, ng - g
        x, done = x + a, abs(value - new) < 1e-9 * max(1, abs(value))
        value, g = new, ng
        if a @ b > 1e-12:
            s, t = [*s, a][-memory:], [*t, b][-memory:]
        if done:
            break
    return x


def fit(
    y: np.ndarray,
    offsets: np.ndarray,
    features: np.ndarray,
    pairs: list[tuple[str, str, int]],
    *,
    most_features: int = 4096,
    least_z: float = 5.0,
    l2: float = 1e-5,
    counterfactual: float = 1.0,
    rounds: int = 100,
) -> np.ndarray:
    """Weights of the hashed features, with the bias at the end."""
    weights = np.zeros(WIDTH + 1)
    n1, n = y.sum(), len(y)
    if n1 in (0, n):  # one class, or nothing: a constant score
        weights[-1] = np.log((n1 + 0.5) / (n - n1 + 0.5))
        return weights
    named = {f for a, b, _ in pairs for w in (a, b) for f in word_features(w)}
    kept = np.unique(np.concatenate([telling(y, offsets, features, most_features, least_z), np.array(sorted(named), np.int64)]))
    place = np.full(WIDTH, -1)
    place[kept] = np.arange(len(kept))
    rows_of, places = [], []
    for a, _, r, f in _parts(offsets, features):
        f = place[f]
        rows_of.append((a + r[f >= 0]).astype(np.int32))
        places.append(f[f >= 0].astype(np.int32))
    rows, at = np.concatenate(rows_of), np.concatenate(places)
    left, right, count = [], [], []
    for a, b, c in pairs:
        change = np.zeros(len(kept))
        for w, sign in ((a, 1), (b, -1)):
            for f in word_features(w):
                change[place[f]] += sign
        left.append(change)
        count.append(c)
    swap, share = (np.array(left), np.array(count) / sum(count)) if left else (np.zeros((0, len(kept))), np.zeros(0))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], x[-1]
        z = np.bincount(rows, w[at], n) + b
        change = swap @ w
        value = np.mean(np.logaddexp(0, z) - y * z) + l2 / 2 * (w @ w) + counterfactual * (share @ change**2)
        r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        g = np.bincount(at, r[rows], len(kept)) + l2 * w + 2 * counterfactual * (swap.T @ (share * change))
        return value, np.append(g, r.sum())

    x = minimise(loss, np.append(np.zeros(len(kept)), np.log(n1 / (n - n1))), rounds)
    weights[kept], weights[-1] = x[:-1], x[-1]
    return weights


def score(docs: DataFrame, weights: np.ndarray, carried: tuple[Column, ...] = (), keep_text: bool = False) -> DataFrame:
    """doc_id, the carried columns, the text if it is to be kept, and the score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # WIDTH numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        bias, known = float(w[-1]), {}
        for batch in slices(batches, 0):
            out = np.empty(batch.num_rows)
            if len(known) > 300_000:
                known = {}
            for k, text in enumerate(batch.column(0).to_pylist()):
                z = bias
                if text:
                    for word in set(WORD.findall(text.lower())):
                        v = known.get(word)
                        if v is None:
                            v = known[word] = float(sum(w[f] for f in word_features(word)))
                        z += v
                out[k] = z
            scores = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            kept = [batch.column(0)] if keep_text else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *kept, pa.array(scores)], names=names)

    rows = docs.select(F.col("text").cast("string").alias("text"), "doc_id", *carried)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:] + rows.schema.fields[: int(keep_text)])
    names = [*rows.columns[1:], *rows.columns[: int(keep_text)], "score"]
    return rows.mapInArrow(run, f"{fields}, score double")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    *,
    most_rows: int = 12_000,
    counterfactual: float = 1.0,
    identity_terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS,
    carried: tuple[Column, ...] = (),
    keep_text: bool = False,
) -> DataFrame:
    """doc_id, score (0 to 1) of every row of docs, the carried columns and, if asked for, the text.

    usable: a condition on the columns of labels (doc_id, toxic) that says which may be learnt from.
    most_rows: bound of the training sample, the labelled rows with the smallest hashes of doc_id.

    Defined cases: null and empty texts score as the bias alone; labels that are null or neither 0
    nor 1 aren't learnt from; a document with both labels counts as toxic; rows with the same
    identifier are scored each by itself, and any one of them is learnt from; no labels at all, or one class of them, give a constant
    score; an empty table gives an empty table; other columns are not read, whatever their names.
    """
    sample = training_rows(docs, labels.select("doc_id", "toxic"), usable, most_rows, identity_terms)
    weights = fit(*sample, counterfactual=counterfactual)
    del sample
    settle(docs.sparkSession)
    return score(docs, weights, carried, keep_text)


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 4."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity(docs, labels, fold(F.col("doc_id")) != 2)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
