import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from meshwork.llm.anchors import segments
from meshwork.llm.bwt import prefix_intervals
from meshwork.llm.repeats import op3_suffix_array_dedup, remove_repeats


def brute(texts, length):
    counts = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if counts[hash(t[i : i + length])] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def test_over_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([(r.text or "").encode() for r in rows], 400), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_array_dedup(spark, d).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize("most_segments", [20_000, 1])
def test_passages_in_many_contexts(spark, most_segments):
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    passages = [noise(n) for n in (420, 700, 1500)]
    texts = [noise(rng.randrange(0, 300)) + rng.choice(passages)[rng.randrange(0, 60) :] + noise(rng.randrange(0, 300)) for _ in range(60)]
    texts += [noise(900) for _ in range(5)] + ["ab" * 600, "x" * 399, "y" * 400, "z" * 401, texts[0], texts[0], ""]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row_key int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(frame, most_segments=most_segments).collect()}
    want = brute([t.encode() for t in texts], 400)
    assert got == dict(enumerate(want))


def test_odd_rows(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(700_000))
    rows = [(1, None), (2, ""), (None, "q" * 1000), (3, long), (4, "head" + long[:300_000]), (5, "short"), (5, "short")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got}
    assert by == {1: (0, 0, 0), 2: (0, 0, 0), None: (1000, 1000, 1), 3: (700_000, 300_000, 1), 4: (300_004, 300_000, 1), 5: (5, 0, 0)}
    assert len(got) == len(rows)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefix_intervals_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(60):
        strings = [rng.integers(0, 3, rng.integers(0, 25)) for _ in range(rng.integers(1, 9))]
        text = np.concatenate([np.append(s + len(strings), k) for k, s in enumerate(strings)])
        for least in (1, 2, 5):
            order, interval = prefix_intervals(text, len(strings), least)
            suffixes = [tuple(text[i:]) for i in order]
            assert suffixes == sorted(suffixes)
            for i in range(1, len(order)):
                common = 0
                for a, b in zip(suffixes[i - 1], suffixes[i], strict=False):
                    if a != b or a < len(strings):
                        break
                    common += 1
                assert (interval[i] == interval[i - 1]) == (common >= least)


def test_segments_depend_on_windows_alone():
    rng = np.random.default_rng(1)
    core = rng.integers(0, 256, 3000).astype(np.uint8)
    texts = [core, np.concatenate([rng.integers(0, 256, 777).astype(np.uint8), core])]
    seen = []
    for t in texts:
        parts = [np.concatenate(x) for x in zip(*segments(t, np.array([0, len(t)]), 400), strict=True)]
        _, start, n, ahead, anchor, _ = parts
        assert n.sum() == len(t) - 399
        at = {int(s + k): (int(a), int(h) - k) for s, c, h, a in zip(start, n, ahead, anchor, strict=True) for k in range(c)}
        seen.append([at[len(t) - 3000 + i] for i in range(2601)])
    assert seen[0] == seen[1]
