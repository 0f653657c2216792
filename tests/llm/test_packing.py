import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshwork.llm.packing import _encoder, best_fit, cut, pack_documents, pack_pieces, vocabulary_files


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 2]


def holds(rows, docs, encode, capacity):
    """Every id of every document is in its place, exactly once, and sequences have no gaps."""
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == {i for i, *_ in docs}
    for i, text, *_ in docs:
        ids = encode(text or "")
        mine = sorted(got[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in mine:
            assert r.start == at
            part = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            assert r.piece == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_fast_encoder_gives_the_ids_of_the_tokenizer(spark, reference):
    encode = _encoder(*vocabulary_files())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n\n  x", "a" * 30000, " " * 30000, "\n" * 5000 + "x", "<|endoftext|>", "a <|endoftext|> b", "x\n<|endoftext|><|endoftext|>  y<|endoftext|", "a" * 30000 + "<|endoftext|> b", "é́ 🙂🙂 ｆｕｌｌ", "1234567890" * 500, "it's we'll I'd'VE", "   x", "\0\x01"]
    for t in texts:
        assert [*encode(t), 2] == reference(t)


def test_round_trip(spark, reference):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 30000), (10**6 + 3, "a <|endoftext|> b")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, offset int").repartition(5)
    rows = pack_documents(frame, run_items=60).collect()
    sequences = holds(rows, docs, reference, 1024)
    tokens = sum(r.length for r in rows)
    assert len(sequences) <= 1.08 * -(-tokens // 1024)


def test_exact_capacity():
    assert cut(1024, 1024) == [(0, 1024)]
    assert cut(1025, 1024) == [(0, 1), (1, 1024)]
    assert cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_null_and_repeated_identifiers(spark):
    docs = spark.createDataFrame([(None, "x y"), (None, "x y"), (1, "x y"), (1, "x y")], "doc_id long, text string")
    rows = pack_documents(docs).collect()
    assert len(rows) == 4
    assert len({r.sequence_id for r in rows}) == 1
    assert sorted(r.offset for r in rows) == [0, 3, 6, 9]


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(0)
    fills = rng.integers(1, 101, 400)
    order = np.argsort(-fills, kind="stable")
    bins, offsets = best_fit(fills, order, 100)
    used = {}
    for i in order:
        fitting = [r for r in used.values() if r + fills[i] <= 100]
        before = used.get(int(bins[i]), 0)
        assert before == offsets[i]
        assert before == max(fitting, default=0)
        used[int(bins[i])] = before + int(fills[i])


def test_rounds_merge_underfull_bins(spark):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 1025, 4000)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "bin long, length long")
    rows = pack_pieces(pieces, 1024, run_items=100, fan_in=4).collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert sum(fill.values()) == sum(sizes)
    assert max(fill.values()) <= 1024
    assert len(fill) <= 1.05 * sum(sizes) / 1024
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():  # no gaps, whatever rounds a bin went through
        assert [a for a, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts)[:-1])]).tolist()


def test_bins_that_do_not_fit_together_stay(spark):
    pieces = spark.createDataFrame([(k, 600) for k in range(1000)], "bin long, length long")
    rows = pack_pieces(pieces, 1024, run_items=100, fan_in=4).collect()
    assert len({r.sequence_id for r in rows}) == 1000 and {r.offset for r in rows} == {0}
