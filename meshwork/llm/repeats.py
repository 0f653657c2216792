"""Repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

Wanted: every byte in a string of `length` bytes that also starts anywhere else.

1. Windows of `length` bytes are cut into segments by their anchors (see anchors.py). Equal windows
   have equal anchors, so windows are only compared within the segments of one anchor. Segments of
   equal bytes are counted once: their windows repeat, however many copies there are.
2. Distinct segments whose anchor has several go, as bytes, to the task of their anchor. There they
   become one text, whose symbols are blocks of BLOCK bytes counted from the anchor, and each ends
   with a separator of its own. Backward extension on the text's Burrows-Wheeler transform derives
   common prefixes by increasing value, and stops at the number of whole blocks that every window
   holds. What is in one interval then is equal but for the bytes before the first and after the
   last whole block; those are compared as they are.
3. Windows found to repeat become ranges of bytes, and ranges are cut out of the texts.

A task holds the segments of some anchors, TASK_BYTES on average. An anchor with more than
`most_segments` distinct segments (a passage in very many contexts) isn't given to one task: its
windows are dealt by their own hashes instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import gram_hashes, segments
from .bwt import prefix_intervals
from .shared import attach, discard, keyed, materialize, read_table, slices, spread, utf8

BLOCK = 16
TASK_BYTES = 2 << 20
SEGMENT = ["anchor", "content", "n", "ahead"]


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 20):
            keys = batch.column(1).to_numpy()
            for text, start, n, ahead, anchor, content in segments(*utf8(batch.column(0)), length):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[text]), pa.array(start), *(pa.array(x.astype(np.int32)) for x in (n, ahead)), pa.array(anchor), pa.array(content)],
                    names=["row_key", "start", "n", "ahead", "anchor", "content"],
                )

    return run


def _bytes_of(length: int):
    """(row_key, anchor, start, n, ahead, copies, bytes) of the segments listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            data, offsets = utf8(batch.column(0))
            lists = batch.column(2)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            parts = lists.flatten()
            start, n = parts.field("start").to_numpy(), parts.field("n").to_numpy()
            first = offsets[rows] + start
            raw = data.tobytes()
            texts = [raw[a : a + k] for a, k in zip(first.tolist(), (n + length - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(rows)), *(parts.field(c) for c in ("anchor", "start", "n", "ahead", "copies")), pa.array(texts, pa.binary())],
                names=["row_key", "anchor", "start", "n", "ahead", "copies", "bytes"],
            )

    return run


def repeated_windows(texts: list[bytes], n: np.ndarray, ahead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of the windows that occur more than once in texts of distinct segments.

    n: windows of each text; ahead: bytes from its start to its anchor. Equal windows have equal
    distances to their anchors, so blocks counted from the anchors match if windows do.
    """
    sizes = n + length - 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    skip = ahead % BLOCK  # bytes before the first whole block
    blocks = (sizes - skip) // BLOCK
    first = np.concatenate([[0], np.cumsum(blocks + 1)])  # place of a text's first symbol
    of = np.repeat(np.arange(len(texts)), blocks)
    rank = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(blocks)[:-1]]), blocks)
    at = offsets[of] + skip[of] + rank * BLOCK
    raw = data[at[:, None] + np.arange(BLOCK)].view(np.dtype("V16")).ravel()
    two = raw.view(np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        named = np.unique(spread(two[:, 0] * np.uint64(0x9E3779B97F4A7C15) + spread(two[:, 1])), return_inverse=True)[1]
    symbols = np.empty(first[-1], np.int64)
    ends = first[1:] - 1
    symbols[ends] = np.arange(len(texts))
    symbols[first[of] + rank] = named + len(texts)

    whole = (length - BLOCK + 1) // BLOCK  # blocks that every window holds
    order, interval = prefix_intervals(symbols, len(texts), whole)
    name = np.empty(len(symbols), np.int64)
    name[order] = interval

    text = np.repeat(np.arange(len(texts)), n)
    window = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    left = (skip[text] - window) % BLOCK  # bytes before the window's first whole block
    block = (window + left - skip[text]) // BLOCK
    begin = offsets[text] + window
    edge_bytes = length - whole * BLOCK
    step = np.arange(edge_bytes)
    # the bytes left of the whole blocks, then those right of them
    edge = data[begin[:, None] + step + np.where(step >= left[:, None], whole * BLOCK, 0)]
    pad = -edge_bytes % 8
    edge = np.ascontiguousarray(np.pad(edge, ((0, 0), (0, pad)))).view(np.uint64)
    keys = [name[first[text] + block], left, *edge.T]
    order = np.lexsort(keys)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    found = np.sort(order[again])
    return text[found], window[found]


def _by_transform(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        n, ahead = table["n"].to_numpy().astype(np.int64), table["ahead"].to_numpy().astype(np.int64)
        text, window = repeated_windows(table["bytes"].to_pylist(), n, ahead, length)
        lone = table["copies"].to_numpy()[text] == 1  # the windows of copied segments repeat anyway
        text, window = text[lone], window[lone]
        turn = np.ones(len(text), bool)
        turn[1:] = (text[1:] != text[:-1]) | (window[1:] != window[:-1] + 1)
        a = np.flatnonzero(turn)
        b = np.append(a[1:], len(text)) - 1
        start = table["start"].to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(table["row_key"].to_numpy()[text[a]]), pa.array(start[text[a]] + window[a]), pa.array(start[text[b]] + window[b] + length)] if len(text)
            else [pa.array([], pa.int64())] * 3,
            names=["row_key", "a", "b"],
        )

    return run


def _window_hashes(length: int):
    """(row_key, start, x, y, copies) of every single window; x and y are independent of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, at, n, copies, text in zip(*(batch.column(c).to_pylist() for c in ("row_key", "start", "n", "copies", "bytes")), strict=True):
                _, h = gram_hashes(np.frombuffer(text, np.uint8))
                x, y = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for k in [*range(0, length - 256, 256), length - 256]:  # every byte of a window is in one of these
                    part = h[k : k + n]
                    with np.errstate(over="ignore"):
                        x = spread(x * np.uint64(0x9E3779B97F4A7C15) + part)
                        y = spread(y + part * np.uint64(0xC2B2AE3D27D4EB4F))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row)), pa.array(at + np.arange(n)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(n, copies))],
                    names=["row_key", "start", "x", "y", "copies"],
                )

    return run


def _cut():
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left) of texts with their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            data, offsets = utf8(batch.column(0))
            raw, removed, spans, kept = data.tobytes(), [], [], []
            lists = batch.column(2)
            for k in range(batch.num_rows):
                text = raw[offsets[k] : offsets[k + 1]]
                ranges = lists[k].values
                if ranges is None or not len(ranges):
                    removed.append(0)
                    spans.append(0)
                    kept.append(text)
                    continue
                a, b = ranges.field("a").to_numpy(), ranges.field("b").to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))  # ranges that touch are one
                lo, hi = a[first], b[np.append(first[1:], len(a)) - 1]
                removed.append(int((hi - lo).sum()))
                spans.append(len(lo))
                kept.append(b"".join(text[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text", most_segments: int = 20_000
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept.

    Removed is every byte of the UTF-8 text that is covered by a string of `length` bytes which
    starts at another place too, of the same text or of another; matches don't cross texts.
    n_spans counts the maximal removed runs; kept is what is left, as bytes (a cut may split a
    character).

    Defined cases: a null text is the empty text; texts shorter than `length` are kept whole;
    rows that repeat one another are copies of each other, and removed in both; identifiers play
    no part; overlapping repeats within a text count; an empty table gives an empty table; other
    columns are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = keyed(docs, F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    long = source.where(F.octet_length("text") >= length)
    found = long.select("text", "row_key").mapInArrow(_segments(length), "row_key long, start long, n int, ahead int, anchor long, content long")
    found = materialize(found, "segments")

    distinct = found.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row_key", "start")).alias("place"))
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"), F.sum("copies").alias("all"))
    distinct = materialize(distinct.join(several.where(F.col("all") > 1), "anchor"), "distinct")
    copied = distinct.where(F.col("copies") > 1).select(*SEGMENT, "copies")
    whole = attach(found, copied, SEGMENT, "copies", found.count()).where(F.col("copies").isNotNull())
    whole = whole.select("row_key", F.col("start").alias("a"), (F.col("start") + F.col("n") + (length - 1)).alias("b"))

    compared = distinct.where(F.col("variants") > 1)
    lists = compared.groupBy(F.col("place.row_key").alias("row_key")).agg(
        F.collect_list(F.struct("anchor", F.col("place.start").alias("start"), "n", "ahead", "copies", "variants")).alias("parts")
    )
    parts = "row_key long, anchor long, start long, n int, ahead int, copies long, bytes binary"
    here = long.join(lists, "row_key")
    chosen = lambda rule: here.select("text", "row_key", F.filter("parts", rule).alias("parts")).mapInArrow(_bytes_of(length), parts)
    sums = compared.where(F.col("variants") <= most_segments).agg(F.sum(F.col("n") + length)).first()[0] or 0
    tasks = max(1, math.ceil(sums / TASK_BYTES))
    dealt = chosen(lambda p: p["variants"] <= most_segments).repartition(tasks, "anchor")
    ranges = dealt.mapInArrow(_by_transform(length), "row_key long, a long, b long")

    if compared.where(F.col("variants") > most_segments).isEmpty():
        rest = None
    else:
        single = chosen(lambda p: p["variants"] > most_segments).mapInArrow(_window_hashes(length), "row_key long, start long, x long, y long, copies long")
        single = materialize(single, "windows")
        names = single.groupBy("x", "y").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
        rest = attach(single, names, ["x", "y"], "times", single.count()).where(F.col("times").isNotNull() & (F.col("copies") == 1))
        rest = rest.select("row_key", F.col("start").alias("a"), (F.col("start") + length).alias("b"))
    marks = whole.unionByName(ranges) if rest is None else whole.unionByName(ranges).unionByName(rest)
    marks = materialize(marks.groupBy("row_key").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")
    discard(found, distinct)
    out = source.join(marks, "row_key", "left").select("text", "doc_id", "ranges")
    return out.mapInArrow(_cut(), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hex digits; windows of 400 bytes are compared by hash.
OP3_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 c AS (SELECT doc_id, k * 1000 AS o, substr(h, k * 2000 + 1, 2798) AS h, length(h) // 2 AS n FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS k FROM b)),
 w AS (SELECT doc_id, o + i AS pos, hash(substr(h, 2 * i + 1, 800)) AS v FROM (SELECT doc_id, o, h, unnest(range(0, least(1000, length(h) // 2 - 399))) AS i FROM c WHERE length(h) >= 800)),
 r AS (SELECT doc_id, pos FROM w JOIN (SELECT v FROM w GROUP BY v HAVING count(*) > 1) USING (v)),
 s AS (SELECT doc_id, pos, CASE WHEN pos > lag(pos) OVER x + 400 THEN 1 ELSE 0 END AS new FROM r WINDOW x AS (PARTITION BY doc_id ORDER BY pos)),
 g AS (SELECT doc_id, min(pos) AS a, max(pos) + 400 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM s) GROUP BY doc_id, g),
 k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM g),
 e AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM b LEFT JOIN e USING (doc_id)
"""
