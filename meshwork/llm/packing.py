"""Hierarchical residual best-fit packing of token sequences.

1. Tokenise. Every document becomes token ids plus an end token; one that exceeds the capacity is
   cut into pieces, the first of which takes the remainder. Only the places, lengths and checksums
   of pieces go further, never texts or ids.
2. Deal the pieces at random into runs of a bounded number of pieces. Within a run, best-fit
   decreasing packs them into bins, and bins that are full but for `slack` tokens are emitted.
3. The other bins are items of the next round, in which `fan_in` times fewer runs are packed
   best-fit again, dealt anew; and so on up the tree, until one run is left, no bin is open, or so
   many bins are open that fewer runs would be larger than a run may be. An item of these rounds is
   a number and a fill, whatever pieces it holds; where bins went is a table, joined to the pieces once.

A run is what a task holds in memory, `run_items` items of a few numbers. Each round writes its
result to the shared scratch folder, so that a lost executor costs one round's tasks.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize, read_table, slices

#: The split pattern of byte-level BPE with the 50k vocabulary (fixed value of that tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_files() -> tuple[str, str]:
    """The two files of the 50k byte-level BPE: merge ranks, and the full tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@cache
def _encoder(ranks_file: str, json_file: str):
    """text -> the ids of the JSON file's tokenizer, without added special tokens at the ends.

    The rank file holds the same vocabulary and merges, and its encoder is four times as fast; texts
    it can't take (its pattern engine has a limit on runs of one kind of character) go to the JSON
    file's. The strings of the file's own special tokens are those tokens wherever they stand."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_file, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all") if any(s in text for s in special) else fast.encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # of the native code, which is no Exception
                raise
            if not slow:
                slow.append(Tokenizer.from_file(json_file))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes the remainder."""
    first = n - capacity * (math.ceil(n / capacity) - 1)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, files: tuple[str, str]) -> DataFrame:
    """bin (unique number), doc_id, piece, start, length, ids_crc32 of every piece."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*files)
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 1):
            row, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    row.append(k)
                    out.append((p, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            piece, start, length, crc = (np.array(x, np.int64) for x in zip(*out, strict=True))
            numbers = number + np.arange(len(row), dtype=np.int64)
            number += len(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers), batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc))],
                names=["bin", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tokenise, f"bin long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(fills: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: items in the given order, each into the fullest bin that takes it.

    Open bins are kept by the room they have; a bit set of the rooms that occur finds the best fit
    in a step or two, whatever the number of bins.
    """
    bins = np.empty(len(fills), np.int64)
    offsets = np.empty(len(fills), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    opened = 0
    sizes = fills.tolist()
    for i in order.tolist():
        size = sizes[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            target = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, target = capacity, opened
            opened += 1
        bins[i], offsets[i] = target, capacity - room
        left = room - size
        if left:
            by_room[left].append(target)
            rooms |= 1 << left
    return bins, offsets


def _pack_run(capacity: int, size: str):
    """The items of a run (bin, a size, ...) with the bin each goes into, its place there, and that bin's fill."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        numbers, fills = table["bin"].to_numpy(), table[size].to_numpy()
        order = np.lexsort((numbers, -fills))
        bins, place = best_fit(fills, order, capacity)
        name = np.empty(bins.max() + 1, np.int64)
        name[bins[order[::-1]]] = numbers[order[::-1]]  # the first item of a bin names it
        total = np.bincount(bins, fills).astype(np.int64)
        for column, values in (("into", name[bins]), ("offset", place), ("total", total[bins])):
            table = table.append_column(column, pa.array(values))
        yield from table.combine_chunks().to_batches()

    return pack


def _round(items: DataFrame, k: int, runs: int, capacity: int, size: str) -> DataFrame:
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields), "into long, offset long, total long"])
    dealt = items.repartition(runs, F.xxhash64(F.lit(k), "bin"))
    return materialize(dealt.mapInArrow(_pack_run(capacity, size), kinds), f"round{k}")


def pack_pieces(pieces: DataFrame, capacity: int, *, slack: int = 8, run_items: int = 100_000, fan_in: int = 8) -> DataFrame:
    """pieces (bin, length, ...) with the columns sequence_id and offset."""
    runs = max(1, math.ceil(pieces.count() / run_items))
    packed = last = _round(pieces, 0, runs, capacity, "length")
    moves = None  # bin -> the bin it is in by now, and where there
    for k in count(1):
        items = last.where((F.col("offset") == 0) & (F.col("total") < capacity - slack)).select(F.col("into").alias("bin"), F.col("total").alias("fill"))
        n = items.count()
        fewer = max(math.ceil(runs / fan_in), math.ceil(n / run_items))
        if not n or fewer >= runs:
            break
        runs, before = fewer, moves
        last = _round(items, k, runs, capacity, "fill")
        step = last.select("bin", "into", F.col("offset").alias("shift"))
        if moves is None:
            moves = step
        else:
            further = step.select(F.col("bin").alias("into"), F.col("into").alias("to"), F.col("shift").alias("more"))
            joined = moves.join(further, "into", "left")
            moves = materialize(joined.select("bin", F.coalesce("to", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0).cast("long"))).alias("shift")), "moves")
            discard(before)
    out = packed.drop("bin", "total").withColumnRenamed("into", "sequence_id")
    if moves is None:
        return out
    moved = moves.select(F.col("bin").alias("sequence_id"), "into", "shift")
    out = out.join(moved, "sequence_id", "left")
    offset = F.col("offset") + F.coalesce("shift", F.lit(0).cast("long"))
    return out.withColumns({"offset": offset, "sequence_id": F.coalesce("into", "sequence_id")}).drop("into", "shift")


def pack_documents(
    docs: DataFrame,
    *,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: tuple[str, str] | None = None,
    slack: int = 8,
    run_items: int = 100_000,
    fan_in: int = 8,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    start: the document's tokens before the piece; ids_crc32: CRC-32 of the piece's ids as
    little-endian unsigned 32-bit integers; offset: place in the sequence, gapless from 0.

    Defined cases: a null or empty text is the end token alone; null and repeated identifiers are
    packed like any others, each row by itself; very long texts are cut into as many pieces as it
    takes; the strings of special tokens are those tokens; ties go to the piece that comes
    first in the input; an empty table gives an empty table; other columns are not read, whatever
    their names.
    """
    pieces = token_pieces(docs, id_col, text_col, capacity, end_id, files or vocabulary_files())
    pieces = materialize(pieces, "pieces")
    packed = pack_pieces(pieces, capacity, slack=slack, run_items=run_items, fan_in=fan_in)
    discard(pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
