"""Connected components: stars of bounded parts of the links, then alternating large and small stars."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, discard, materialize, settle


#: Links that a task turns into stars at once.
PART = 1 << 19


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of every end of the links that isn't that node itself."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = places[: len(u)], places[len(u) :]
    up = np.arange(len(nodes))
    while True:
        u, v = up[u], up[v]  # roots
        apart = u != v
        if not apart.any():
            break
        u, v = np.maximum(u, v)[apart], np.minimum(u, v)[apart]
        np.minimum.at(up, u, v)
        while (up[up] != up).any():
            up = up[up]
    hung = up != np.arange(len(nodes))
    return nodes[hung], nodes[up[hung]]


def _stars(part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, rows = [], 0

        def hang() -> pa.RecordBatch:
            ends = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*ends)], names=["u", "v"])

        for batch in batches:
            for start in range(0, batch.num_rows, part):
                piece = batch.slice(start, part)
                if rows + piece.num_rows > part:
                    yield hang()
                    got, rows = [], 0
                got.append(piece)
                rows += piece.num_rows
        if got:
            yield hang()

    return run


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v) with `m`, the smallest of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    least = least.select("u", F.least("u", "m").alias("m"), "degree")
    return attach(edges, least, ["u"], "degree", edges.count())


def components(links: DataFrame, part: int = PART) -> DataFrame:
    """(node, component) of every end of the links (a, b); component is the smallest node reachable.

    Tasks replace their links, `part` at a time, by stars with the same components. If what is left is
    `part` edges or fewer, one more such step ends it. Else every round hangs each node's larger
    neighbours, then all its smaller ones, on the smallest node it sees; rounds grow with the
    logarithm of the longest path. A hub's edges are spread over tasks. Rounds end when the edges are
    stars: every node has one edge up, to a node that has none.
    """
    ends = links.where(F.col("a") != F.col("b")).select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    first = materialize(ends.mapInArrow(_stars(part), "u long, v long"), "first")
    tasks = max(1, math.ceil(first.count() / part))
    whole = tasks == 1
    edges = first.coalesce(tasks).mapInArrow(_stars(part), "u long, v long")
    edges = materialize(edges if whole else edges.distinct(), "edges")
    discard(first)
    while not whole:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        pairs = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        small = _star(large).select(F.explode(F.array_distinct(F.array(F.col("u"), pairs))).alias("u"), F.col("m").alias("v"))
        small = materialize(small.where(F.col("u") != F.col("v")).distinct(), "small")
        discard(edges, large)
        settle(links.sparkSession)
        edges = small
        one = edges.groupBy("u").agg(F.count(F.lit(1)).alias("up")).where(F.col("up") > 1)
        whole = one.isEmpty() and edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.unionByName(roots)
