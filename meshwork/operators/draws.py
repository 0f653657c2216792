"""Resampling of tables of any size: how often each row counts in each replicate, and what the
replicates' correlations are, without a copy of the table anywhere.

Rows are numbered and cut into blocks of BLOCK rows. A task draws the row numbers of one replicate
from its seed, and hands out how often the rows of each block were drawn, a byte or a bit a row;
blocks of rows and of counts meet by their number. Draws depend on the seed and the number of rows
alone. Draws with replacement are counted CHUNK at a time, over SLAB rows at a time; a task that draws
without replacement holds 8 bytes for each row of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import active
from .order import numbered

BLOCK = 1 << 15
CHUNK, SLAB = 1 << 20, 1 << 28
#: Blocks whose sums are added up in one task at a time, and replicates that meet a block at a time.
ADDED, TOGETHER = 256, 1024


def drawn(rng: np.random.Generator, total: int, keep: int | None, block: int, chunk: int, slab: int) -> Iterator[tuple[int, bytes]]:
    """(number of a block, counts of its rows) of `keep` rows without replacement, as bits, or of `total` rows with it."""
    if keep is not None:
        chosen = np.zeros(total, bool)
        chosen[rng.choice(total, keep, replace=False)] = True
        for k in range(0, total, block):
            yield k // block, np.packbits(chosen[k : k + block]).tobytes()
        return
    start = rng.bit_generator.state
    for low in range(0, total, slab):
        rng.bit_generator.state = start  # the same draws again, for other rows
        counts = np.zeros(min(slab, total - low), np.uint8)
        for k in range(0, total, chunk):
            rows = rng.integers(0, total, min(chunk, total - k)) - low
            rows, times = np.unique(rows[(rows >= 0) & (rows < len(counts))], return_counts=True)
            if (counts[rows] + times > 255).any():
                raise OverflowError("a row was drawn more than 255 times")  # of n draws among n rows, that has no chance
            counts[rows] += times.astype(np.uint8)
        for k in range(0, len(counts), block):
            yield (low + k) // block, counts[k : k + block].tobytes()


def counted(raw: bytes, keep: int | None, size: int) -> np.ndarray:
    """The counts of a block as numbers."""
    x = np.frombuffer(raw, np.uint8)
    return (x if keep is None else np.unpackbits(x, count=size)).astype(float)


def drawings(tasks: list[tuple], sizes: dict) -> DataFrame:
    """(task, keep, group, block, batch, counts); a task is (number, seed, rows to keep or none). Groups are
    drawn from one after the other, in their order."""
    groups = sorted(sizes, key=lambda g: (g is not None, g))

    cut, together = (BLOCK, CHUNK, SLAB), TOGETHER

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples(index=False):
                rng, keep = np.random.default_rng(int(t.seed)), None if pd.isna(t.keep) else int(t.keep)
                for g in groups:
                    for block, counts in drawn(rng, sizes[g], keep, *cut):
                        yield pd.DataFrame({"task": [t.task], "keep": [t.keep], "group": [g], "block": [block], "batch": [t.task // together], "counts": [counts]})

    spark = active()
    parts = max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism))
    listed = [(t, s, None if keep is None else float(keep)) for t, s, keep in tasks]
    table = spark.createDataFrame(listed, "task long, seed long, keep double").repartition(parts)
    return table.mapInPandas(draw, "task long, keep double, group string, block long, batch long, counts binary")


def placed(rows: DataFrame, names: list[str], order: str | None, by: str | None) -> tuple[DataFrame, dict]:
    """(rows with their block and place in it, {group: rows}). Without an order rows are taken in that of
    a hash of their values; rows of the same hash are alike."""
    keep = [by] if by else []
    if order is None:
        rows, order = rows.withColumn("_order", F.xxhash64(*names)), "_order"
    sizes = {r[0] if by else None: r["count"] for r in (rows.groupBy(by).count() if by else rows.agg(F.count(F.lit(1)).alias("count"))).collect()}
    out = numbered(rows, order, "_at", tuple(keep), sum(sizes.values()))
    group = F.col(by) if by else F.lit(None).cast("string")
    return out.select(group.alias("group"), *names, F.expr(f"_at div {BLOCK}").alias("block"), (F.col("_at") % BLOCK).alias("_place")), sizes


def _meet(table: DataFrame, tasks: list[tuple], sizes: dict, work, kinds: str) -> DataFrame:
    """work(group, block, its rows in order, [(task, counts)]) for every block and batch of replicates."""
    batches = F.explode(F.array(*(F.lit(b).cast("long") for b in sorted({t[0] // TOGETHER for t in tasks}))))
    keys = [F.coalesce("group", F.lit("")).alias("_g"), "block", "batch"]

    def run(key, rows, counts):
        rows = rows.sort_values("_place", kind="stable")
        own = [(int(t.task), counted(t.counts, None if pd.isna(t.keep) else int(t.keep), len(rows))) for t in counts.itertuples(index=False)]
        return work(counts["group"].iloc[0], int(key[1]), rows, own)

    left = table.withColumn("batch", batches).groupBy(*keys)
    return left.cogroup(drawings(tasks, sizes).groupBy(*keys)).applyInPandas(run, kinds)


def replicate_sums(rows: DataFrame, names: list[str], order: str | None, tasks: list[tuple], by: str | None = None) -> tuple[DataFrame, dict]:
    """((task, group, sums), {group: rows}). sums is what Pearson's r of all pairs needs, over rows where
    both variables of a pair are present: weights, and weighted values, squares and products, as p x p
    matrices one after the other, of values less their means. A task and group has a row for every
    ADDED blocks, which sums_of adds up."""
    table, sizes = placed(rows, names, order, by)
    centre = rows.agg(*(F.avg(n).alias(n) for n in names)).first()
    shift = np.array([centre[n] or 0.0 for n in names])

    def block_sums(group, block: int, frame: pd.DataFrame, own: list) -> pd.DataFrame:
        x = frame[names].to_numpy(float) - shift
        here = ~np.isnan(x)
        x, m = np.where(here, x, 0.0), here.astype(float)
        out = []
        for _, w in own:
            xw, mw = (x * w[:, None]).T, (m * w[:, None]).T
            out.append(np.concatenate([(mw @ m).ravel(), (xw @ m).ravel(), ((x * x * w[:, None]).T @ m).ravel(), (xw @ x).ravel()]))
        return pd.DataFrame({"task": [t for t, _ in own], "group": group, "part": block // ADDED, "sums": out})

    def add(key, frame):
        found = sums_of(frame)
        return pd.DataFrame({"task": [t for t, _ in found], "group": [g for _, g in found], "sums": list(found.values())})

    kind = "task long, group string, sums array<double>"
    found = _meet(table, tasks, sizes, block_sums, kind.replace("sums", "part long, sums"))
    return found.groupBy(F.expr("task div 64"), "part").applyInPandas(add, kind), sizes


def sums_of(frame: pd.DataFrame) -> dict[tuple, np.ndarray]:
    """(task, group) -> sums, of rows of replicate_sums."""
    out: dict[tuple, np.ndarray] = {}
    for t in frame.itertuples(index=False):
        out[t.task, t.group] = out.get((t.task, t.group), 0.0) + np.asarray(t.sums, float)
    return out


def correlations_of(sums: np.ndarray, p: int) -> np.ndarray:
    """The p x p correlations of replicate_sums' sums; nan for a variable that doesn't vary."""
    n, s, q, xy = np.asarray(sums, float).reshape(4, p, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = xy - s * s.T / n
        var = np.maximum(q - s * s / n, 0.0)
        var = np.where(var > 1e-12 * np.maximum(q, 1e-300), var, 0.0)
        r = cov / np.sqrt(var * var.T)
    r[~np.isfinite(r)] = np.nan
    np.fill_diagonal(r, 1.0)
    return np.clip(r, -1.0, 1.0)


def replicate_rows(rows: DataFrame, names: list[str], order: str | None, tasks: list[tuple]) -> DataFrame:
    """(task, names): the rows of every replicate, each as often as it counts."""
    table, sizes = placed(rows, names, order, None)

    def repeated(group, block: int, frame: pd.DataFrame, own: list) -> pd.DataFrame:
        parts = [frame[names].loc[np.repeat(frame.index, w.astype(int))].assign(task=t) for t, w in own]
        return pd.concat(parts)[["task", *names]]

    kinds = ", ".join(["task long", *(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)])
    return _meet(table, tasks, sizes, repeated, kinds)
