"""Centralities and shapes of networks held as long tables of weights.

A weights table has (i, j, node1, node2, weight), and any grouping columns. Undirected tables hold
each pair once, i < j; directed tables hold every entry of the matrix, the diagonal included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("strength", "expectedInfluence")
DIRECTED_MEASURES = ("inStrength", "outStrength", "inExpectedInfluence", "outExpectedInfluence")


def weight(r: Column, threshold: float = 0.0) -> Column:
    """r, zero where its size is under the threshold."""
    return F.when(F.abs(r) < threshold, F.lit(0.0)).otherwise(r) if threshold else r


def weights_of(correlations: DataFrame, threshold: float = 0.0) -> DataFrame:
    return correlations.withColumn("weight", weight(F.col("r"), threshold)).drop("r")


def edges(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """([by,] node1, node2, weight) of what is not zero; self-loops are not edges."""
    kept = weights.where((F.col("weight") != 0) & (F.col("i") != F.col("j")))
    return kept.select(*by, "node1", "node2", "weight")


def adjacency(weights: DataFrame, labels: list[str], directed: bool = False) -> DataFrame:
    """The labelled square matrix: node, and a column for each label."""
    rows = weights.select("node1", "node2", "weight")
    if not directed:
        rows = rows.unionByName(weights.select(F.col("node2").alias("node1"), F.col("node1").alias("node2"), "weight"))
    table = rows.groupBy(F.col("node1").alias("node")).pivot("node2", labels).agg(F.first("weight"))
    return table.select("node", *(F.coalesce(F.col(f"`{x}`"), F.lit(0.0)).alias(x) for x in labels))


def degrees(weights: DataFrame, directed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """([by,] node, strength, expectedInfluence and, if directed, their in and out forms).

    Row i of the matrix is what goes into node i, column j what goes out of node j; the totals of a
    directed network are in plus out, so that a diagonal entry counts twice.
    """
    rows = weights.select(*by, F.col("node1").alias("node"), F.lit(True).alias("into"), "weight").unionByName(
        weights.select(*by, F.col("node2").alias("node"), F.lit(False).alias("into"), "weight")
    )
    w, into = F.col("weight"), F.col("into")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = [zero(F.sum(F.abs(w))).alias("strength"), zero(F.sum(w)).alias("expectedInfluence")]
    if directed:
        out += [
            zero(F.sum(F.when(into, F.abs(w)))).alias("inStrength"),
            zero(F.sum(F.when(~into, F.abs(w)))).alias("outStrength"),
            zero(F.sum(F.when(into, w))).alias("inExpectedInfluence"),
            zero(F.sum(F.when(~into, w))).alias("outExpectedInfluence"),
        ]
    return rows.groupBy(*by, "node").agg(*out)


def modularity(edge_table: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, modularity, of undirected edges (node1, node2, weight) and members (node, community)."""
    size = F.abs("weight")
    a, b = (members.select(F.col("node").alias(n), F.col("community").alias(c)) for n, c in (("node1", "c1"), ("node2", "c2")))
    named = edge_table.join(a, "node1").join(b, "node2")
    inside = named.groupBy(F.col("c1").alias("c")).agg(F.sum(F.when(F.col("c1") == F.col("c2"), size).otherwise(0.0)).alias("inside"))
    ends = named.select(F.explode(F.array("c1", "c2")).alias("c"), size.alias("w"))
    table = ends.groupBy("c").agg(F.sum("w").alias("degree")).join(inside, "c", "left")
    total = edge_table.agg(F.sum(size).alias("m"))
    share = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.lit(resolution) * F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0))
    return table.join(F.broadcast(total)).agg(F.sum(share).alias("modularity"))  # one row


def renumber(members: DataFrame) -> DataFrame:
    """(node, community) with communities numbered from 0 by their smallest node."""
    first = members.withColumn("first", F.min("node").over(Window.partitionBy("community")))
    names = first.select("first").distinct()
    numbers = names.select("first", (F.dense_rank().over(Window.orderBy("first")) - 1).alias("number"))  # one row per community
    return first.join(numbers, "first").select("node", F.col("number").alias("community"))
