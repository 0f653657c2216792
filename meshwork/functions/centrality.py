"""Centralities of a Network, as DataFrames of (node, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..kernels import graph
from ..network import Network, active


def _table(net: Network, columns: dict[str, np.ndarray]) -> DataFrame:
    kinds = ", ".join(["node string", *(f"{c} double" for c in columns)])
    return active().createDataFrame([(x, *(float(v[k]) for v in columns.values())) for k, x in enumerate(net.labels)], kinds)


def _directed(net: Network, what: str) -> np.ndarray:
    if not net.directed:
        raise ValueError(f"{what} is only defined for directed networks")
    return net.adjacency


def values(net: Network, measure: str, normalized: bool = True) -> np.ndarray:
    a = net.adjacency
    if measure in ("strength", "expectedInfluence"):
        w = np.abs(a) if measure == "strength" else a
        return w.sum(1) + w.sum(0) if net.directed else w.sum(1)
    if measure in ("inStrength", "outStrength"):
        return np.abs(_directed(net, measure)).sum(1 if measure == "inStrength" else 0)
    if measure in ("inExpectedInfluence", "outExpectedInfluence"):
        return _directed(net, measure).sum(1 if measure == "inExpectedInfluence" else 0)
    if measure == "closeness":
        return graph.closeness(a, normalized)
    if measure == "betweenness":
        return graph.betweenness(a, normalized, net.directed)
    raise ValueError(f"Unknown centrality measure: {measure}")


ALWAYS = ("strength", "closeness", "betweenness", "expectedInfluence")
IF_DIRECTED = ("inStrength", "outStrength", "inExpectedInfluence", "outExpectedInfluence")


def strength(net: Network) -> DataFrame:
    return _table(net, {"strength": values(net, "strength")})


def in_strength(net: Network) -> DataFrame:
    return _table(net, {"inStrength": values(net, "inStrength")})


def out_strength(net: Network) -> DataFrame:
    return _table(net, {"outStrength": values(net, "outStrength")})


def expected_influence(net: Network) -> DataFrame:
    return _table(net, {"expectedInfluence": values(net, "expectedInfluence")})


def in_expected_influence(net: Network) -> DataFrame:
    return _table(net, {"inExpectedInfluence": values(net, "inExpectedInfluence")})


def out_expected_influence(net: Network) -> DataFrame:
    return _table(net, {"outExpectedInfluence": values(net, "outExpectedInfluence")})


def closeness(net: Network, *, normalized: bool = True) -> DataFrame:
    return _table(net, {"closeness": values(net, "closeness", normalized)})


def betweenness(net: Network, *, normalized: bool = True) -> DataFrame:
    return _table(net, {"betweenness": values(net, "betweenness", normalized)})


def centrality(net: Network, *, normalized: bool = True) -> DataFrame:
    measures = ALWAYS + (IF_DIRECTED if net.directed else ())
    return _table(net, {m: values(net, m, normalized) for m in measures})
