"""Communities of a Network, as (node, community), numbered by their smallest labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..kernels import graph
from ..network import Network, active


def renumbered(labels: tuple[str, ...], member: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order in which communities first appear among the sorted labels."""
    number: dict = {}
    for k in sorted(range(len(labels)), key=lambda k: labels[k]):
        number.setdefault(int(member[k]), len(number))
    return np.array([number[int(m)] for m in member])


def _weights(net: Network, absolute: bool) -> np.ndarray:
    w = np.abs(net.adjacency) if absolute else net.adjacency.copy()
    np.fill_diagonal(w, 0.0)
    return w


def _table(net: Network, member: np.ndarray) -> DataFrame:
    return active().createDataFrame([(x, int(c)) for x, c in zip(net.labels, renumbered(net.labels, member), strict=True)], "node string, community int")


def louvain(net: Network, *, resolution: float = 1.0, seed: int | None = None, absolute_weights: bool = True) -> DataFrame:
    return _table(net, graph.louvain(_weights(net, absolute_weights), resolution, seed))


def greedy_modularity(net: Network, *, absolute_weights: bool = True) -> DataFrame:
    return _table(net, graph.greedy_modularity(_weights(net, absolute_weights)))


def walktrap(net: Network, *, steps: int = 4, absolute_weights: bool = True) -> DataFrame:
    if net.directed:
        raise ValueError("walktrap is only defined for undirected networks")
    return _table(net, graph.walktrap(_weights(net, absolute_weights), steps))


METHODS = {"walktrap": walktrap, "louvain": louvain, "greedy_modularity": greedy_modularity}


def communities(net: Network, *, method: str = "walktrap", **kwargs) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"Unknown community detection method: {method!r}. Available: {', '.join(METHODS)}")
    return METHODS[method](net, **kwargs)
