"""Networks: small matrices with labels, and their tables as Spark DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHTS = "i int, j int, node1 string, node2 string, weight double"


def active() -> SparkSession:
    session = SparkSession.getActiveSession()
    if session is None:
        raise RuntimeError("no active Spark session")
    return session


@dataclass(frozen=True)
class EstimationInfo:
    """How a network was estimated."""

    method: str
    est_kwargs: dict = field(default_factory=dict)
    cor_matrix: np.ndarray | None = None
    selected_lambda: float | None = None
    selected_ebic: float | None = None
    curve: tuple[tuple[float, float], ...] = ()

    @property
    def lambda_ebic_curve(self) -> DataFrame | None:
        return active().createDataFrame(list(self.curve), "lambda double, ebic double") if self.curve else None


@dataclass(frozen=True)
class Network:
    """A weighted graph. adjacency[i, j] of a directed network is the effect of node j on node i."""

    adjacency: np.ndarray
    labels: tuple[str, ...]
    method: str
    n_observations: int
    weighted: bool = True
    signed: bool = True
    directed: bool = False
    estimation_info: EstimationInfo | None = None

    @property
    def n_nodes(self) -> int:
        return len(self.labels)

    @property
    def n_edges(self) -> int:
        return len(self._edge_rows())

    def weights(self) -> DataFrame:
        """(i, j, node1, node2, weight): pairs i < j, or the whole matrix if directed."""
        n = self.n_nodes
        pairs = [(i, j) for i in range(n) for j in range(n) if self.directed or i < j]
        rows = [(i, j, self.labels[i], self.labels[j], float(self.adjacency[i, j])) for i, j in pairs]
        return active().createDataFrame(rows, WEIGHTS)

    def _edge_rows(self) -> list[tuple[str, str, float]]:
        n = self.n_nodes
        pairs = [(i, j) for i in range(n) for j in range(n) if (i != j if self.directed else i < j)]
        return [(self.labels[i], self.labels[j], float(self.adjacency[i, j])) for i, j in pairs if self.adjacency[i, j] != 0]

    @property
    def edges_df(self) -> DataFrame:
        """(node1, node2, weight), of the same columns if there are none."""
        return active().createDataFrame(self._edge_rows(), "node1 string, node2 string, weight double")

    @property
    def adjacency_df(self) -> DataFrame:
        """node, and a column for each label."""
        kinds = ", ".join(["node string", *(f"`{x}` double" for x in self.labels)])
        return active().createDataFrame([(x, *map(float, row)) for x, row in zip(self.labels, self.adjacency, strict=True)], kinds)

    def centrality(self, *, normalized: bool = True) -> DataFrame:
        from .functions.centrality import centrality

        return centrality(self, normalized=normalized)

    def communities(self, method: str = "walktrap", **kwargs) -> DataFrame:
        from .functions.community import communities

        return communities(self, method=method, **kwargs)

    def plot(self, **kwargs):
        from .plotting import plot_network

        return plot_network(self, **kwargs)

    def plot_communities(self, method: str = "walktrap", **kwargs):
        from .plotting import plot_community

        return plot_community(self, method=method, **kwargs)

    def to_networkx(self):
        """A networkx graph of the edges (needs networkx)."""
        import networkx as nx

        graph = nx.DiGraph() if self.directed else nx.Graph()
        graph.add_nodes_from(self.labels)
        graph.add_weighted_edges_from(self._edge_rows())
        return graph


def _tagged(networks: dict[str, Network], tag: str, table) -> DataFrame:
    out = None
    for name, net in networks.items():
        one = table(net).withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class GroupNetwork:
    """One network per group, estimated together."""

    networks: dict[str, Network]
    lambda1: float
    lambda2: float
    penalty: str
    criterion: str

    @property
    def group_labels(self) -> list[str]:
        return list(self.networks)

    @property
    def n_groups(self) -> int:
        return len(self.networks)

    def __getitem__(self, label: str) -> Network:
        return self.networks[label]

    def centrality(self) -> DataFrame:
        return _tagged(self.networks, "group", lambda n: n.centrality())

    def plot(self, **kwargs):
        from .plotting import plot_group_networks

        return plot_group_networks(self, **kwargs)

    def compare_edges(self) -> DataFrame:
        return _tagged(self.networks, "group", lambda n: n.edges_df).select("group", "node1", "node2", "weight")


@dataclass(frozen=True)
class TSNetwork:
    """The temporal (directed) and contemporaneous networks of one series."""

    temporal: Network
    contemporaneous: Network
    labels: tuple[str, ...]
    method: str
    n_observations: int
    n_timepoints: int

    def centrality(self) -> DataFrame:
        return _tagged({"temporal": self.temporal, "contemporaneous": self.contemporaneous}, "network", lambda n: n.centrality())

    def plot(self, **kwargs):
        from .plotting import plot_ts_networks

        return plot_ts_networks(self, **kwargs)


@dataclass(frozen=True)
class MultilevelNetwork:
    """Common, contemporaneous and between-subject networks of several series, and each subject's own."""

    temporal: Network
    contemporaneous: Network
    between_subjects: Network
    subject_temporal: dict
    labels: tuple[str, ...]
    subject_ids: list
    pvalues: np.ndarray
    fit_info: dict[str, dict]
    method: str
    n_observations: int
    unthresholded_temporal: Network | None = None

    @property
    def n_nodes(self) -> int:
        return len(self.labels)

    @property
    def n_subjects(self) -> int:
        return len(self.subject_ids)

    def centrality(self) -> DataFrame:
        parts = {"temporal": self.temporal, "contemporaneous": self.contemporaneous, "between_subjects": self.between_subjects}
        return _tagged(parts, "network", lambda n: n.centrality())

    def plot(self, **kwargs):
        from .plotting import plot_multilevel_networks

        return plot_multilevel_networks(self, **kwargs)

    def temporal_thresholded(self, alpha: float = 0.05) -> Network:
        """The temporal network with effects of p > alpha at zero."""
        base = self.temporal if self.unthresholded_temporal is None else self.unthresholded_temporal
        return replace(base, adjacency=np.where(self.pvalues > alpha, 0.0, base.adjacency))

    def subject_network(self, subject_id) -> Network:
        if subject_id not in self.subject_temporal:
            raise KeyError(f"subject {subject_id!r} not found")
        return self.subject_temporal[subject_id]
