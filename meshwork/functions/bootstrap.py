"""Bootstraps of networks. A replicate is a set of row weights (operators/draws.py); its correlations
come from sums over blocks of rows, its network from a task that sees correlations alone. That holds
for tables of any size: no task and not the driver holds the observations.

Estimators that need more than correlations are given the rows of each replicate as a DataFrame.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network, active
from ..operators import resampling
from ..operators.draws import correlations_of, replicate_rows, replicate_sums, sums_of
from ..operators.moments import correlations
from ..sources.datasets import ROW
from ..sources.observations import as_doubles, variables
from .centrality import values
from .estimation import MatrixEstimator, estimate_network, get_estimator

STATISTICS = ("edge", "strength", "closeness", "betweenness", "expectedInfluence")
#: Replicates that are fitted in one go.
TOGETHER = 64

STATISTIC_ROWS = "boot_id long, is_original boolean, statistic string, node1 string, node2 string, value double"
CORRELATION_ROWS = "proportion double, statistic string, boot_id long, correlation double"


def statistics_of(net: Network, statistics: tuple[str, ...]) -> list[tuple]:
    """(statistic, node1, node2, value): every pair for 'edge', zeros included; every node for others."""
    out = []
    for s in statistics:
        if s == "edge":
            out += [(s, net.labels[i], net.labels[j], float(net.adjacency[i, j])) for i in range(net.n_nodes) for j in range(i + 1, net.n_nodes)]
        else:
            out += [(s, x, None, float(v)) for x, v in zip(net.labels, values(net, s), strict=True)]
    return out


def proportions(n: int, case_min: float, case_max: float, case_n: int) -> list[float]:
    """Shares of cases to keep, descending: whole numbers of cases between 3 and n, each once."""
    sizes = {int(np.clip(int(n * p), 3, n)) for p in np.linspace(case_max, case_min, case_n)}
    return [k / n for k in sorted(sizes, reverse=True)]


def replicate_networks(data: DataFrame, tasks: list[tuple], method: str, kwargs: dict, use, rows: str) -> DataFrame:
    """What use(task number, network or None) makes of each task's network: rows of the given kind.

    A network that can't be fitted is None.
    """
    names, labels = variables(data), tuple(variables(data))
    order = ROW if ROW in data.columns else None
    table = as_doubles(data, names, *([order] if order else []))
    columns = [c.strip().split(" ")[0] for c in rows.split(",")]
    estimator = get_estimator(method)
    if not isinstance(estimator, MatrixEstimator):
        return _one_by_one(data.select(*([order] if order else []), *names), names, order, tasks, estimator, kwargs, use, rows)
    if kwargs.get("cor_method") == "spearman":  # ranks are of the replicate's own rows
        found = correlations(replicate_rows(table, names, order, tasks), names, method="spearman", by="task")
        cors = found.groupBy("task").agg(F.collect_list(F.struct("i", "j", "r")).alias("cor"))
        total = data.count()
    else:
        cors, sizes = replicate_sums(table, names, order, tasks)
        total = sizes[None]
    sizes = {t[0]: total if t[2] is None else t[2] for t in tasks}

    def matrices_of(frame: pd.DataFrame) -> dict[int, np.ndarray]:
        if "sums" in frame:
            return {int(t): correlations_of(s, len(names)) for (t, _), s in sums_of(frame).items()}
        out = {}
        for t in frame.itertuples(index=False):
            out[int(t.task)] = m = np.eye(len(names))
            for x in t.cor:
                m[x["i"], x["j"]] = m[x["j"], x["i"]] = np.nan if x["r"] is None else x["r"]
        return out

    def fit(key, frame):
        here, out = matrices_of(frame), []
        for size in sorted({sizes[t] for t in here}):  # a stack shares its number of rows
            same = [t for t in here if sizes[t] == size]
            nets = estimator.from_matrices(np.stack([here[t] for t in same]), size, labels, **kwargs)
            out += [r for t, net in zip(same, nets, strict=True) for r in use(t, net)]
        return pd.DataFrame(out, columns=columns)

    return cors.groupBy(F.expr(f"task div {TOGETHER}")).applyInPandas(fit, rows)


def _one_by_one(data, names, order, tasks, estimator, kwargs, use, rows: str) -> DataFrame:
    """Replicates of an estimator that takes a DataFrame: a Spark job, or several, for each."""
    out = []
    for task in tasks:
        drawn = replicate_rows(data, names, order, [task]).drop("task")
        try:
            net = estimator.estimate(drawn, **kwargs)
        except Exception:  # a replicate that can't be fitted is left out
            net = None
        out += use(task[0], net)
    return active().createDataFrame(out, rows)


def run_tasks(tasks: list[tuple], columns: str, task, rows: str, together: int = 1) -> DataFrame:
    """Every task on an executor: task(row) gives rows; few small tasks per partition.

    together: up to so many tasks go to one call, as a list."""
    spark = active()
    names = [c.strip().split(" ")[0] for c in rows.split(",")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            here = list(frame.itertuples(index=False))
            if together > 1:
                found = [r for k in range(0, len(here), together) for r in task(here[k : k + together])]
            else:
                found = [r for t in here for r in task(t)]
            yield pd.DataFrame(found, columns=names)

    parts = max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(tasks, columns).repartition(parts).mapInPandas(work, rows)


@dataclass
class BootstrapResult:
    original_network: Network
    boot_type: str
    n_boots: int
    statistics: DataFrame
    case_drop_correlations: DataFrame | None = None

    @property
    def boot_statistics(self) -> DataFrame:
        """The statistics with boot_id as text, 'original' for the network itself."""
        name = F.when(F.col("is_original"), F.lit("original")).otherwise(F.col("boot_id").cast("string"))
        return self.statistics.select(name.alias("boot_id"), "statistic", "node1", "node2", "value")

    @property
    def n_effective(self) -> int:
        """Replicates that could be fitted."""
        return self.statistics.where(~F.col("is_original")).select("boot_id").distinct().count()

    def release(self) -> None:
        """Let go of the replicates that Spark keeps; a later use computes them again."""
        for table in (self.statistics, self.case_drop_correlations):
            if table is not None:
                table.unpersist()

    def summary(self, statistic: str = "edge") -> DataFrame:
        return resampling.summary(self.statistics, statistic)

    def cs_coefficient(self, statistic: str = "strength", threshold: float = 0.7, quantile: float = 0.05) -> float:
        return cs_coefficient(self, statistic, threshold, quantile)

    def difference_test(self, statistic: str = "edge", alpha: float = 0.05) -> DataFrame:
        return difference_test(self, statistic, alpha)

    def plot_edge_accuracy(self, **kwargs):
        from ..plotting import plot_edge_accuracy

        return plot_edge_accuracy(self, **kwargs)

    def plot_centrality_stability(self, **kwargs):
        from ..plotting import plot_centrality_stability

        return plot_centrality_stability(self, **kwargs)

    def plot_difference(self, **kwargs):
        from ..plotting import plot_difference

        return plot_difference(self, **kwargs)


def cs_coefficient(result: BootstrapResult, statistic: str = "strength", threshold: float = 0.7, quantile: float = 0.05) -> float:
    if result.case_drop_correlations is None:
        raise ValueError("the CS-coefficient needs a case-dropping bootstrap (boot_type='case')")
    rows = result.case_drop_correlations.where(F.col("statistic") == statistic)
    found = resampling.cs_coefficient(rows, threshold, quantile).first()
    if found is None:
        raise ValueError(f"no case-dropping correlations for statistic '{statistic}'")
    return float(found.cs)


def difference_test(result: BootstrapResult, statistic: str = "edge", alpha: float = 0.05) -> DataFrame:
    if result.boot_type == "case":
        raise ValueError("the difference test needs a nonparametric bootstrap")
    return resampling.difference_test(result.statistics, statistic, alpha)


def _checked(statistics) -> tuple[str, ...]:
    odd = [s for s in statistics if s not in STATISTICS]
    if odd:
        raise ValueError(f"Unknown statistics: {', '.join(odd)}. Available: {', '.join(STATISTICS)}")
    return tuple(statistics)


def bootnet(
    data: DataFrame,
    *,
    n_boots: int = 1000,
    boot_type: str = "nonparametric",
    method: str | None = None,
    network: Network | None = None,
    statistics: list[str] | None = None,
    n_cores: int = -1,
    case_min: float = 0.25,
    case_max: float = 0.75,
    case_n: int = 10,
    seed: int | None = None,
    verbose: bool = True,
    **est_kwargs,
) -> BootstrapResult:
    """Replicates of a network: cases drawn with replacement, or a share of the cases kept.

    statistics: all five if not given; case dropping compares node statistics alone. A seed fixes the
    draws, whatever the number of tasks. n_cores and verbose are accepted and play no part: Spark deals the tasks out.
    """
    if boot_type not in ("nonparametric", "case"):
        raise ValueError(f"'{boot_type}' is not a valid bootstrap type: nonparametric or case")
    info = network.estimation_info if network is not None else None
    if info is not None:
        method = method or info.method
        for k, v in est_kwargs.items():
            if k in info.est_kwargs and info.est_kwargs[k] != v:
                warnings.warn(f"{k}={v!r} overrides network's estimation_info ({info.est_kwargs[k]!r})", UserWarning, stacklevel=2)
        est_kwargs = {**info.est_kwargs, **est_kwargs}
    method = method or "EBICglasso"
    case = boot_type == "case"
    statistics = _checked(statistics or STATISTICS)
    if case:
        statistics = tuple(s for s in statistics if s != "edge")
    original = network if network is not None else estimate_network(data, method=method, **est_kwargs)
    known = [(-1, True, *r) for r in statistics_of(original, statistics)]
    first = active().createDataFrame(known, STATISTIC_ROWS)
    rng = np.random.default_rng(seed)

    if not case:
        tasks = [(k, int(s), None) for k, s in enumerate(rng.integers(0, 2**31, n_boots))]

        def use(k: int, net: Network | None) -> list[tuple]:
            return [] if net is None else [(k, False, *r) for r in statistics_of(net, statistics)]

        found = replicate_networks(data, tasks, method, est_kwargs, use, STATISTIC_ROWS)
        return BootstrapResult(original, boot_type, n_boots, first.unionByName(found).persist())

    n = data.count()
    shares = proportions(n, case_min, case_max, case_n)
    seeds = rng.integers(0, 2**31, n_boots * len(shares))
    wanted = {s: np.array([r[3] for r in statistics_of(original, (s,))]) for s in statistics}
    tasks = [(k, int(s), max(3, int(n * shares[k // n_boots]))) for k, s in enumerate(seeds)]

    def compare(k: int, net: Network | None) -> list[tuple]:
        own = {} if net is None else {s: np.array([r[3] for r in statistics_of(net, (s,))]) for s in statistics}
        return [(shares[k // n_boots], s, k % n_boots, _pearson(wanted[s], own[s]) if own else None) for s in statistics]

    found = replicate_networks(data, tasks, method, est_kwargs, compare, CORRELATION_ROWS)
    return BootstrapResult(original, boot_type, n_boots, first, found.persist())


def _pearson(a: np.ndarray, b: np.ndarray) -> float | None:
    if len(a) < 3 or a.std() == 0 or b.std() == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])
