"""Networks of several groups, estimated jointly, and their bootstrap."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import sparse_precision as kernel
from ..network import GroupNetwork, Network, active
from ..operators import resampling
from ..operators.draws import correlations_of, replicate_sums, sums_of
from ..operators.moments import correlations, matrix
from ..sources.datasets import ROW
from ..sources.observations import as_doubles, variables
from .bootstrap import STATISTICS, _checked, run_tasks, statistics_of

GROUP = "group"
PENALTIES, CRITERIA = ("fused", "group"), ("aic", "bic", "ebic")


def grouped(data: DataFrame | list[DataFrame], group_col: str | None) -> tuple[DataFrame, list[str]]:
    """One table with the column `group` (text), and the variables. A list's members are Group1, Group2, ..."""
    if isinstance(data, DataFrame):
        if group_col is None or group_col not in data.columns:
            raise ValueError(f"group_col '{group_col}' must name a column of the data")
        names = variables(data, [group_col])
        keep = [ROW] if ROW in data.columns else []
        return as_doubles(data, names, *keep, group_col).withColumn(GROUP, F.col(group_col).cast("string")).select(GROUP, *keep, *names), names
    first = variables(data[0], [])
    out = None
    for k, frame in enumerate(data):
        if variables(frame, []) != first:
            raise ValueError("all groups must have the same variable names, in the same order")
        keep = [ROW] if all(ROW in f.columns for f in data) else []
        one = as_doubles(frame, first, *keep).withColumn(GROUP, F.lit(f"Group{k + 1}"))
        out = one if out is None else out.unionByName(one)
    return out, first


def _fit(cov: dict[str, np.ndarray], n: dict[str, int], labels: tuple[str, ...], lambda1: float, lambda2: float, penalty: str, criterion: str, threshold, max_iter, tol) -> GroupNetwork:
    groups = sorted(cov)
    z = kernel.joint_graphical_lasso([cov[g] for g in groups], [n[g] for g in groups], lambda1, lambda2, penalty, max_iter=max_iter, tol=tol)
    nets = {g: Network(kernel.cut_small(kernel.to_partial(p), threshold), labels, "JGL", n[g]) for g, p in zip(groups, z, strict=True)}
    return GroupNetwork(nets, float(lambda1), float(lambda2), penalty, criterion)


def select_penalties(cov, n, penalty, criterion, gamma, search, n1, n2, ratio1, ratio2, max_iter, tol, spread: bool = True) -> tuple[float, float]:
    """The pair of penalties with the smallest criterion; the first on the grids wins ties.

    The sequential search finds lambda1 at lambda2 = 0, then lambda2; any other takes all pairs.
    spread: solve the points of a grid on executors.
    """
    groups = sorted(cov)
    s, sizes = [cov[g] for g in groups], [n[g] for g in groups]
    grid1, grid2 = kernel.group_grid(s, n1, ratio1), kernel.group_grid(s, n2, ratio2)

    def best(points: list[tuple[float, float]]) -> tuple[float, float]:
        def solve(t):
            return [(t.k, kernel.score_penalties(s, sizes, t.a, t.b, penalty, criterion, gamma, max_iter, tol))]

        tasks = [(k, float(a), float(b)) for k, (a, b) in enumerate(points)]
        if spread:
            found = run_tasks(tasks, "k long, a double, b double", solve, "k long, score double")
            top = found.where(~F.isnan("score")).orderBy("score", "k").first()
            found = top and top.k
        else:
            scores = [kernel.score_penalties(s, sizes, a, b, penalty, criterion, gamma, max_iter, tol) for _, a, b in tasks]
            found = None if np.isnan(scores).all() else int(np.nanargmin(scores))
        if found is None:
            raise RuntimeError("the joint graphical lasso failed at every pair of penalties")
        return points[found]

    if search != "sequential":
        return best([(a, b) for a in grid1 for b in grid2])
    lambda1, _ = best([(a, 0.0) for a in grid1])
    return best([(lambda1, b) for b in grid2])


def estimate_group_network(
    data: DataFrame | list[DataFrame],
    *,
    group_col: str | None = None,
    penalty: str = "fused",
    criterion: str = "ebic",
    gamma: float = 0.5,
    lambda1: float | None = None,
    lambda2: float | None = None,
    search: str = "sequential",
    n_lambda1: int = 30,
    n_lambda2: int = 30,
    lambda1_min_ratio: float = 0.01,
    lambda2_min_ratio: float = 0.01,
    threshold: float = 1e-4,
    max_iter: int = 500,
    tol: float = 1e-4,
) -> GroupNetwork:
    if penalty not in PENALTIES:
        raise ValueError(f"'{penalty}' is not a valid penalty: {', '.join(PENALTIES)}")
    if criterion not in CRITERIA:
        raise ValueError(f"'{criterion}' is not a valid criterion: {', '.join(CRITERIA)}")
    rows, names = grouped(data, group_col)
    cov = matrix(correlations(rows, names, by=GROUP), len(names), GROUP)
    cov = {g: np.nan_to_num(m) for g, m in cov.items()}
    n = {r[0]: r[1] for r in rows.groupBy(GROUP).count().collect()}
    if (lambda1 is None) != (lambda2 is None):
        warnings.warn("only one of lambda1 and lambda2 is given; both are selected", UserWarning, stacklevel=2)
    if lambda1 is None or lambda2 is None:
        lambda1, lambda2 = select_penalties(cov, n, penalty, criterion, gamma, search, n_lambda1, n_lambda2, lambda1_min_ratio, lambda2_min_ratio, max_iter, tol)
    return _fit(cov, n, tuple(names), lambda1, lambda2, penalty, criterion, threshold, max_iter, tol)


@dataclass
class GroupBootstrapResult:
    original_network: GroupNetwork
    n_boots: int
    statistics: DataFrame

    @property
    def boot_statistics(self) -> DataFrame:
        name = F.when(F.col("is_original"), F.lit("original")).otherwise(F.col("boot_id").cast("string"))
        return self.statistics.select(name.alias("boot_id"), "group", "statistic", "node1", "node2", "value")

    def release(self) -> None:
        """Let go of the replicates that Spark keeps; a later use computes them again."""
        self.statistics.unpersist()

    def summary(self, statistic: str = "edge", group: str | None = None) -> DataFrame:
        rows = self.statistics if group is None else self.statistics.where(F.col("group") == group)
        return resampling.summary(rows, statistic, ("group",))

    def plot_edge_accuracy(self, **kwargs):
        from ..plotting import plot_group_edge_accuracy

        return plot_group_edge_accuracy(self, **kwargs)


def bootnet_group(
    data: DataFrame | list[DataFrame],
    *,
    group_col: str | None = None,
    n_boots: int = 1000,
    statistics: list[str] | None = None,
    n_cores: int = 1,
    seed: int | None = None,
    verbose: bool = True,
    **est_kwargs,
) -> GroupBootstrapResult:
    """Replicates of a joint estimate: rows are drawn with replacement within each group.

    statistics: all five if not given. n_cores and verbose play no part.
    """
    statistics = _checked(statistics or STATISTICS)
    rows, names = grouped(data, group_col)
    original = estimate_group_network(rows, group_col=GROUP, **est_kwargs)
    seeds = np.random.default_rng(seed).integers(0, 2**31, n_boots)
    order = ROW if ROW in rows.columns else None
    sums, size = replicate_sums(rows, names, order, [(k, int(s), None) for k, s in enumerate(seeds)], by=GROUP)
    labels = tuple(names)
    options = {"penalty": "fused", "criterion": "ebic", "gamma": 0.5, "search": "sequential", "n_lambda1": 30, "n_lambda2": 30,
               "lambda1_min_ratio": 0.01, "lambda2_min_ratio": 0.01, "threshold": 1e-4, "max_iter": 500, "tol": 1e-4, "lambda1": None, "lambda2": None} | est_kwargs

    def replicate(number: int, sums: dict[str, np.ndarray]) -> list[tuple]:
        cov = {g: np.nan_to_num(correlations_of(s, len(names))) for g, s in sums.items()}
        o = options
        try:
            pair = (o["lambda1"], o["lambda2"])
            if None in pair:
                pair = select_penalties(cov, size, o["penalty"], o["criterion"], o["gamma"], o["search"], o["n_lambda1"], o["n_lambda2"],
                                        o["lambda1_min_ratio"], o["lambda2_min_ratio"], o["max_iter"], o["tol"], spread=False)
            fit = _fit(cov, size, labels, *pair, o["penalty"], o["criterion"], o["threshold"], o["max_iter"], o["tol"])
        except Exception:  # a replicate that can't be fitted is left out
            return []
        return [(g, number, False, *r) for g, net in fit.networks.items() for r in statistics_of(net, statistics)]

    kinds = "group string, boot_id long, is_original boolean, statistic string, node1 string, node2 string, value double"
    columns = [c.strip().split(" ")[0] for c in kinds.split(",")]

    def fit(key, frame):
        own: dict[int, dict] = {}
        for (task, g), s in sums_of(frame).items():
            own.setdefault(int(task), {})[g] = s
        return pd.DataFrame([r for k, s in own.items() for r in replicate(k, s)], columns=columns)

    found = sums.groupBy(F.expr("task div 4")).applyInPandas(fit, kinds)
    known = [(g, -1, True, *r) for g, net in original.networks.items() for r in statistics_of(net, statistics)]
    return GroupBootstrapResult(original, n_boots, active().createDataFrame(known, kinds).unionByName(found).persist())
