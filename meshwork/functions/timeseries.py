"""Lag-1 vector autoregression of one series: temporal and contemporaneous networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import sparse_precision as kernel
from ..kernels.regression import FoldSums, lasso_cv
from ..network import EstimationInfo, Network, TSNetwork
from ..operators.lag import lag_pairs
from ..operators.moments import correlations, matrix
from ..operators.order import numbered
from ..sources.datasets import ROW
from ..sources.observations import check_series
from .bootstrap import run_tasks


def fold_sums(pairs: DataFrame, names: list[str], order_by: str, folds: int) -> tuple[int, dict[int, tuple]]:
    """(rows, sums per fold) of z = (lags, values): count, z and zz'. Folds are blocks of rows in order,
    the first of them one row longer where rows don't divide; one aggregate, of `folds` rows."""
    z = [*(f"{n}_lag" for n in names), *names]
    total = pairs.count()
    folds = min(folds, total)
    pairs, number = numbered(pairs, order_by, "_number", total=total), F.col("_number")
    long, size = total % folds, total // folds
    fold = F.when(number < long * (size + 1), F.floor(number / (size + 1))).otherwise(long + F.floor((number - long * (size + 1)) / max(size, 1)))
    upper = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    sums = [F.sum(F.col(z[i]) * F.col(z[j])).alias(f"p_{i}_{j}") for i, j in upper]
    out = {}
    for r in pairs.withColumn("_fold", fold.cast("int")).groupBy("_fold").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"s_{k}") for k, c in enumerate(z)), *sums).collect():
        zz = np.zeros((len(z), len(z)))
        for i, j in upper:
            zz[i, j] = zz[j, i] = r[f"p_{i}_{j}"]
        out[r["_fold"]] = (r["_n"], np.array([r[f"s_{k}"] for k in range(len(z))]), zz)
    return total, out


def residuals(pairs: DataFrame, names: list[str], b: np.ndarray) -> DataFrame:
    """Each variable less what row j of b makes of the lags; without an intercept."""
    explained = lambda j: sum((F.lit(float(b[j, k])) * F.col(f"{m}_lag") for k, m in enumerate(names)), F.lit(0.0))
    return pairs.select(*((F.col(n) - explained(j)).alias(n) for j, n in enumerate(names)))


def estimate_var_network(
    data: DataFrame,
    *,
    beep: str | None = None,
    day: str | None = None,
    order_by: str = ROW,
    cv: int = 10,
    n_alphas: int = 100,
    max_iter: int = 10_000,
    var_threshold: float = 1e-4,
    gamma: float = 0.5,
    n_lambda: int = 100,
    lambda_min_ratio: float = 0.01,
    contemp_threshold: float = 1e-4,
    n_jobs: int = 1,
) -> TSNetwork:
    """Each variable is regressed on all variables one step before (lasso, penalty by cross-validation);
    the residuals' EBIC graphical lasso is the contemporaneous network.

    order_by: the column that holds the order of rows.
    """
    names = [n for n in check_series(data, beep, day) if n != order_by]
    p, labels = len(names), tuple(names)
    pairs = lag_pairs(data, names, order_by=order_by, beep=beep, day=day)
    if pairs.isEmpty():
        raise ValueError("No valid consecutive observation pairs found")
    total, sums = fold_sums(pairs, names, order_by, cv)
    folds = sorted(sums)

    def fit(task):
        j = p + task.j
        s = FoldSums(
            np.array([sums[f][0] for f in folds], float), np.stack([sums[f][1][:p] for f in folds]), np.array([sums[f][1][j] for f in folds]),
            np.stack([sums[f][2][:p, :p] for f in folds]), np.stack([sums[f][2][:p, j] for f in folds]), np.array([sums[f][2][j, j] for f in folds]),
        )
        b, _ = lasso_cv(s, n_alphas=n_alphas, max_iter=max_iter)
        return [(task.j, [float(v) for v in b])]

    found = run_tasks([(j,) for j in range(p)], "j int", fit, "j int, b array<double>").collect()
    b = np.zeros((p, p))
    for r in found:
        b[r.j] = r.b
    b = kernel.cut_small(b, var_threshold)
    cor = matrix(correlations(residuals(pairs, names, b), names), p)
    path = kernel.ebic_path(cor, total, gamma=gamma, n_lambda=n_lambda, lambda_min_ratio=lambda_min_ratio, threshold=contemp_threshold)
    used = {"gamma": gamma, "n_lambda": n_lambda, "lambda_min_ratio": lambda_min_ratio, "threshold": contemp_threshold}
    info = EstimationInfo("EBICglasso", used, cor, path.penalty, path.ebic, tuple(path.curve))
    temporal = Network(b, labels, "VAR", total, directed=True)
    return TSNetwork(temporal, Network(path.network, labels, "EBICglasso", total, estimation_info=info), labels, "graphicalVAR", total, data.count())
