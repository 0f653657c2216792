"""Estimators of cross-sectional networks, by name. Rows are aggregated in Spark to a p x p matrix of
correlations; what follows works on that matrix on the driver."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame

from ..kernels import sparse_precision as kernel
from ..network import EstimationInfo, Network
from ..operators.moments import correlations, matrix
from ..sources.observations import variables


@runtime_checkable
class NetworkEstimator(Protocol):
    name: str

    def estimate(self, data: DataFrame, **kwargs: Any) -> Network: ...


_known: dict[str, type] = {}


def register(name: str):
    """Class decorator: makes an estimator available under a name, in any case."""

    def add(cls: type) -> type:
        cls.name = name
        _known[name.lower()] = cls
        return cls

    return add


def available_methods() -> list[str]:
    return sorted(_known)


def get_estimator(name: str) -> NetworkEstimator:
    if name.lower() not in _known:
        raise ValueError(f"Unknown estimation method: {name!r}. Available: {', '.join(available_methods())}")
    return _known[name.lower()]()


def estimate_network(data: DataFrame, *, method: str = "EBICglasso", **kwargs: Any) -> Network:
    return get_estimator(method).estimate(data, **kwargs)


class MatrixEstimator:
    """An estimator that needs of the data its correlations and its number of rows alone.

    from_matrix also serves resampling, where a replicate's correlations come from elsewhere.
    """

    name = ""

    def estimate(self, data: DataFrame, *, cor_method: str = "pearson", **kwargs: Any) -> Network:
        names = variables(data)
        cor = matrix(correlations(data, names, method=cor_method), len(names))
        return self.from_matrix(cor, data.count(), tuple(names), cor_method=cor_method, **kwargs)

    def from_matrix(self, cor: np.ndarray, n: int, labels: tuple[str, ...], **kwargs: Any) -> Network:
        raise NotImplementedError

    def from_matrices(self, cors: np.ndarray, n: int, labels: tuple[str, ...], **kwargs: Any) -> list[Network | None]:
        """Networks of a stack of matrices; None where one can't be fitted."""
        out: list[Network | None] = []
        for cor in cors:
            try:
                out.append(self.from_matrix(cor, n, labels, **kwargs))
            except (np.linalg.LinAlgError, FloatingPointError, RuntimeError, ValueError):
                out.append(None)
        return out


@register("cor")
class Correlation(MatrixEstimator):
    def from_matrix(self, cor, n, labels, *, cor_method="pearson", threshold=0.0, **kwargs):
        out = np.nan_to_num(cor, nan=0.0)  # a variable that doesn't vary has no edges
        np.fill_diagonal(out, 0.0)
        out = kernel.cut_small(out, threshold)
        info = EstimationInfo("cor", {"cor_method": cor_method, "threshold": threshold, **kwargs}, out)
        return Network(out, labels, "cor", n, estimation_info=info)


@register("pcor")
class PartialCorrelation(MatrixEstimator):
    def from_matrix(self, cor, n, labels, *, cor_method="pearson", threshold=0.0, **kwargs):
        out = kernel.cut_small(kernel.to_partial(np.linalg.inv(cor)), threshold)
        info = EstimationInfo("pcor", {"cor_method": cor_method, "threshold": threshold, **kwargs}, cor)
        return Network(out, labels, "pcor", n, estimation_info=info)


@register("EBICglasso")
class EBICglasso(MatrixEstimator):
    def from_matrix(
        self, cor, n, labels, *, cor_method="pearson", gamma=0.5, n_lambda=100, lambda_min_ratio=0.01, threshold=1e-4, n_jobs=1, **kwargs
    ):
        fit = kernel.ebic_path(cor, n, gamma=gamma, n_lambda=n_lambda, lambda_min_ratio=lambda_min_ratio, threshold=threshold)
        used = {"gamma": gamma, "n_lambda": n_lambda, "lambda_min_ratio": lambda_min_ratio, "cor_method": cor_method, "threshold": threshold, **kwargs}
        info = EstimationInfo("EBICglasso", used, cor, fit.penalty, fit.ebic, tuple(fit.curve))
        return Network(fit.network, labels, "EBICglasso", n, estimation_info=info)

    def from_matrices(self, cors, n, labels, *, cor_method="pearson", gamma=0.5, n_lambda=100, lambda_min_ratio=0.01, threshold=1e-4, n_jobs=1, **kwargs):
        try:
            found = kernel.ebic_paths(cors, n, gamma=gamma, n_lambda=n_lambda, lambda_min_ratio=lambda_min_ratio, threshold=threshold)
        except (np.linalg.LinAlgError, FloatingPointError):  # one of them: then each by itself
            return super().from_matrices(cors, n, labels, gamma=gamma, n_lambda=n_lambda, lambda_min_ratio=lambda_min_ratio, threshold=threshold)
        return [None if x is None else Network(x, labels, "EBICglasso", n) for x in found]
