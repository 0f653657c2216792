"""Multilevel lag-1 autoregression: mixed models over subjects.

A subject's rows enter the likelihood through sums of products only, so one aggregation by subject
feeds every evaluation. Models of different outcomes are fitted on executors.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import sparse_precision as kernel
from ..kernels.regression import STRUCTURES, mixed_model_chain
from ..network import MultilevelNetwork, Network, active
from ..operators.lag import lag_pairs, subject_means, warn_of_gaps, within_subject_z
from ..operators.moments import correlations, matrix
from ..sources.datasets import ROW
from ..sources.observations import check_panel

#: Variables beyond which correlated random effects have too many parameters.
MOST_CORRELATED = 8


def lmer_formula(outcome: str, lags: list[str], subject: str, structure: str) -> str:
    """The model in the notation of mixed-model packages."""
    terms = " + ".join(lags)
    bars = {"correlated": f"(1 + {terms} | {subject})", "orthogonal": f"(1 + {terms} || {subject})", "fixed": f"(1 | {subject})"}
    return f"{outcome} ~ {terms} + {bars[structure]}"


def auto_structure(p: int, structure: str) -> str:
    if structure == "correlated" and p > MOST_CORRELATED:
        warnings.warn(
            f"{p} variables need {(p + 1) * (p + 2) // 2} covariance parameters per outcome. Defaulting to 'orthogonal' random effects", UserWarning, stacklevel=3
        )
        return "orthogonal"
    return structure


def convergence_note(info: dict[str, dict], wanted: str) -> str | None:
    """One sentence on the outcomes whose models needed simpler random effects or had trouble; None if all is well."""
    simpler = [f"{n} ({wanted} -> {x['actual_re']})" for n, x in info.items() if x["actual_re"] != wanted]
    trouble = [n for n, x in info.items() if x["warnings"]]
    said = [f"simpler random effects for: {', '.join(simpler)}"] if simpler else []
    if trouble:
        said.append(f"convergence trouble for: {', '.join(trouble)}; see fit_info[outcome]['warnings']")
    return "mixed models: " + "; ".join(said) if said else None


def subject_sums(pairs: DataFrame, names: list[str], subject: str, outcome: int) -> DataFrame:
    """(subject, n, xx, xy, yy) of x = (1, lags) and one outcome, over rows where all are present."""
    x = [F.lit(1.0), *(F.col(f"{n}_lag") for n in names)]
    y = F.col(names[outcome])
    rows = pairs.dropna("any", subset=[names[outcome], *(f"{n}_lag" for n in names)])
    upper = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    return rows.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.sum(x[i] * x[j]) for i, j in upper)).alias("xx"), F.array(*(F.sum(v * y) for v in x)).alias("xy"), F.sum(y * y).alias("yy")
    )


def estimate_multilevel_network(
    data: DataFrame,
    subject: str,
    *,
    beep: str | None = None,
    day: str | None = None,
    order_by: str = ROW,
    temporal_alpha: float | None = 0.05,
    temporal: str = "correlated",
    engine: str = "auto",
    auto_re: bool = True,
    gamma: float = 0.5,
    between_gamma: float | None = None,
    n_lambda: int = 100,
    lambda_min_ratio: float = 0.01,
    threshold: float = 1e-4,
    n_cores: int = 1,
    scale: bool = False,
) -> MultilevelNetwork:
    """Temporal effects with random slopes, contemporaneous and between-subject networks.

    temporal: 'correlated', 'orthogonal' or 'fixed' (random intercepts alone). order_by: the column
    that holds the order of rows within subjects. Subjects without any pair of consecutive rows get
    the common effects. temporal_alpha: effects with larger p-values are zero; None keeps all.
    """
    if engine not in ("auto", "statsmodels", "lme4"):
        raise ValueError(f"engine must be 'auto', 'statsmodels' or 'lme4', not {engine!r}")
    if engine == "lme4":
        raise ImportError("engine='lme4' needs R with lme4 and lmerTest, and the Python package rpy2, which are not part of this engine")
    if temporal not in STRUCTURES:
        raise ValueError(f"temporal must be one of {', '.join(STRUCTURES)}, not {temporal!r}")
    names = [n for n in check_panel(data, subject, beep, day) if n != order_by]
    p, labels = len(names), tuple(names)
    rows = within_subject_z(data, names, subject) if scale else data
    warn_of_gaps(rows, names, beep)
    pairs = lag_pairs(rows, names, order_by=order_by, subject=subject, beep=beep, day=day, drop_empty=True).persist()
    if pairs.isEmpty():
        raise ValueError("No valid consecutive observation pairs found")
    structure = auto_structure(p, temporal) if auto_re else temporal
    sums = None
    for j in range(p):
        one = subject_sums(pairs, names, subject, j).withColumn("j", F.lit(j))
        sums = one if sums is None else sums.unionByName(one)
    kind = data.schema[subject].dataType.simpleString()
    upper = np.triu_indices(p + 1)

    def fit(key, frame):
        import pandas as pd

        a = np.zeros((len(frame), p + 1, p + 1))
        a[:, upper[0], upper[1]] = a[:, upper[1], upper[0]] = np.stack(frame["xx"].to_list())
        m = mixed_model_chain(a, np.stack(frame["xy"].to_list()), frame["yy"].to_numpy(float), frame["n"].to_numpy(float), structure)
        return pd.DataFrame(
            {
                "j": [int(key[0])], "fixed": [m.fixed.tolist()], "pvalues": [m.pvalues.tolist()], "subjects": [frame[subject].tolist()],
                "effects": [(m.fixed + m.random).ravel().tolist()], "bic": [m.bic], "aic": [m.aic], "structure": [m.structure], "warnings": [m.warnings],
            }
        )

    result = f"j int, fixed array<double>, pvalues array<double>, subjects array<{kind}>, effects array<double>, bic double, aic double, structure string, warnings array<string>"
    fits = {r.j: r for r in sums.groupBy("j").applyInPandas(fit, result).collect()}

    fixed = np.array([fits[j].fixed for j in range(p)])
    pvalues = np.array([fits[j].pvalues for j in range(p)])[:, 1:]
    raw = kernel.cut_small(fixed[:, 1:], threshold)
    masked = np.zeros(raw.shape, bool) if temporal_alpha is None else pvalues > temporal_alpha
    own_pairs = {r[0]: r[1] for r in pairs.groupBy(subject).count().collect()}
    total = sum(own_pairs.values())
    temporal_net = Network(np.where(masked, 0.0, raw), labels, "mlVAR", total, directed=True)
    unthresholded = None if temporal_alpha is None else Network(raw, labels, "mlVAR", total, directed=True)

    subjects = sorted(r[0] for r in data.select(subject).distinct().collect())
    effects = {}
    for j in range(p):
        table = np.array(fits[j].effects).reshape(-1, p + 1)
        for s, row in zip(fits[j].subjects, table, strict=True):
            effects.setdefault(s, fixed.copy())[j] = row
    own = {}
    for s in subjects:
        b = effects.get(s, fixed)[:, 1:]
        own[s] = Network(np.where(masked, 0.0, kernel.cut_small(b, threshold)), labels, "mlVAR", own_pairs.get(s, 0), directed=True)

    cor, n_cor = _residual_correlations(pairs, names, subject, effects, fixed, kind)
    pooled = kernel.ebic_path(cor, n_cor, gamma=gamma, n_lambda=n_lambda, lambda_min_ratio=lambda_min_ratio, threshold=threshold)
    contemporaneous = Network(pooled.network, labels, "EBICglasso", n_cor)

    intercepts = np.array([effects[s][:, 0] for s in subjects if s in effects])
    if len(intercepts) >= 3 and (intercepts.std(0, ddof=1) > 1e-10).all():
        between_cor, n_between = np.corrcoef(intercepts.T), len(intercepts)
    else:
        means = subject_means(data, names, subject)
        between_cor, n_between = matrix(correlations(means, names), p), len(subjects)
    path = kernel.ebic_path(
        np.nan_to_num(between_cor), n_between, gamma=gamma if between_gamma is None else between_gamma, n_lambda=n_lambda, lambda_min_ratio=lambda_min_ratio, threshold=threshold
    )
    between = Network(path.network, labels, "EBICglasso", n_between)

    info = {n: {"bic": fits[j].bic, "aic": fits[j].aic, "actual_re": fits[j].structure, "warnings": list(fits[j].warnings)} for j, n in enumerate(names)}
    note = convergence_note(info, structure)
    if note:
        warnings.warn(note, UserWarning, stacklevel=2)
    pairs.unpersist()
    return MultilevelNetwork(temporal_net, contemporaneous, between, own, labels, subjects, pvalues, info, "mlVAR", total, unthresholded)


def _residual_correlations(pairs, names, subject, effects, fixed, kind) -> tuple[np.ndarray, int]:
    """Correlations of all outcomes' residuals (rows where all are present), with subjects' coefficients."""
    p = len(names)
    known = [(s, [float(v) for v in b.ravel()]) for s, b in effects.items()]
    table = active().createDataFrame(known, f"`{subject}` {kind}, coefficients array<double>")
    rows = pairs.join(table, subject)  # one row per subject; Spark broadcasts it if it is small
    x = [F.lit(1.0), *(F.col(f"{n}_lag") for n in names)]
    residual = lambda j: F.col(names[j]) - sum((F.get("coefficients", F.lit(j * (p + 1) + k)) * v for k, v in enumerate(x)), F.lit(0.0))
    rows = rows.select(*(residual(j).alias(n) for j, n in enumerate(names))).dropna("any")
    return matrix(correlations(rows, names), p), rows.count()
