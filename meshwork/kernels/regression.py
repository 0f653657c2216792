"""Regressions that iterate on sums of products alone: cross-validated lasso, mixed models."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .sparse_precision import lasso_descent


@dataclass(frozen=True)
class FoldSums:
    """Sums over the rows of each fold: count (f,), x (f, p), y (f,), xx (f, p, p), xy (f, p), yy (f,)."""

    count: np.ndarray
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    def without(self, fold: int | None) -> tuple:
        keep = np.arange(len(self.count)) != fold
        return tuple(getattr(self, k)[keep].sum(0) for k in ("count", "x", "y", "xx", "xy", "yy"))


def _centred(sums: tuple) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    n, x, y, xx, xy, _ = sums
    mx, my = x / n, y / n
    return n, mx, my, xx / n - np.outer(mx, mx), xy / n - mx * my


def lasso_cv(sums: FoldSums, *, n_alphas: int = 100, eps: float = 1e-3, max_iter: int = 10_000, tol: float = 1e-5) -> tuple[np.ndarray, float]:
    """(coefficients, penalty) of the lasso whose penalty has the smallest mean squared error over folds.

    Folds are left out by subtracting their sums; no row is read again. The grid of penalties runs
    down from the smallest that empties the model.
    """
    _, _, _, gram, target = _centred(sums.without(None))
    largest = np.abs(target).max(initial=0.0)
    if largest == 0:
        return np.zeros(len(target)), 0.0
    grid = np.logspace(np.log10(largest), np.log10(largest * eps), n_alphas)
    error = np.zeros(len(grid))
    folds = np.flatnonzero(sums.count > 0)
    for f in folds:
        _, mx, my, g, t = _centred(sums.without(f))
        m, x, y, xx, xy, yy = (getattr(sums, k)[f] for k in ("count", "x", "y", "xx", "xy", "yy"))
        b = np.zeros(len(t))
        for k, alpha in enumerate(grid):
            b = lasso_descent(g, t, alpha, b, max_iter, tol)
            a = my - mx @ b  # intercept
            error[k] += (yy - 2 * (a * y + xy @ b) + a * a * m + 2 * a * (x @ b) + b @ xx @ b) / m
    best = grid[int(np.argmin(error))]
    b = np.zeros(len(target))
    for alpha in grid[: int(np.argmin(error)) + 1]:
        b = lasso_descent(gram, target, alpha, b, max_iter, tol)
    return b, float(best)


@dataclass
class MixedFit:
    fixed: np.ndarray
    pvalues: np.ndarray
    random: np.ndarray  # subjects x coefficients, zero where there is no random effect
    sigma2: float
    loglik: float
    bic: float
    aic: float
    structure: str
    converged: bool
    theta: np.ndarray  # square roots of variances over the residual variance, or the Cholesky factor
    warnings: list[str] = field(default_factory=list)


STRUCTURES = ("correlated", "orthogonal", "fixed")

#: Parts of warnings after which a simpler structure is fitted, of this engine and of R's.
SEVERE = ("singular", "not positive definite", "optimization failed", "on the boundary")
SEVERE_IN_R = ("failed to converge", "singular", "unable to evaluate", "boundary")


def is_severe(notes: list[str], parts: tuple[str, ...] = SEVERE) -> bool:
    return any(part in note.lower() for note in notes for part in parts)


def _covariance(theta: np.ndarray, q: int, structure: str) -> np.ndarray:
    """Covariance of random effects over the residual variance; 'fixed' has a random intercept alone."""
    if structure == "correlated":
        low = np.zeros((q, q))
        low[np.tril_indices(q)] = theta
        return low @ low.T
    out = np.zeros((q, q))
    k = q if structure == "orthogonal" else 1
    out[np.arange(k), np.arange(k)] = theta**2
    return out


def _profile(psi, a, c, yy, n):
    """Pieces of the likelihood at psi, from a subject's sums X'X (m, q, q), X'y (m, q) and y'y (m,)."""
    q = a.shape[1]
    inner = np.eye(q) + psi @ a
    m = np.linalg.solve(inner, np.broadcast_to(psi, a.shape))
    am = a @ m
    xvx = (a - am @ a).sum(0)
    xvy = (c - (am @ c[..., None])[..., 0]).sum(0)
    yvy = (yy - np.einsum("si,sij,sj->s", c, m, c)).sum()
    logdet = np.linalg.slogdet(inner)[1].sum()
    beta = np.linalg.solve(xvx, xvy)
    rss = max(yvy - xvy @ beta, 1e-12)
    dof = n - q
    value = -0.5 * (dof * math.log(rss / dof) + logdet + np.linalg.slogdet(xvx)[1] + dof * (1 + math.log(2 * math.pi)))
    return value, beta, rss / dof, xvx, m


def simplex(f, x: np.ndarray, rounds: int, tol: float = 1e-8) -> tuple[np.ndarray, float, bool]:
    """Nelder and Mead's search."""
    k = len(x)
    points = [x] + [x + np.where(np.arange(k) == i, 0.25, 0.0) for i in range(k)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tol * (1 + abs(values[0])):
            return points[0], values[0], True
        centre = np.mean(points[:-1], 0)
        far = centre + (centre - points[-1])
        v = f(far)
        if v < values[0]:
            further = centre + 2 * (centre - points[-1])
            w = f(further)
            points[-1], values[-1] = (further, w) if w < v else (far, v)
        elif v < values[-2]:
            points[-1], values[-1] = far, v
        else:
            inside = centre + 0.5 * ((far if v < values[-1] else points[-1]) - centre)
            w = f(inside)
            if w < min(v, values[-1]):
                points[-1], values[-1] = inside, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))], min(values), False


def descend(f, x: np.ndarray, rounds: int = 200, tol: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """BFGS with central differences."""
    k = len(x)

    def slope(x):
        h = 1e-5 * (1 + np.abs(x))
        return np.array([(f(x + e) - f(x - e)) / (2 * e[i]) for i, e in enumerate(np.diag(h))])

    value, g, inverse = f(x), slope(x), np.eye(k)
    for _ in range(rounds):
        if np.abs(g).max() < 1e-4 * (1 + abs(value)):
            return x, value, True
        d = -inverse @ g
        if d @ g >= 0:
            inverse, d = np.eye(k), -g
        step = 1.0
        while step > 1e-10:
            new = f(x + step * d)
            if np.isfinite(new) and new <= value + 1e-4 * step * (d @ g):
                break
            step /= 2
        else:
            return x, value, bool(np.abs(g).max() < 1e-2 * (1 + abs(value)))
        s = step * d
        h = slope(x + s)
        t = h - g
        if s @ t > 1e-12:
            r = 1 / (s @ t)
            left = np.eye(k) - r * np.outer(s, t)
            inverse = left @ inverse @ left.T + r * np.outer(s, s)
        done = value - new < tol * (1 + abs(value))
        x, value, g = x + s, new, h
        if done:
            return x, value, True
    return x, value, False


def mixed_model(a: np.ndarray, c: np.ndarray, yy: np.ndarray, count: np.ndarray, structure: str) -> MixedFit:
    """Restricted maximum likelihood from subjects' sums.

    a (m, q, q): X'X of each subject, the first column of X is 1; c (m, q): X'y; yy (m,): y'y.
    Every evaluation of the likelihood works on q x q matrices, whatever the number of rows.
    """
    if structure not in STRUCTURES:
        raise ValueError(f"temporal must be one of {', '.join(STRUCTURES)}, not {structure!r}")
    q, n, m = a.shape[1], float(count.sum()), len(count)
    scale = 1 / np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2).sum(0) / n, 1e-12))
    start = {"correlated": (np.diag(0.3 * scale))[np.tril_indices(q)], "orthogonal": 0.3 * scale, "fixed": 0.3 * scale[:1]}[structure]

    def loss(theta):
        try:
            with np.errstate(all="ignore"):
                value = -_profile(_covariance(theta, q, structure), a, c, yy, n)[0]
        except np.linalg.LinAlgError:
            return np.inf
        return value if np.isfinite(value) else np.inf

    theta, value, ok = descend(loss, start)
    if not ok:
        theta, value, ok = simplex(loss, theta, 400 * len(theta))
    psi = _covariance(theta, q, structure)
    loglik, beta, sigma2, xvx, inner = _profile(psi, a, c, yy, n)
    error = np.sqrt(np.maximum(np.diag(np.linalg.inv(xvx)) * sigma2, 0))
    z = np.abs(beta) / np.maximum(error, 1e-300)
    random = np.einsum("sij,sj->si", inner, c - a @ beta)
    k = len(theta) + q + 1
    notes = [] if ok else ["the likelihood did not converge"]
    if structure == "correlated":
        values = np.linalg.eigvalsh(psi)
        if values[0] < 1e-10 * max(values[-1], 1e-12):
            notes.append("the covariance of random effects is singular")
    return MixedFit(
        beta, np.array([math.erfc(v / math.sqrt(2)) for v in z]), random, float(sigma2), float(loglik),
        float(-2 * loglik + k * math.log(n)), float(-2 * loglik + 2 * k), structure, ok, theta, notes,
    )


def mixed_model_chain(a, c, yy, count, structure: str) -> MixedFit:
    """The wanted structure, or the next simpler one where the fit fails; the simplest is taken as it is."""
    chain = STRUCTURES[STRUCTURES.index(structure) :] if structure in STRUCTURES else ()
    if not chain:
        raise ValueError(f"temporal must be one of {', '.join(STRUCTURES)}, not {structure!r}")
    notes: list[str] = []
    for s in chain:
        try:
            fit = mixed_model(a, c, yy, count, s)
        except np.linalg.LinAlgError as e:
            notes.append(f"{s}: {e}")
            continue
        if s == chain[-1] or fit.converged and not is_severe(fit.warnings):
            fit.warnings = notes + [f"{s}: {w}" for w in fit.warnings]
            return fit
        notes += [f"{s}: {w}" for w in fit.warnings]
    raise RuntimeError("no mixed model could be fitted: " + "; ".join(notes))
