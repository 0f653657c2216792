"""Kernels against brute force, closed forms and optimality conditions."""

import itertools

import numpy as np
import pytest

from meshwork.kernels import graph
from meshwork.kernels import sparse_precision as sp
from meshwork.kernels.regression import FoldSums, lasso_cv, mixed_model, mixed_model_chain


def correlation(p, n, seed, structure=0.4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 1:] += structure * x[:, :-1]
    return np.corrcoef(x.T)


@pytest.mark.parametrize("penalty", [0.02, 0.1, 0.4])
def test_graphical_lasso_meets_its_optimality_conditions(penalty):
    s = correlation(8, 300, 1)
    w, p = sp.graphical_lasso(s, penalty, tol=1e-7)
    slope = np.linalg.inv(p) - s
    off = ~np.eye(8, dtype=bool)
    zero = off & (p == 0)
    assert np.allclose(p, p.T)
    assert np.abs(slope[zero]).max(initial=0) <= penalty + 1e-4
    assert np.allclose(slope[off & ~zero], penalty * np.sign(p[off & ~zero]), atol=1e-4)
    assert np.allclose(np.diag(slope), 0, atol=1e-4)
    assert np.allclose(w, np.linalg.inv(p), atol=1e-3)


def test_path_selects_the_smallest_ebic_warm_or_cold():
    s = correlation(7, 400, 2)
    warm, cold = (sp.ebic_path(s, 400, warm=x, n_lambda=40) for x in (True, False))
    assert warm.penalty == cold.penalty
    assert np.allclose(warm.network, cold.network, atol=2e-3)
    assert warm.ebic == min(v for _, v in warm.curve)
    assert np.all(np.diff([x for x, _ in warm.curve]) < 0)
    more = sp.ebic_path(s, 400, gamma=1.0, n_lambda=40)
    assert np.count_nonzero(more.network) <= np.count_nonzero(warm.network)
    with pytest.raises(RuntimeError):
        sp.ebic_path(np.eye(4), 50)


def test_stacked_paths_are_the_single_paths():
    cors = np.stack([correlation(6, 150, k) for k in range(12)] + [np.eye(6), np.full((6, 6), np.nan)])
    found = sp.ebic_paths(cors, 150, n_lambda=30)
    assert found[-1] is None and found[-2] is None
    for c, x in zip(cors[:-2], found[:-2], strict=True):
        one = sp.ebic_path(c, 150, n_lambda=30)
        assert np.allclose(one.network, x, atol=2e-3)
        assert ((one.network != 0) == (x != 0)).all()


@pytest.mark.parametrize("penalty", ["group", "fused"])
def test_joint_lasso(penalty):
    cov = [correlation(5, 200, k) for k in (3, 4)]
    free = sp.joint_graphical_lasso(cov, [200, 200], 0.0, 0.0, penalty, max_iter=4000, tol=1e-7)
    for p, s in zip(free, cov, strict=True):
        assert np.allclose(p, np.linalg.inv(s), atol=0.03)
    tied = sp.joint_graphical_lasso(cov, [200, 200], 5.0, 500.0 if penalty == "fused" else 40.0, penalty)
    assert all(np.allclose(p, p.T) and np.linalg.eigvalsh(p)[0] > 0 for p in tied)
    if penalty == "fused":
        off = ~np.eye(5, dtype=bool)
        assert np.allclose(tied[0][off], tied[1][off])
    dense, sparse = (sum(np.count_nonzero(p) for p in sp.joint_graphical_lasso(cov, [200, 200], x, 0.1, penalty)) for x in (0.1, 30.0))
    assert sparse < dense
    with pytest.raises(ValueError, match="penalty"):
        sp.joint_graphical_lasso(cov, [200, 200], 0, 0, "other")


@pytest.mark.parametrize("groups", [2, 3, 5])
def test_fused_prox_is_the_minimiser(groups):
    rng = np.random.default_rng(groups)

    def loss(v, x, strength):
        return 0.5 * ((v - x) ** 2).sum(0) + strength * sum(abs(v[k] - v[l]) for k in range(groups) for l in range(k))  # noqa: E741

    for strength in (0.0, 0.05, 0.3, 5.0):
        x = rng.normal(size=(groups, 7))
        x[0, 0] = x[1, 0]  # a tie
        v = sp.fused_prox(x, strength)
        best = loss(v, x, strength)
        for step in (1e-3, 1e-2, 0.3):
            for _ in range(200):
                assert (loss(v + rng.normal(size=v.shape) * step, x, strength) >= best - 1e-12).all()
    assert np.allclose(sp.fused_prox(np.array([0.0, 1.0, 2.0]), 0.05), [0.1, 1.0, 1.9])
    assert np.allclose(sp.fused_prox(np.array([0.0, 1.0, 2.0]), 9.0), 1.0)


def random_graph(n, seed, directed=False):
    rng = np.random.default_rng(seed)
    w = np.round(rng.uniform(-1, 1, (n, n)), 1) * (rng.uniform(size=(n, n)) < 0.4)
    np.fill_diagonal(w, 0)
    return w if directed else np.triu(w) + np.triu(w).T


def all_paths(w):
    """(number of shortest paths, their nodes) by listing every simple path."""
    d, n = graph.distances(w), len(w)
    best = {}
    for k in range(2, n + 1):
        for path in itertools.permutations(range(n), k):
            length = sum(d[a, b] for a, b in itertools.pairwise(path))
            if np.isfinite(length):
                best.setdefault((path[0], path[-1]), []).append((length, path))
    return {e: [p for x, p in v if x <= min(v)[0] + 1e-12] for e, v in best.items()}, {e: min(v)[0] for e, v in best.items()}


@pytest.mark.parametrize(("seed", "directed"), [(1, False), (2, False), (3, True), (4, True)])
def test_paths_against_all_paths(seed, directed):
    w = random_graph(6, seed, directed)
    paths, length = all_paths(w)
    close = np.zeros(6)
    for j in range(6):
        found = [v for (_, b), v in length.items() if b == j]
        if found:
            close[j] = len(found) / sum(found) * len(found) / 5
    assert np.allclose(graph.closeness(w), close)
    between = np.zeros(6)
    for ps in paths.values():
        for p in ps:
            for v in p[1:-1]:
                between[v] += 1 / len(ps)
    assert np.allclose(graph.betweenness(w, directed=directed), between / 20)


def test_communities_of_two_blocks():
    w = np.zeros((5, 5))
    for i, j, v in [(0, 1, 0.8), (0, 2, 0.7), (1, 2, 0.6), (3, 4, 0.9)]:
        w[i, j] = w[j, i] = v
    for found in (graph.walktrap(w), graph.louvain(w, seed=1), graph.greedy_modularity(w)):
        assert len(set(found[:3])) == len(set(found[3:])) == 1
        assert found[0] != found[3]
    assert len(set(graph.walktrap(np.zeros((3, 3))).tolist())) == 3


def test_modularity_is_at_its_best_over_all_partitions():
    w = np.abs(random_graph(7, 9))
    parts = [[0]]
    for _ in range(6):
        parts = [p + [c] for p in parts for c in range(max(p) + 2)]
    best = max(graph.modularity(w, np.array(p)) for p in parts)
    assert max(graph.modularity(w, graph.louvain(w, seed=s)) for s in range(10)) >= best - 1e-9
    assert graph.modularity(w, graph.greedy_modularity(w)) >= 0.8 * best


def test_lasso_cv_against_direct_folds():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(103, 4))
    y = x @ np.array([0.8, 0, -0.5, 0]) + 0.3 + rng.normal(size=103)
    folds = np.array_split(np.arange(103), 5)
    sums = FoldSums(
        np.array([len(f) for f in folds], float), np.stack([x[f].sum(0) for f in folds]), np.array([y[f].sum() for f in folds]),
        np.stack([x[f].T @ x[f] for f in folds]), np.stack([x[f].T @ y[f] for f in folds]), np.array([y[f] @ y[f] for f in folds]),
    )
    b, alpha = lasso_cv(sums, n_alphas=25)
    grid = np.logspace(0, -3, 25) * np.abs((x - x.mean(0)).T @ (y - y.mean()) / 103).max()

    def fit(x, y, a):
        c, d = x - x.mean(0), y - y.mean()
        return sp.lasso_descent(c.T @ c / len(c), c.T @ d / len(c), a, np.zeros(4), 10000, 1e-9)

    def error(a):
        out = []
        for f in folds:
            rest = np.setdiff1d(np.arange(103), f)
            k = fit(x[rest], y[rest], a)
            out.append(np.mean((y[f] - y[rest].mean() - (x[f] - x[rest].mean(0)) @ k) ** 2))
        return np.mean(out)

    assert np.isclose(alpha, grid[int(np.argmin([error(a) for a in grid]))])
    assert np.allclose(b, fit(x, y, alpha), atol=1e-4)


def panel(seed, slope_sd, subjects=40, rows=30):
    rng = np.random.default_rng(seed)
    a, c, yy, n, xs, ys, group = [], [], [], [], [], [], []
    for s in range(subjects):
        x = np.column_stack([np.ones(rows), rng.normal(size=(rows, 2))])
        b = np.array([1.0, 0.5, -0.3]) + rng.normal(0, [0.8, slope_sd, slope_sd])
        y = x @ b + rng.normal(0, 0.5, rows)
        a.append(x.T @ x)
        c.append(x.T @ y)
        yy.append(y @ y)
        n.append(rows)
        xs.append(x)
        ys.append(y)
        group.append(s)
    return np.array(a), np.array(c), np.array(yy), np.array(n, float), xs, ys


@pytest.mark.parametrize("structure", ["correlated", "orthogonal", "fixed"])
def test_mixed_model_recovers_effects(structure):
    a, c, yy, n, _, _ = panel(6, 0.3 if structure != "fixed" else 0.0)
    fit = mixed_model(a, c, yy, n, structure)
    assert fit.converged
    assert np.allclose(fit.fixed, [1.0, 0.5, -0.3], atol=0.35)
    assert abs(fit.sigma2 - 0.25) < 0.04
    assert fit.pvalues[1] < 0.01


def test_mixed_model_likelihood_against_dense_matrices():
    a, c, yy, n, xs, ys = panel(7, 0.3, 8, 12)
    fit = mixed_model(a, c, yy, n, "fixed")
    x, y = np.concatenate(xs), np.concatenate(ys)
    intercept = fit.random[:, 0]
    z = np.kron(np.eye(8), np.ones((12, 1)))
    best = -np.inf
    for ratio in np.exp(np.linspace(-4, 4, 4001)):
        v = np.eye(96) + ratio * z @ z.T
        inv = np.linalg.inv(v) if abs(ratio - 1) < 1e-9 else np.eye(96) - z @ z.T * (ratio / (1 + 12 * ratio))
        xvx = x.T @ inv @ x
        beta = np.linalg.solve(xvx, x.T @ inv @ y)
        r = y - x @ beta
        s2 = r @ inv @ r / 93
        value = -0.5 * (93 * np.log(s2) + 8 * np.log(1 + 12 * ratio) + np.linalg.slogdet(xvx)[1] + 93 * (1 + np.log(2 * np.pi)))
        if value > best:
            best, kept = value, (beta, ratio * z.T @ inv @ r)
    assert abs(fit.loglik - best) < 1e-3
    assert np.allclose(fit.fixed, kept[0], atol=1e-3)
    assert np.allclose(intercept, kept[1], atol=1e-2)


def test_chain_and_unknown_structure():
    a, c, yy, n, _, _ = panel(8, 0.0)
    assert mixed_model_chain(a, c, yy, n, "correlated").structure in ("correlated", "orthogonal", "fixed")
    with pytest.raises(ValueError, match="temporal"):
        mixed_model_chain(a, c, yy, n, "other")
