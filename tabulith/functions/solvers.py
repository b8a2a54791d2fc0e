"""Small p x p solves on the driver, fed by Gram sums; no rows pass here."""

from __future__ import annotations

import numpy as np

from .gram import Gram, total


def xy(g: Gram, target: str, features: list[str] | None = None):
    """Centred (XtX, Xty, yty, n, mean_x, mean_y) for a target column."""
    names = features if features is not None else [n for n in g.names if n != target]
    s = g.pick([*names, target])
    c, m = s.centred(), s.mean
    return c[:-1, :-1], c[:-1, -1], float(c[-1, -1]), g.n, m[:-1], float(m[-1])


def ols(xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(xtx, xty, rcond=None)[0]


def ridge(xtx: np.ndarray, xty: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(xtx + alpha * np.eye(len(xtx)), xty)


def elastic_net(xtx, xty, n, alpha, l1_ratio=1.0, max_iter=5000, tol=1e-10, start=None) -> np.ndarray:
    """Minimise |y-Xb|^2/(2n) + alpha(l1|b|_1 + (1-l1)/2|b|^2) by coordinates."""
    p = len(xty)
    b = np.zeros(p) if start is None else start.copy()
    l1, l2 = alpha * l1_ratio * n, alpha * (1 - l1_ratio) * n
    diag = np.diag(xtx)
    for _ in range(max_iter):
        worst = 0.0
        for j in range(p):
            if diag[j] <= 0:
                continue
            old = b[j]
            rho = xty[j] - xtx[j] @ b + diag[j] * old
            b[j] = np.sign(rho) * max(abs(rho) - l1, 0.0) / (diag[j] + l2)
            worst = max(worst, abs(b[j] - old) * np.sqrt(diag[j]))
        if worst < tol * np.sqrt(n):
            break
    return b


def scaled(g: Gram, skip: str | None = None) -> Gram:
    """The Gram of standardised (ddof 0) columns; ``skip`` keeps its scale."""
    sd = g.sd(0)
    sd = np.where(sd > 0, sd, 1.0)
    if skip is not None:
        sd[g.names.index(skip)] = 1.0
    xx = g.centred() / np.outer(sd, sd)
    return Gram(g.names, g.n, np.zeros(len(sd)), xx, np.zeros(len(sd)))


def rescale(g: Gram, centre: np.ndarray, scale: np.ndarray) -> Gram:
    """Sums of (x - centre) / scale from the sums of x."""
    d = (centre - g.shift)
    s = (g.s - g.n * d) / scale
    xx = (g.xx - np.outer(g.s, d) - np.outer(d, g.s) + g.n * np.outer(d, d)) / np.outer(scale, scale)
    return Gram(g.names, g.n, s, xx, np.zeros(len(d)))


def sse(g: Gram, target: str, features: list[str], coef: np.ndarray, intercept: float):
    """(residual sum, total sum about the mean, count) of a linear rule on a block."""
    s = g.pick([*features, target])
    w = np.append(-coef, 1.0)
    a = float(w @ s.shift) - intercept
    rss = float(w @ s.xx @ w + 2 * a * (w @ s.s) + s.n * a * a)
    return max(rss, 0.0), float(s.centred()[-1, -1]), s.n


def fit(g: Gram, target: str, features: list[str], solve) -> tuple[np.ndarray, float]:
    xtx, xty, _, n, mx, my = xy(g, target, features)
    b = solve(xtx, xty, n)
    return b, my - float(b @ mx)


def fold_scores(folds: dict, target: str, features: list[str], solve) -> list[tuple[float, float]]:
    """(R2, RMSE) on each held-out fold from fold Grams alone."""
    whole, out = total(folds), []
    for g in folds.values():
        b, b0 = fit(whole - g, target, features, solve)
        rss, tss, n = sse(g, target, features, b, b0)
        out.append((1 - rss / tss if tss > 0 else 0.0, float(np.sqrt(rss / n))))
    return out


def alpha_path(xty: np.ndarray, n: float, l1_ratio: float = 1.0, count: int = 100, eps: float = 1e-3):
    top = np.max(np.abs(xty)) / (n * l1_ratio)
    return np.geomspace(top, top * eps, count) if top > 0 else np.array([1e-3])


def cv_alpha(folds: dict, target: str, features: list[str], l1_ratio=1.0, count=50, max_iter=5000):
    """Penalty with the least held-out error along a falling path (warm starts)."""
    whole = total(folds)
    _, xty, _, n, _, _ = xy(whole, target, features)
    path = alpha_path(xty, n, l1_ratio, count)
    err = np.zeros(len(path))
    for g in folds.values():
        rest = whole - g
        a, c, yy, m, mx, my = xy(rest, target, features)
        b, loose = None, 1e-4 * float(np.sqrt(max(yy / m, 1e-300)))
        for i, al in enumerate(path):
            b = elastic_net(a, c, m, al, l1_ratio, min(max_iter, 1000), loose, b)
            rss, _, cnt = sse(g, target, features, b, my - float(b @ mx))
            err[i] += rss / cnt
    return float(path[int(np.argmin(err))])


def ridge_gcv(xtx, xty, yty, n, alphas) -> float:
    """Penalty with the least generalised leave-one-out error, from the spectrum."""
    vals, vecs = np.linalg.eigh(xtx)
    vals = np.maximum(vals, 0)
    u = vecs.T @ xty
    best, pick = np.inf, alphas[0]
    for a in alphas:
        k = 1 / (vals + a)
        rss = yty - 2 * np.sum(u * u * k) + np.sum(u * u * vals * k * k)
        df = 1 + np.sum(vals * k)
        score = (rss / n) / (1 - df / n) ** 2
        if score < best:
            best, pick = score, a
    return float(pick)


def bayesian_ridge(xtx, xty, yty, n, max_iter=300, tol=1e-3):
    """Evidence iteration for noise precision a and weight precision l."""
    h = 1e-6
    vals, vecs = np.linalg.eigh(xtx)
    vals = np.maximum(vals, 0)
    u = vecs.T @ xty
    a, l = 1.0 / (yty / n + np.finfo(float).eps), 1.0
    b = np.zeros(len(xty))
    for _ in range(max_iter):
        new = vecs @ (u / (vals + l / a))
        rss = max(yty - 2 * new @ xty + new @ xtx @ new, 0.0)
        gamma = np.sum(a * vals / (l + a * vals))
        l = (gamma + 2 * h) / (np.sum(new ** 2) + 2 * h)
        a = (n - gamma + 2 * h) / (rss + 2 * h)
        done = np.sum(np.abs(b - new)) < tol
        b = new
        if done:
            break
    cov = (vecs / (a * vals + l)) @ vecs.T
    return b, cov, a, l


def partial_corr(cov: np.ndarray):
    """(matrix, valid): identity and False for a singular covariance."""
    p = len(cov)
    try:
        if np.linalg.matrix_rank(cov) < p:
            raise np.linalg.LinAlgError
        inv = np.linalg.inv(cov)
    except np.linalg.LinAlgError:
        return np.eye(p), False
    d = np.sqrt(np.diag(inv))
    out = -inv / np.outer(d, d)
    np.fill_diagonal(out, 1.0)
    return out, True


def graphical_lasso(cov: np.ndarray, alpha: float, max_iter=100, tol=1e-5):
    """Sparse precision by block coordinates over the columns."""
    p = len(cov)
    w = cov.copy()
    w.flat[:: p + 1] = np.diag(cov)
    betas = np.zeros((p, p))
    for _ in range(max_iter):
        old = w.copy()
        for j in range(p):
            i = [k for k in range(p) if k != j]
            b = elastic_net(w[np.ix_(i, i)], cov[i, j], 1.0, alpha, 1.0, 500, 1e-8, betas[j, i])
            betas[j, i] = b
            w[i, j] = w[j, i] = w[np.ix_(i, i)] @ b
        if np.max(np.abs(w - old)) < tol:
            break
    prec = np.zeros((p, p))
    for j in range(p):
        i = [k for k in range(p) if k != j]
        d = 1.0 / (w[j, j] - w[i, j] @ betas[j, i])
        prec[j, j] = d
        prec[i, j] = -d * betas[j, i]
    return (prec + prec.T) / 2, w
