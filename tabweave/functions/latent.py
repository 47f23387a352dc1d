"""Latent normal correlations of pairs with a discrete margin, from small tables."""

from __future__ import annotations

import numpy as np

from tabweave.functions.special import norm_cdf, norm_ppf

BOUND = 0.995
NODES, WEIGHTS = np.polynomial.legendre.leggauss(20)


def bivariate_normal_cdf(a, b, rho: float) -> np.ndarray:
    """P(X <= a, Y <= b): Plackett's identity integrated over the angle by Gauss-Legendre."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    x, y = np.clip(a, -38, 38), np.clip(b, -38, 38)
    top = np.arcsin(np.clip(rho, -1, 1))
    theta = top * (NODES + 1) / 2
    s, c2 = np.sin(theta), np.cos(theta) ** 2
    inner = np.exp(-(x[..., None] ** 2 + y[..., None] ** 2 - 2 * x[..., None] * y[..., None] * s) / (2 * c2))
    return np.clip(norm_cdf(x) * norm_cdf(y) + top / (4 * np.pi) * (inner * WEIGHTS).sum(-1), 0.0, 1.0)


def golden(f, low: float = -BOUND, high: float = BOUND, tol: float = 1e-6) -> float:
    """Minimum of a unimodal function."""
    g = (np.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def thresholds(probabilities) -> np.ndarray:
    """Cuts -inf, ..., inf of the latent normal."""
    cum = np.clip(np.cumsum(probabilities)[:-1], 0, 1)
    return np.concatenate([[-np.inf], norm_ppf(cum), [np.inf]])


def polyserial(scores, counts, cuts) -> float:
    """Correlation of normal scores (one a row) and an ordinal margin: ``counts`` is rows by categories."""
    z, n = np.asarray(scores, float)[:, None], np.asarray(counts, float)
    if (n.sum(axis=0) > 0).sum() < 2:
        return float("nan")
    low, high = np.clip(cuts[:-1], -38, 38), np.clip(cuts[1:], -38, 38)

    def loss(r: float) -> float:
        s = np.sqrt(1 - r * r)
        p = norm_cdf((high - r * z) / s) - norm_cdf((low - r * z) / s)
        return -float((n * np.log(np.maximum(p, 1e-300))).sum())

    return golden(loss)


def polychoric(counts, cuts_a, cuts_b) -> float:
    """Correlation behind a contingency table; only corners of observed cells are integrated."""
    n = np.asarray(counts, float)
    if (n.sum(axis=0) > 0).sum() < 2 or (n.sum(axis=1) > 0).sum() < 2:
        return float("nan")
    i, j = np.nonzero(n)

    def loss(r: float) -> float:
        corner = lambda a, b: bivariate_normal_cdf(cuts_a[a], cuts_b[b], r)
        p = corner(i + 1, j + 1) - corner(i, j + 1) - corner(i + 1, j) + corner(i, j)
        return -float((n[i, j] * np.log(np.maximum(p, 1e-300))).sum())

    return golden(loss)


def kendall_correlations(X: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """Kendall's tau-a of the columns of X over jointly observed rows, in row blocks of bounded size."""
    n, d = X.shape
    seen = np.isfinite(X)
    out, block = np.zeros((d, d)), max(1, cells // max(1, n * d))
    Xf = np.where(seen, X, 0.0)
    for a in range(0, n, block):
        sign = np.sign(Xf[a : a + block, None, :] - Xf[None, :, :]) * (seen[a : a + block, None, :] & seen[None, :, :])
        flat = sign.reshape(-1, d)
        out += flat.T @ flat
    joint = seen.T.astype(float) @ seen
    with np.errstate(divide="ignore", invalid="ignore"):
        return out / (joint * (joint - 1))
