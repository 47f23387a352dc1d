"""Small correlation-matrix algebra on the driver."""

from __future__ import annotations

import numpy as np


def to_correlation(A: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(A))
    R = A / np.outer(d, d)
    np.fill_diagonal(R, 1.0)
    return (R + R.T) / 2


def eigen_floor(R: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Raise eigenvalues to ``eps`` and rescale to a unit diagonal."""
    w, V = np.linalg.eigh((R + R.T) / 2)
    return to_correlation((V * np.maximum(w, eps)) @ V.T)


def nearest_correlation(R: np.ndarray, tol: float = 1e-9, turns: int = 500) -> np.ndarray:
    """Nearest correlation matrix by alternating projections with Dykstra's correction."""
    Y, S = R.copy(), np.zeros_like(R)
    for _ in range(turns):
        X0 = Y - S
        w, V = np.linalg.eigh((X0 + X0.T) / 2)
        X = (V * np.maximum(w, 0)) @ V.T
        S = X - X0
        last, Y = Y, X.copy()
        np.fill_diagonal(Y, 1.0)
        if np.abs(Y - last).max() < tol:
            break
    return Y


def make_pd(R: np.ndarray, method: str = "auto", eps: float = 1e-6) -> np.ndarray:
    """A positive definite correlation matrix; one that is already so comes back unchanged.

    ``method``: auto or higham (nearest, then floor), eigen (floor only), none (raise)."""
    if np.linalg.eigvalsh(R).min() >= eps:
        return R
    if method == "none":
        raise ValueError("the correlation matrix is not positive definite")
    return eigen_floor(R if method == "eigen" else nearest_correlation(R), eps)


def complete_correlation(R: np.ndarray, unknown: np.ndarray, tol: float = 1e-10, turns: int = 500) -> tuple[np.ndarray, str]:
    """Fill unidentified entries so that the determinant is largest (no partial correlation
    between the pair); zeros where the identified entries admit no such matrix."""
    if not unknown.any():
        return R, "none"
    S = np.where(unknown, 0.0, R)
    W, d = S.copy(), len(S)
    try:
        for _ in range(turns):
            before = W.copy()
            for j in range(d):
                others = np.array([i for i in range(d) if i != j])
                near = np.array([i for i in others if not unknown[i, j]], int)
                row = W[np.ix_(others, near)] @ np.linalg.solve(W[np.ix_(near, near)], S[near, j]) if len(near) else np.zeros(len(others))
                W[others, j] = W[j, others] = row
            if np.abs(W - before).max() < tol:
                break
        good = np.isfinite(W).all() and np.linalg.eigvalsh(W).min() > 0 and np.abs((W - S)[~unknown]).max() <= 1e-6
    except np.linalg.LinAlgError:
        good = False
    return (W, "max_determinant") if good else (S, "zero_fallback")


def matrix_root(S: np.ndarray) -> np.ndarray:
    """A with A @ A.T = S for a positive semi-definite S."""
    w, V = np.linalg.eigh((S + S.T) / 2)
    if w.min() < -1e-8 * max(1.0, w.max()):
        raise ValueError("sigma must be positive semi-definite")
    return V * np.sqrt(np.maximum(w, 0))
