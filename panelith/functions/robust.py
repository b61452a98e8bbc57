"""Small dense kernels for robust profiles."""

from __future__ import annotations

import numpy as np


def robust_pca(d: np.ndarray, all_along: float = 0.5, tol: float = 1e-6, iterations: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """d as a low-rank and a sparse part, by principal component pursuit (augmented Lagrangian).

    The sparse part's weight is 1 / sqrt(all_along m k), for m rows whose mean spreads over k columns (the inverse of its
    concentration): the mean is cheaper in the low-rank part if that share of the rows has it, however few columns hold it,
    and what few rows have is cheaper in the sparse one. Singular values come from the smaller Gram matrix.
    """
    norm = np.linalg.norm(d)
    if norm == 0:
        return d.copy(), np.zeros_like(d)
    mean = np.abs(d).mean(0)
    lam = 1 / np.sqrt(all_along * d.shape[0] * mean.sum() ** 2 / (mean**2).sum())
    spectral = np.linalg.norm(d, 2)
    y = d / max(spectral, np.abs(d).max() / lam)
    mu, top = 1.25 / spectral, 1.25e7 / spectral
    s = np.zeros_like(d)
    for _ in range(iterations):
        x = d - s + y / mu
        wide = x.shape[0] < x.shape[1]
        value, vector = np.linalg.eigh(x @ x.T if wide else x.T @ x)
        sv = np.sqrt(np.maximum(value, 0))
        v = vector[:, sv > 1 / mu]
        shrunk = v * (1 - 1 / (mu * sv[sv > 1 / mu]))
        low = shrunk @ (v.T @ x) if wide else (x @ shrunk) @ v.T
        rest = d - low + y / mu
        s = np.sign(rest) * np.maximum(np.abs(rest) - lam / mu, 0)
        gap = d - low - s
        y, mu = y + mu * gap, min(mu * 1.5, top)
        if np.linalg.norm(gap) < tol * norm:
            break
    return low, s


def segments(on: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """First and last index of each stretch of true entries; stretches at most gap false entries apart are one."""
    at = np.flatnonzero(on)
    if not at.size:
        return []
    cuts = np.flatnonzero(np.diff(at) > gap + 1)
    return list(zip(at[np.r_[0, cuts + 1]].tolist(), at[np.r_[cuts, at.size - 1]].tolist(), strict=True))


def weighted_quantiles(x: np.ndarray, w: np.ndarray, q: list[float]) -> np.ndarray:
    """Values of ascending x at which the cumulated weight first reaches each share of the total."""
    c = np.cumsum(w)
    return x[np.minimum(np.searchsorted(c, np.asarray(q) * c[-1]), x.size - 1)]
