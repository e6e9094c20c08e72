"""Small dense linear algebra for normal equations."""

from __future__ import annotations

import numpy as np

TOLERANCE = 1e-10


def independent_columns(gram: np.ndarray, tolerance: float = TOLERANCE) -> list[int]:
    """Columns of X'X to keep, scanned from the left: one goes when the columns kept before explain it, so the last redundant one goes.

    Twice-orthogonalised Gram-Schmidt; a column goes when what is left of it is under ``tolerance`` of its norm.
    """
    kept: list[int] = []
    basis: list[np.ndarray] = []
    scale = np.sqrt(np.maximum(np.diag(gram), 0))
    scale[scale == 0] = 1.0
    scaled = gram / np.outer(scale, scale)
    for j in range(gram.shape[0]):
        column = scaled[:, j].astype(float)
        size = np.linalg.norm(column)
        for _ in range(2):
            for q in basis:
                column = column - q * (q @ column)
        if size > 0 and np.linalg.norm(column) >= tolerance * size:
            kept.append(j)
            basis.append(column / np.linalg.norm(column))
    return kept


def solve_normal(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(beta, inverse of X'X): Cholesky on the scaled matrix, QR where that fails."""
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    scaled = gram / np.outer(scale, scale)
    try:
        low = np.linalg.cholesky(scaled)
        half = np.linalg.solve(low, np.eye(len(low)))
        inverse = half.T @ half
    except np.linalg.LinAlgError:
        q, r = np.linalg.qr(scaled)
        inverse = np.linalg.solve(r, q.T)
    inverse = inverse / np.outer(scale, scale)
    beta = inverse @ right
    beta = beta + inverse @ (right - gram @ beta)  # one step of refinement
    return beta, (inverse + inverse.T) / 2
