"""Driver-side algebra on rank-sized matrices only (r x r Grams, the r0*r1*r2
core). Nothing here ever sees a row of the tensor or of a factor table."""

from __future__ import annotations

import numpy as np

from .index import other_modes

# A column is linearly dependent if what the columns before it leave of it has
# at most this share of its own squared norm.
PIVOT_TOL = 1e-12


def unit_columns(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Gram matrix of the same columns at unit norm, and what each column
    is multiplied by for that (0 for a zero column)."""
    if not np.all(np.isfinite(gram)):
        raise ValueError("a factor table has non-finite values")
    norms = np.sqrt(np.diag(gram)) if gram.size else np.zeros(0)
    factors = np.divide(1.0, norms, out=np.zeros_like(norms), where=norms > 0)
    return gram * factors[:, None] * factors[None, :], factors


def mgs_transform(gram: np.ndarray, tol: float = PIVOT_TOL) -> tuple[np.ndarray, bool]:
    """Modified Gram-Schmidt carried out on a Gram matrix.

    Returns ``T`` with ``Q = A @ T`` orthonormal (positive diagonal, the same
    Q as column MGS on A) and a flag for dependent columns; such a column is
    set to zero instead of being divided by a zero norm. Columns are brought
    to unit norm first, so scaling the table or a column changes nothing.
    Non-finite values fail.
    """
    gram, factors = unit_columns(gram)
    r = gram.shape[0]
    t = np.eye(r)
    deficient = False
    for a in range(r):
        norm2 = float(t[:, a] @ gram @ t[:, a])
        if norm2 <= tol:
            t[:, a] = 0.0
            deficient = True
            continue
        t[:, a] /= np.sqrt(norm2)
        for b in range(a + 1, r):
            proj = float(t[:, a] @ gram @ t[:, b])
            t[:, b] -= proj * t[:, a]
    return factors[:, None] * t, deficient


# The same limit where the columns themselves are at hand and not their products:
# a column is dependent if at most this share of its norm is left.
REMAINDER_TOL = 1e-12


def mgs_of_triangle(triangle: np.ndarray, tol: float = REMAINDER_TOL) -> tuple[np.ndarray, bool]:
    """``T`` and the flag of :func:`mgs_transform` for a table of which
    ``triangle`` is an R factor: its columns are the table's in an orthonormal
    basis, so Gram-Schmidt on them is that on the table, and what is left of a
    column is found to the precision of the values, not to its square root."""
    if not np.all(np.isfinite(triangle)):
        raise ValueError("a factor table has non-finite values")
    norms = np.linalg.norm(triangle, axis=0)
    factors = np.divide(1.0, norms, out=np.zeros_like(norms), where=norms > 0)
    v, t = triangle * factors, np.diag(factors)
    deficient = False
    for a in range(len(norms)):
        for b in range(a):  # a second time: what the first left of the columns before is rounding
            proj = float(v[:, b] @ v[:, a])
            v[:, a] -= proj * v[:, b]
            t[:, a] -= proj * t[:, b]
        left = float(np.linalg.norm(v[:, a]))
        if left <= tol:
            v[:, a] = t[:, a] = 0.0
            deficient = True
            continue
        v[:, a] /= left
        t[:, a] /= left
        for b in range(a + 1, len(norms)):
            proj = float(v[:, a] @ v[:, b])
            v[:, b] -= proj * v[:, a]
            t[:, b] -= proj * t[:, a]
    return t, deficient


def unfold(core: np.ndarray, mode: int) -> np.ndarray:
    """Mode unfolding: row x_mode, column x_a + x_b * r_a (a < b the other modes)."""
    a, b = other_modes(mode)
    moved = np.transpose(core, (mode, a, b))
    return moved.reshape(core.shape[mode], core.shape[a] * core.shape[b], order="F")


def fold(mat: np.ndarray, mode: int, shape) -> np.ndarray:
    a, b = other_modes(mode)
    moved = mat.reshape(shape[mode], shape[a], shape[b], order="F")
    out = np.empty(shape)
    perm = (mode, a, b)
    inv = np.argsort(perm)
    out[...] = np.transpose(moved, inv)
    return out


def mode_product(core: np.ndarray, m: np.ndarray, mode: int) -> np.ndarray:
    """``core x_mode m``: unfold, left-multiply, fold back (new size m.shape[0])."""
    shape = list(core.shape)
    res = m @ unfold(core, mode)
    shape[mode] = m.shape[0]
    return fold(res, mode, shape)


def core_pinv(core: np.ndarray, mode: int) -> np.ndarray:
    """Pseudo-inverse of the mode unfolding: (r_a*r_b) x r_mode."""
    return np.linalg.pinv(unfold(core, mode))
