"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, Sturm-count bisection, inverse iteration."""

from __future__ import annotations

import math

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues closer than this part of the norm form a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
#: Steps of inverse iteration. Each one reduces what other eigenvectors contribute by the ratio of a gap to rounding.
_STEPS = 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``matrix``, and the reflectors used."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    reflectors: list[np.ndarray | None] = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        largest = float(np.abs(v[1:]).max())
        if largest == 0.0:
            reflectors.append(None)
            continue
        scale = max(largest, abs(float(v[0])))
        v /= scale
        norm = math.copysign(math.sqrt(float(v @ v)), float(v[0]))
        v[0] += norm
        v /= math.sqrt(float(v @ v))
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - float(v @ p) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -norm * scale
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each point: the negative pivots of its shifted factors."""
    tiny = _EPS * _EPS * max(1e-300, float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)))
    pivot = diagonal[0] - points
    counts = (pivot < 0).astype(np.int64)
    for d, square in zip(diagonal[1:], off * off, strict=True):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - points - square / pivot
        counts += pivot < 0
    return counts


def largest_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its bounds are neighbours."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    width = float((np.abs(diagonal) + reach).max()) * (1 + 4 * _EPS) + 1e-300
    low, high = np.full(k, -width), np.full(k, width)
    wanted = n - 1 - np.arange(k)
    for _ in range(1200):
        middle = low + (high - low) / 2
        above = sturm_counts(diagonal, off, middle) > wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
        if (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)) + _EPS * _EPS * width).all():
            break
    return low + (high - low) / 2


def _solve(diagonal: list[float], off: list[float], shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) x = right by elimination with row exchanges; pivots below ``least`` are raised to it."""
    n = len(diagonal)
    main = [d - shift for d in diagonal]
    first, second = [*off, 0.0], [0.0] * n
    x = right.tolist()
    for i in range(n - 1):
        below = off[i]
        if abs(main[i]) >= abs(below):
            if abs(main[i]) < least:
                main[i] = math.copysign(least, main[i])
            factor = below / main[i]
            main[i + 1] -= factor * first[i]
            x[i + 1] -= factor * x[i]
        else:
            factor = main[i] / below
            main[i], first[i], main[i + 1] = below, main[i + 1], first[i] - factor * main[i + 1]
            second[i], first[i + 1] = first[i + 1], -factor * first[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
    for i in range(n - 1, -1, -1):
        if abs(main[i]) < least:
            main[i] = math.copysign(least, main[i])
        total = x[i]
        if i + 1 < n:
            total -= first[i] * x[i + 1]
        if i + 2 < n:
            total -= second[i] * x[i + 2]
        x[i] = total / main[i]
    return np.array(x)


def _vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of a tridiagonal matrix for falling ``values``, as columns."""
    n = len(diagonal)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)) or 1.0
    rng = np.random.default_rng(7)
    found = np.zeros((n, len(values)))
    start, before = 0, math.inf
    main, side = diagonal.tolist(), off.tolist()
    for j, value in enumerate(values.tolist()):
        if before - value > CLUSTER * norm:
            start = j
        # equal values are set apart by a rounding error, so that their factors differ
        shift = min(value, before - 4 * _EPS * norm) if j > start else value
        before = shift
        x = rng.standard_normal(n)
        for _ in range(_STEPS):
            for _ in range(2):
                x = x - found[:, start:j] @ (found[:, start:j].T @ x)
            x = _solve(main, side, shift, x / np.linalg.norm(x), _EPS * norm)
            x /= np.abs(x).max()
        for _ in range(2):
            x = x - found[:, start:j] @ (found[:, start:j].T @ x)
        found[:, j] = x / np.linalg.norm(x)
    return found


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    All eigenvalues if it has fewer. Vectors of equal eigenvalues are some orthonormal basis of their space.
    """
    n = len(matrix)
    k = min(k, n)
    if not k:
        return np.zeros(0), np.zeros((n, 0))
    scale = float(np.abs(matrix).max())
    if scale == 0.0:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = largest_values(diagonal, off, k)
    vectors = _vectors(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        if v is not None:
            vectors[at + 1 :] -= 2.0 * np.outer(v, v @ vectors[at + 1 :])
    return values * scale, vectors
