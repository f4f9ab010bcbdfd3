"""Singular values and right singular vectors of a small square matrix by its bidiagonal form.

Householder reflections make the matrix bidiagonal, the differential quotient-difference algorithm with shifts (dqds,
Fernando and Parlett 1994) finds the squares of the singular values to high relative accuracy, and a twisted factorisation
(Dhillon and Parlett 2004) gives each vector. The matrix has one row and column per dimension of the data.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
# Values closer than this, relative to each other, get their vectors by inverse iteration with orthogonalisation.
CLUSTER = 1e-5


def _reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector v with (I - 2 v v') x = (length, 0, ..., 0), and that length with its sign."""
    size = np.linalg.norm(x)
    if size == 0 or not np.any(x[1:]):
        return np.zeros_like(x), float(x[0])
    v = x.copy()
    length = -math.copysign(size, x[0])
    v[0] -= length
    return v / np.linalg.norm(v), length


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal, and the right factor Q: ``matrix = P B Q'`` with orthogonal P and Q."""
    a = matrix.astype(float).copy()
    n = len(a)
    diagonal, upper, right = np.zeros(n), np.zeros(max(0, n - 1)), np.eye(n)
    for k in range(n):
        v, diagonal[k] = _reflection(a[k:, k])
        a[k:, k + 1 :] -= 2 * np.outer(v, v @ a[k:, k + 1 :])
        if k < n - 1:
            w, upper[k] = _reflection(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ w, w)
    return diagonal, upper, right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds transform; the third list holds the auxiliary d, which is negative where the shift was too large."""
    new_q, new_e, seen, d = [], [], [], q[0] - shift
    for i, upper in enumerate(e):
        seen.append(d)
        total = d + upper
        new_q.append(total)
        if total == 0:  # nothing left in this row: the rest stands alone
            new_e.append(0.0)
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / total
            new_e.append(upper * ratio)
            d = d * ratio - shift
    return [*new_q, d], new_e, [*seen, d]


def _smallest_of_two(a: float, b2: float, c: float) -> float:
    """The smaller eigenvalue of a symmetric 2 x 2 matrix with the square ``b2`` of its other entry."""
    half, mean = (a - c) / 2, (a + c) / 2
    return mean - math.sqrt(half * half + b2)


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> list[float]:
    """Squares of the singular values of an upper bidiagonal matrix, in no order."""
    found: list[float] = []
    waiting = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    while waiting:
        q, e, moved = waiting.pop()
        while True:
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            small = EPS * EPS
            if e[-1] <= small * (moved + q[-1]):
                found.append(q.pop() + moved)
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * moved or e[i] == 0.0), None)
            if cut is not None:
                waiting.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            before = e[-2] if len(e) > 1 else 0.0
            shift = max(0.0, _smallest_of_two(q[-2] + before, q[-2] * e[-1], q[-1] + e[-1]))
            if min(q) == 0.0:
                shift = 0.0
            for attempt in range(4):
                new_q, new_e, seen = _sweep(q, e, shift)
                if min(seen) >= 0 or shift == 0.0:
                    break
                # Failing in the last step alone, the transform tells a shift that is small enough.
                late = min(seen[:-1]) >= 0 and shift + seen[-1] > 0
                shift = shift + seen[-1] if late and attempt == 0 else shift / 4 if attempt < 2 else 0.0
            q, e, moved = [max(x, 0.0) for x in new_q], new_e, moved + shift
    return found


def _twisted(q: np.ndarray, ratio: np.ndarray, value: float) -> np.ndarray:
    """Eigenvector of L D L' for ``value``, with D = ``q`` and the subdiagonal ``ratio`` of L: forward and backward factors
    are joined where the remaining pivot is smallest."""
    n = len(q)
    tiny = np.finfo(float).tiny
    s, below = np.empty(n), np.empty(max(0, n - 1))
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + q[i] or tiny
        below[i] = q[i] * ratio[i] / pivot
        s[i + 1] = below[i] * ratio[i] * s[i] - value
    p, above = np.empty(n), np.empty(max(0, n - 1))
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * ratio[i] ** 2 + p[i + 1] or tiny
        above[i] = ratio[i] * q[i] / pivot
        p[i] = p[i + 1] * q[i] / pivot - value
    at = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -below[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -above[i] * z[i]
    return z / np.linalg.norm(z)


def _inverse_iteration(matrix: np.ndarray, value: float, others: list[np.ndarray], number: int) -> np.ndarray:
    z = np.random.default_rng(number).normal(size=len(matrix))
    scale = max(np.abs(matrix).max(), np.finfo(float).tiny)
    shifted = matrix - (value + (number + 1) * 4 * EPS * scale) * np.eye(len(matrix))
    for _ in range(3):
        z = np.linalg.solve(shifted, z / np.linalg.norm(z))
        for _ in range(2):
            for other in others:
                z = z - (other @ z) * other
    return z / np.linalg.norm(z)


def _block(diagonal: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (falling) and eigenvectors (columns) of B'B for a bidiagonal B without zeros beside its diagonal."""
    values = np.array(sorted(dqds(diagonal, upper), reverse=True))
    least = EPS * max(np.abs(diagonal).max(), np.abs(upper).max(initial=0.0), np.finfo(float).tiny)
    kept = np.where(np.abs(diagonal) < least, least, diagonal)
    q, ratio = kept**2, upper / kept[:-1]
    vectors, cluster = [], []
    dense = None
    for k, value in enumerate(values):
        near = k and values[k - 1] - value <= CLUSTER * values[k - 1]
        ahead = k + 1 < len(values) and value - values[k + 1] <= CLUSTER * value
        cluster = [*cluster, vectors[-1]] if near else []
        if near or ahead:
            if dense is None:
                b = np.diag(diagonal) + np.diag(upper, 1)
                dense = b.T @ b
            vectors.append(_inverse_iteration(dense, value, cluster, len(cluster)))
        else:
            vectors.append(_twisted(q, ratio, value))
    return values, np.array(vectors).T


def right_singular(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values, falling, and the right singular vectors as columns."""
    n = len(matrix)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    diagonal, upper, right = bidiagonalise(matrix)
    beside = np.abs(diagonal)
    cuts = np.flatnonzero(np.abs(upper) <= EPS * (beside[:-1] + beside[1:])) + 1
    values, vectors = [], np.zeros((n, n))
    for begin, end in zip([0, *cuts], [*cuts, n]):
        found, z = _block(diagonal[begin:end], upper[begin : end - 1])
        vectors[begin:end, len(values) : len(values) + len(found)] = z
        values.extend(found)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], right @ vectors[:, order]
