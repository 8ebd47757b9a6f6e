"""Singular values and right singular vectors of a small square matrix by way of a bidiagonal one, in numpy.

The matrix is the triangular factor of a QR decomposition, so its size is that of a vector, never that of a table.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and p with r = u b p', b upper bidiagonal, by Householder reflections from both sides."""
    a = np.array(r, dtype=float)
    n = a.shape[1]
    p = np.eye(n)

    def reflection(x):
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = v @ v
        return v, 2 / size if size > 0 else 0.0

    for k in range(n):
        v, f = reflection(a[k:, k])
        a[k:, k:] -= f * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            v, f = reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= f * np.outer(a[k:, k + 1 :] @ v, v)
            p[:, k + 1 :] -= f * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _transform(q: list[float], e: list[float], lo: int, hi: int, shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd step with a shift over q[lo..hi]; None where the shift is over the least value."""
    qq, ee = [], []
    d = q[lo] - shift
    least = d
    for i in range(lo, hi):
        if d < 0:
            return None
        s = d + e[i]
        qq.append(s)
        t = q[i + 1] / s if s > 0 else 0.0
        ee.append(e[i] * t)
        d = d * t - shift
        least = min(least, d)
    if d < 0 or not d < np.inf:
        return None
    qq.append(d)
    return qq, ee, least


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """All singular values of an upper bidiagonal matrix, falling, by dqds with splitting and deflation.

    Shifts come from the last two rows of a block; one that proves too large is cut, to none at last, which never fails.
    """
    scale = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(above).max(initial=0)))
    if scale == 0:
        return np.zeros(len(diagonal))
    q, e = ((diagonal / scale) ** 2).tolist(), ((above / scale) ** 2).tolist()
    found: list[float] = []
    blocks = [(0, len(q) - 1, 0.0)]
    steps, most = 0, 200 * len(q) + 1000
    while blocks:
        lo, hi, base = blocks.pop()  # of this block, base has been taken off
        while hi >= lo:
            split = None
            for i in range(hi - 1, lo - 1, -1):
                if e[i] <= EPS * EPS * (q[i] + q[i + 1] + base):
                    e[i], split = 0.0, i
                    break
            if split is not None and split < hi - 1:
                blocks.append((lo, split, base))
                lo = split + 1
                continue
            if split == hi - 1 or hi == lo:
                found.append(base + max(q[hi], 0.0))
                hi -= 1
                continue
            # the lesser eigenvalue of the last two rows of the squared matrix, less what ties them to the others
            a, b, c = q[hi - 1] + e[hi - 1], q[hi], q[hi - 1] * q[hi]
            half = (a + b) / 2
            root = max(half * half - c, 0.0) ** 0.5
            shift = c / (half + root) if half + root > 0 else 0.0
            for part in (1 - 1e-15, 0.98, 0.7, 0.25, 0.02, 0.0):
                done = _transform(q, e, lo, hi, shift * part)
                if done:
                    break
            if not done:  # only rounding of a vanishing last value
                done = (q[lo : hi + 1], e[lo:hi], 0.0)
                e[hi - 1], part = 0.0, 0.0
                done[1][-1] = 0.0
            q[lo : hi + 1], e[lo:hi], _ = done
            base += shift * part
            steps += 1
            if steps > most:
                raise ArithmeticError("dqds did not settle")
    return scale * np.sqrt(np.sort(np.array(found))[::-1])


def _twisted(d: np.ndarray, low: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of L D L' - lam, for each lam: multipliers of the stationary and the progressive factorisation, and gamma at each twist."""
    n, m, tiny = len(d), len(lam), np.finfo(float).tiny * 1e10
    s, p = np.empty((n, m)), np.empty((n, m))
    plus, minus = np.empty((max(n - 1, 0), m)), np.empty((max(n - 1, 0), m))
    s[0], p[-1] = -lam, d[-1] - lam
    guard = lambda x: np.where(np.abs(x) < tiny, np.copysign(tiny, x), x)
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(n - 1):
            plus[i] = d[i] * low[i] / guard(s[i] + d[i])
            s[i + 1] = np.nan_to_num(plus[i] * low[i] * s[i], nan=0.0) - lam
        for i in range(n - 2, -1, -1):
            t = d[i] / guard(d[i] * low[i] ** 2 + p[i + 1])
            minus[i] = low[i] * t
            p[i] = np.nan_to_num(p[i + 1] * t, nan=0.0) - lam
        return plus, minus, np.nan_to_num(s + p + lam, nan=np.inf)


def _vector(plus: np.ndarray, minus: np.ndarray, r: int) -> np.ndarray:
    """The solution of the twisted system with 1 at the twist, normalised."""
    n = len(plus) + 1
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
        if abs(z[i + 1]) > 1e100:
            z /= abs(z[i + 1])
    return z / np.linalg.norm(z)


def _rotate(b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Turn the columns of z, a basis of some right singular vectors' span, until their images under b are orthogonal (one-sided Jacobi)."""
    z = np.linalg.qr(z)[0]
    w = b @ z
    for _ in range(30):
        turned = False
        for i in range(z.shape[1] - 1):
            for j in range(i + 1, z.shape[1]):
                x, y, c = w[:, i] @ w[:, i], w[:, j] @ w[:, j], w[:, i] @ w[:, j]
                if abs(c) <= 4 * EPS * np.sqrt(x * y):
                    continue
                t = (y - x) / (2 * c)
                t = np.copysign(1.0, t) / (abs(t) + np.sqrt(1 + t * t))
                cos = 1 / np.sqrt(1 + t * t)
                turn = np.array([[cos, cos * t], [-cos * t, cos]])
                w[:, [i, j]], z[:, [i, j]] = w[:, [i, j]] @ turn, z[:, [i, j]] @ turn
                turned = True
        if not turned:
            break
    order = np.argsort(-np.linalg.norm(w, axis=0), kind="stable")
    return z[:, order]


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, near: float = 1e-6) -> np.ndarray:
    """Right singular vectors of an upper bidiagonal matrix for its falling, positive singular values, as columns.

    Each is the solution of a twisted factorisation of b'b less its square, at the twist of the least gamma, whose
    Rayleigh correction is applied twice. Values that lie within `near` of each other, relatively, get twists apart, are made
    orthogonal together and turned within their span.
    """
    n = len(diagonal)
    b = np.diag(diagonal) + np.diag(above, 1)
    d, low = diagonal**2, above / diagonal[:-1]
    lam = values**2
    for _ in range(3):
        plus, minus, gamma = _twisted(d, low, lam)
        twist = np.abs(gamma).argmin(axis=0)
        z = np.stack([_vector(plus[:, j], minus[:, j], twist[j]) for j in range(len(lam))], axis=1) if len(lam) else np.zeros((n, 0))
        step = gamma[twist, np.arange(len(lam))] * z[twist, np.arange(len(lam))] ** 2
        lam = np.where(np.abs(step) < 1e-10 * lam, lam + step, lam)
    first = 0
    for stop in range(1, len(lam) + 1):
        if stop < len(lam) and lam[stop - 1] - lam[stop] <= near * lam[stop - 1]:
            continue
        if stop - first > 1:
            room = np.ones(n)  # what of each unit vector the chosen ones leave
            chosen = np.zeros((n, 0))
            for j in range(first, stop):
                r = int(np.argmax(np.maximum(room, 0) / np.maximum(np.abs(gamma[:, j]), np.finfo(float).tiny)))
                x = _vector(plus[:, j], minus[:, j], r)
                for _ in range(2):
                    x = x - chosen @ (chosen.T @ x)
                if np.linalg.norm(x) < 1e-8:  # nothing new: the unit vector that is left out most
                    x = np.eye(n)[int(np.argmax(room))]
                    x = x - chosen @ (chosen.T @ x)
                x /= np.linalg.norm(x)
                chosen = np.concatenate([chosen, x[:, None]], axis=1)
                room = room - x * x
            z[:, first:stop] = _rotate(b, chosen)
        first = stop
    if z.shape[1] and np.abs(z.T @ z - np.eye(z.shape[1])).max() > 1e-9:
        z = _rotate(b, z)
    return z


def singular_system(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling singular values of r that aren't zero to rounding, and their right singular vectors as columns."""
    n = r.shape[1]
    size = np.abs(r).max(initial=0)
    if not n or size == 0:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, above, p = bidiagonalise(r / size)
    floor = EPS * np.sqrt((diagonal**2).sum() + (above**2).sum())
    diagonal = np.where(np.abs(diagonal) < floor / 8, np.copysign(floor / 8, diagonal), diagonal)  # as twisting divides by them
    values = singular_values(diagonal, above)
    values = values[values > 8 * n * floor]
    z = right_vectors(diagonal, above, values)
    return size * np.linalg.norm((np.diag(diagonal) + np.diag(above, 1)) @ z, axis=0), p @ z
