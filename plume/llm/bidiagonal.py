"""Singular values and right singular vectors of a small matrix: Householder, differential qd with shifts, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Neighbouring values of a smaller relative gap are a cluster, whose vectors are made orthogonal.
RELATIVE_GAP = 1e-3


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """u and beta such that (1 - beta u u') x has zeros but in its first place."""
    u = x.copy()
    scale = np.abs(x).max(initial=0.0)
    if scale == 0:
        return u, 0.0
    u /= scale
    u[0] += np.copysign(np.sqrt(u @ u), u[0])
    return u, 2 / (u @ u)


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V of a square r = U B V'."""
    a, n = np.array(r, dtype=float), len(r)
    v = np.eye(n)
    for k in range(n):
        u, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            w, beta = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ w, w)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int]:
    """One differential qd transform with a shift, and the place at which it fails (a value below zero), or -1."""
    n, d = len(q), q[0] - shift
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        if d < 0:
            new_q[-1] = d
            return new_q, new_e, i
        new_q[i] = d + e[i]
        if new_q[i] == 0:
            t = 0.0
        else:
            t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = (d * t if new_q[i] else q[i + 1]) - shift
    new_q[-1] = d
    return new_q, new_e, n - 1 if d < 0 else -1


def least_of_two(q: list[float], e: float) -> tuple[float, float]:
    """Smaller and larger eigenvalue of the last two rows of L U with diagonal q and products e."""
    a, b = q
    high = 0.5 * (a + b + e + np.hypot(a - b + e, 2 * np.sqrt(b * e)))
    return (a * (b / high) if high > 0 else 0.0), high


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values, falling, of an upper bidiagonal matrix, each to high relative accuracy.

    Differential qd transforms keep all quantities positive, and shifts are
    taken back where they would not; a value is split off at the end once
    what couples it is negligible.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    q, e = ((diagonal / scale) ** 2).tolist(), ((above / scale) ** 2).tolist()
    found: list[float] = []
    # blocks still to do: q, e and the sum of the shifts taken off
    todo = [(q, e, 0.0)]
    while todo:
        q, e, taken = todo.pop()
        rounds = 0
        while q:
            n = len(q)
            if n == 1:
                found.append(taken + q[0])
                break
            if n == 2:
                low, high = least_of_two(q, e[0])
                found.extend((taken + low, taken + high))
                break
            if e[-1] <= EPS**2 * (taken + q[-1]):
                found.append(taken + q.pop())
                e.pop()
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS**2 * (taken + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], taken))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = least_of_two(q[-2:], e[-1])[0] if rounds else 0.0
            rounds += 1
            for attempt in range(4):
                new_q, new_e, failed = sweep(q, e, shift)
                if failed < 0:
                    break
                # what is left at the end of a failed sweep is below zero by about as much as the shift was too large
                shift = max(0.0, shift + new_q[-1]) * (1 - 1e-3) if failed == n - 1 and attempt < 2 else 0.25 * shift if attempt < 2 else 0.0
            q, e, taken = new_q, new_e, taken + shift
    return scale * np.sqrt(np.sort(np.maximum(found, 0))[::-1])


class Twisted:
    """The factorisation N D N' of L D L' - x, twisted where its middle value is least."""

    def __init__(self, d: np.ndarray, low: np.ndarray, x: float) -> None:
        n = len(d)
        s, p = [0.0] * n, [0.0] * n
        self.down, self.up = [0.0] * n, [0.0] * n  # D+ and D-
        self.lower, self.upper = [0.0] * (n - 1), [0.0] * (n - 1)  # L+ and U-
        d, low, small = d.tolist(), low.tolist(), EPS**2 * x
        s[0] = -x
        for i in range(n):
            self.down[i] = d[i] + s[i] or small
            if i < n - 1:
                self.lower[i] = low[i] * d[i] / self.down[i]
                s[i + 1] = self.lower[i] * low[i] * s[i] - x
        p[-1] = d[-1] - x
        for i in range(n - 2, -1, -1):
            self.up[i + 1] = low[i] ** 2 * d[i] + p[i + 1] or small
            self.upper[i] = low[i] * d[i] / self.up[i + 1]
            p[i] = p[i + 1] * d[i] / self.up[i + 1] - x
        middle = np.abs(np.array(s) + np.array(p) + x)
        self.k = int(np.nanargmin(middle))
        self.gamma = s[self.k] + p[self.k] + x or small

    def vector(self) -> np.ndarray:
        """The vector that N' takes to the unit vector of the twist."""
        z = np.zeros(len(self.down))
        z[self.k] = 1.0
        for i in range(self.k - 1, -1, -1):
            z[i] = -self.lower[i] * z[i + 1]
        for i in range(self.k, len(z) - 1):
            z[i + 1] = -self.upper[i] * z[i]
        return z

    def solve(self, y: np.ndarray) -> np.ndarray:
        """One step of inverse iteration."""
        k, n, w = self.k, len(y), y.astype(float).copy()
        for i in range(k):
            w[i + 1] -= self.lower[i] * w[i]
        for i in range(n - 2, k - 1, -1):
            w[i] -= self.upper[i] * w[i + 1]
        w[:k] /= self.down[:k]
        w[k] /= self.gamma
        w[k + 1 :] /= self.up[k + 1 :]
        for i in range(k - 1, -1, -1):
            w[i] -= self.lower[i] * w[i + 1]
        for i in range(k, n - 1):
            w[i + 1] -= self.upper[i] * w[i]
        return w


def vectors_of_block(a: np.ndarray, b: np.ndarray, values: np.ndarray, wanted: int) -> np.ndarray:
    """Right singular vectors (columns) of the first ``wanted`` values of an unreduced bidiagonal matrix, and of all in their clusters."""
    d, low = a**2, b / a[:-1]
    out, cluster = np.zeros((len(a), 0)), 0
    for k, value in enumerate(values):
        x = value**2
        if k and values[k - 1] ** 2 - x > RELATIVE_GAP * values[k - 1] ** 2:
            cluster = k
            if k >= wanted:
                break
        for _ in range(3):
            form = Twisted(d, low, x)
            z = form.vector()
            step = form.gamma / (z @ z)
            if not np.isfinite(step) or abs(step) <= 2 * EPS * x or abs(step) > 1e-6 * x:
                break
            x += step
        z /= np.sqrt(z @ z)
        near = out[:, cluster:]
        for attempt in range(6):
            free = z - near @ (near.T @ z)
            free -= near @ (near.T @ free)
            size = np.sqrt(free @ free)
            z = free / size if size > 0 else free
            if size > 0.1:
                break
            # too much of it was in the cluster: another start
            z = np.random.default_rng(attempt).standard_normal(len(a))
            for _ in range(2):
                z -= near @ (near.T @ z)
                z = form.solve(z)
                z /= np.abs(z).max()
                z /= np.sqrt(z @ z)
        out = np.column_stack([out, z])
    return out


def leading_directions(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All singular values of square r, falling, and the first ``wanted`` of them with their right singular vectors as columns."""
    a, b, v = bidiagonalised(r)
    norm = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    signs = np.cumprod(np.concatenate([[1.0], np.where(a[:-1] * b < 0, -1.0, 1.0)]))
    a, b = np.maximum(np.abs(a), EPS * norm), np.abs(b)
    every, pairs, start = [], [], 0
    for end in [*(np.flatnonzero(b <= EPS * norm) + 1), len(a)]:
        if norm and end > start:
            values = dqds(a[start:end], b[start : end - 1])
            every.append(values)
            for value, z in zip(values, vectors_of_block(a[start:end], b[start : end - 1], values, wanted).T):
                pairs.append((value, start, end, z))
        start = end
    pairs.sort(key=lambda p: -p[0])
    pairs = pairs[:wanted]
    directions = np.zeros((len(a), len(pairs)))
    for k, (_, start, end, z) in enumerate(pairs):
        directions[:, k] = v[:, start:end] @ (signs[start:end] * z)
    return np.sort(np.concatenate(every))[::-1] if every else np.zeros(len(a)), np.array([p[0] for p in pairs]), directions
