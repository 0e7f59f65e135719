"""Leading singular values and right singular vectors of a small triangle (operator 13).

Householder reflections from both sides make the matrix upper bidiagonal; dqds transforms
with shifts find all squared singular values to high relative accuracy; twisted
factorisations of the tridiagonal B'B at each of them give the vectors, which the reflections
carry back.  The matrix has one row and column per embedding dimension, so this is work of
dimension cubed on the driver, whatever the number of vectors.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v and t with (I - t v v') x = (value, 0, 0, ...); returns v, t, value."""
    size = np.linalg.norm(x)
    if len(x) < 2 or not np.any(x[1:]):
        return np.zeros(len(x)), 0.0, float(x[0]) if len(x) else 0.0
    value = -np.copysign(size, x[0])
    v = x / (x[0] - value)
    v[0] = 1.0
    return v, (value - x[0]) / value, float(value)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, float]]]:
    """Diagonal and superdiagonal of U'RV, and the reflections (from row k on) whose product is V."""
    a, n, right = r.astype(float).copy(), r.shape[1], []
    diagonal, above = np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        v, t, diagonal[k] = reflector(a[k:, k])
        a[k:, k + 1:] -= t * np.outer(v, v @ a[k:, k + 1:])
        if k + 1 < n:
            v, t, above[k] = reflector(a[k, k + 1:])
            a[k + 1:, k + 1:] -= t * np.outer(a[k + 1:, k + 1:] @ v, v)
            right.append((k + 1, v, t))
    return diagonal, above, right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One transform of (q, e) with a shift; None where the shift was too large."""
    out_q, out_e, d = [], [], q[0] - shift
    for i, off in enumerate(e):
        if not d >= 0.0:
            return None
        top = d + off
        if top == 0.0:
            out_q.append(0.0), out_e.append(0.0)
            d = q[i + 1] - shift
            continue
        ratio = q[i + 1] / top
        out_q.append(top), out_e.append(off * ratio)
        d = d * ratio - shift
    if not d >= 0.0:
        return None
    return [*out_q, d], out_e


def _least_of_two(a: float, b: float, off: float) -> float:
    """The smaller eigenvalue of the last two rows' qd product, from below."""
    trace, product = a + off + b, a * b
    root = max(trace * trace / 4 - product, 0.0) ** 0.5
    large = trace / 2 + root
    return product / large if large > 0 else 0.0


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """All of them, falling; dqds with deflation at the lower end of each unreduced part."""
    values: list[float] = []
    parts = [(0.0, [float(v) ** 2 for v in diagonal], [float(v) ** 2 for v in above])]
    while parts:
        gone, q, e = parts.pop()
        while q:
            if len(q) == 1:
                values.append(gone + q.pop())
                break
            if e[-1] <= (EPS * EPS) * (gone + q[-1]) or e[-1] <= EPS * EPS * q[-1]:
                values.append(gone + q.pop())
                e.pop()
                continue
            cut = next((i for i, off in enumerate(e) if off <= EPS * EPS * (gone + min(q[i], q[i + 1]))), None)
            if cut is not None:
                parts.append((gone, q[:cut + 1], e[:cut]))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] < q[-1]:                                  # large values to the front
                q, e = q[::-1], e[::-1]
            shift = 0.99 * min(_least_of_two(q[-2], q[-1], e[-1]), min(q))
            while True:
                step = _dqds(q, e, shift)
                if step:
                    break
                shift = 0.0 if shift < EPS * gone else shift / 4
            gone, (q, e) = gone + shift, step
    return np.sort(np.maximum(values, 0.0))[::-1]


def _twists(q: np.ndarray, link: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twisted factorisations of L D L' - value: multipliers from above, from below, pivots."""
    n, tiny = len(q), np.finfo(float).tiny / EPS
    down, up, s, p = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0)), np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, q[-1] - value
    for i in range(n - 1):
        pivot = s[i] + q[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = q[i] * link[i] / pivot
        s[i + 1] = down[i] * link[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * link[i] * link[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        t = q[i] / pivot
        up[i] = link[i] * t
        p[i] = p[i + 1] * t - value
    return down, up, s + p + value


def _solve(down: np.ndarray, up: np.ndarray, k: int) -> np.ndarray:
    z = np.zeros(len(down) + 1)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, len(up)):
        z[i + 1] = -up[i] * z[i]
    return z


def tridiagonal_vector(diagonal: np.ndarray, above: np.ndarray, value: float,
                       others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Unit eigenvector of B'B at ``value``, at right angles to ``others``, and its value made good.

    Values too close to tell apart share a twist; the next ones, by pivot, are taken until a
    vector is left that is not made of the others.
    """
    q = diagonal ** 2
    link = above / diagonal[:-1]
    tried: tuple[float, np.ndarray, float] | None = None
    for refine in range(3):
        down, up, pivots = _twists(q, link, value)
        order = np.argsort(np.abs(pivots), kind="stable")
        for k in order if refine == 2 or others else order[:1]:
            z = _solve(down, up, int(k))
            with np.errstate(over="ignore", invalid="ignore"):
                z /= np.abs(z).max()
            if not np.all(np.isfinite(z)):
                continue
            z /= np.linalg.norm(z)
            rest = z.copy()
            for o in [*others, *others]:
                rest -= (rest @ o) * o
            left = np.linalg.norm(rest)
            if tried is None or left > 2 * tried[0] or refine and left > 0.5:
                product = np.append(diagonal * rest / max(left, EPS), 0.0)[:len(diagonal)]
                product[:-1] += above * rest[1:] / max(left, EPS)
                tried = (left, rest / max(left, EPS), float(product @ product))
            if left > 0.5:
                break
        if tried and abs(tried[2] - value) <= 4 * EPS * abs(value):
            break
        if tried and tried[0] > 0.5:
            value = tried[2]
    return tried[1], value


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All squared singular values of ``r``, falling, and the right singular vectors of the first
    ``count`` that are not zero, as rows.  Each vector's largest entry is positive."""
    n = r.shape[1]
    diagonal, above, right = bidiagonalise(r)
    values = squared_singular_values(diagonal, above)
    size = float(np.sqrt(values[0])) if n and values[0] > 0 else 0.0
    if not size:
        return values, values[:0], np.zeros((0, n))
    wanted = values[:count][values[:count] > (n * EPS * size) ** 2]
    # an entry that is nothing next to the matrix splits it into parts of their own
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * size) + 1).tolist(), n]
    diagonal = np.where(np.abs(diagonal) <= EPS * size, EPS * size, diagonal)
    found: list[tuple[float, np.ndarray]] = []
    for lo, hi in zip(cuts, cuts[1:]):
        here: list[tuple[float, np.ndarray]] = []
        own = squared_singular_values(diagonal[lo:hi], above[lo:hi - 1])
        for value in own[:count]:
            if value < wanted[-1] * (1 - 1e-9):
                break
            close = [z[lo:hi] for v, z in here if abs(v - value) <= 1e-3 * value]
            z, _ = tridiagonal_vector(diagonal[lo:hi], above[lo:hi - 1], float(value), close)
            full = np.zeros(n)
            full[lo:hi] = z
            here.append((float(value), full))
        found += here
    found.sort(key=lambda f: -f[0])
    vectors = np.array([z for _, z in found[:len(wanted)]])
    for at, v, t in reversed(right):
        vectors[:, at:] -= t * np.outer(vectors[:, at:] @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return values, wanted, vectors * sign[:, None]
