"""Clearance of crossing triangles: over which translations they still meet, and the shortest way out."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def pair_intervals(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest t at which triangle a + t d meets b, for n pairs (n, 3, 3); NaN where it never does.

    Separating axes: both normals, the nine edge products, and each normal with its triangle's edges."""
    na, nb = (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) for t in (a, b))
    ea, eb = (np.stack([t[:, (i + 1) % 3] - t[:, i] for i in range(3)], 1) for t in (a, b))
    axes = [na, nb, *(np.cross(ea[:, i], eb[:, j]) for i in range(3) for j in range(3)), *(np.cross(na, ea[:, i]) for i in range(3)), *(np.cross(nb, eb[:, i]) for i in range(3))]
    scale = np.maximum(np.abs(ea).max((1, 2)), np.abs(eb).max((1, 2)))
    low, high, none = np.full(len(a), -np.inf), np.full(len(a), np.inf), np.zeros(len(a), bool)
    for x in axes:
        size = np.sqrt((x * x).sum(1))
        use = size > 1e-12 * scale**2
        x = x / np.where(use, size, 1)[:, None]
        pa, pb = np.einsum("nik,nk->ni", a, x), np.einsum("nik,nk->ni", b, x)
        first, last, speed = pb.min(1) - pa.max(1), pb.max(1) - pa.min(1), (np.broadcast_to(d, x.shape) * x).sum(1)
        still = np.abs(speed) < 1e-12
        none |= use & still & ((first > 0) | (last < 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            t0, t1 = first / speed, last / speed
        moves = use & ~still
        low = np.where(moves, np.maximum(low, np.minimum(t0, t1)), low)
        high = np.where(moves, np.minimum(high, np.maximum(t0, t1)), high)
    none |= low > high
    return np.where(none, np.nan, low), np.where(none, np.nan, high)


def clear_time(intervals: list[tuple[float, float]], start: float = 0.0, step: float = 1e-6) -> float:
    """The first t >= start that lies in no interval, going past each that blocks it."""
    t = start
    for low, high in sorted(intervals):
        if low <= t <= high:
            t = high + step
    return t


def least_exit(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """Shortest translation of a that parts it from b, and that translation: least plane distance of the hull of b - a.

    The hull of the nine difference points has its facets among the planes through three of them."""
    points = (b[:, None] - a[None]).reshape(-1, 3)
    best, way = np.inf, np.zeros(3)
    for i, j, k in combinations(range(len(points)), 3):
        n = np.cross(points[j] - points[i], points[k] - points[i])
        size = np.sqrt(n @ n)
        if size < 1e-12:
            continue
        n = n / size
        side = (points - points[i]) @ n
        if side.max() > 1e-9 and side.min() < -1e-9:
            continue  # not a facet
        out = n if side.max() <= 1e-9 else -n
        depth = float(points[i] @ out)
        if depth < 0:
            return 0.0, np.zeros(3)  # the origin lies outside: they do not meet
        if depth < best:
            best, way = depth, out * depth
    return (best, way) if np.isfinite(best) else (0.0, np.zeros(3))


def split_weights(weight_a: float, weight_b: float) -> tuple[float, float]:
    """Shares of a displacement that two sides take, the lighter one more; halves where both weigh nothing."""
    total = weight_a + weight_b
    return (0.5, 0.5) if total <= 0 else (weight_b / total, weight_a / total)


def quantised(x: np.ndarray) -> np.ndarray:
    """Coordinates as single precision holds them: a result is certified only on these."""
    return x.astype(np.float32).astype(np.float64)


def sphere(n: int = 48, seed: int = 7) -> np.ndarray:
    """Directions spread at random over the sphere, always the same."""
    x = np.random.default_rng(seed).standard_normal((n, 3))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def candidate_directions(normal_a: np.ndarray, normal_b: np.ndarray, n: int = 48) -> np.ndarray:
    """Both patch normals, their sum, difference and product, either way, then the sphere."""
    basic = [normal_a, normal_b, normal_a + normal_b, normal_a - normal_b, np.cross(normal_a, normal_b)]
    unit = [x / s for x in basic if (s := np.linalg.norm(x)) > 1e-9]
    return np.r_[np.array([s * x for x in unit for s in (1, -1)]).reshape(-1, 3), sphere(n)]


def rigid_clearance(a: np.ndarray, b: np.ndarray, directions: np.ndarray) -> tuple[float, np.ndarray]:
    """Least shift along one of the directions that parts every triangle of a from every one of b, and its direction."""
    best, way = np.inf, np.zeros(3)
    i, j = (x.ravel() for x in np.meshgrid(range(len(a)), range(len(b)), indexing="ij"))
    for d in directions:
        low, high = pair_intervals(a[i], b[j], d)
        met = ~np.isnan(low)
        t = clear_time(list(zip(low[met], high[met])))
        if t < best:
            best, way = t, d
    return best, way


def harmonic(n: int, edges: np.ndarray, fixed: dict[int, float], rounds: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Values on n nodes, given on `fixed`, elsewhere the mean of their neighbours: conjugate gradients on the free nodes."""
    free = np.array([i for i in range(n) if i not in fixed], int)
    value = np.zeros(n)
    for k, v in fixed.items():
        value[k] = v
    degree = np.bincount(edges.ravel(), minlength=n)

    def laplace(x):
        out = degree * x
        np.subtract.at(out, edges[:, 0], x[edges[:, 1]])
        np.subtract.at(out, edges[:, 1], x[edges[:, 0]])
        return out

    full = np.zeros(n)
    r = -laplace(value)[free]
    x, p, rr = np.zeros(len(free)), r.copy(), float(r @ r)
    for _ in range(rounds):
        if rr < tol**2:
            break
        full[:] = 0
        full[free] = p
        q = laplace(full)[free]
        step = rr / float(p @ q)
        x += step * p
        r -= step * q
        rr, old = float(r @ r), rr
        p = r + rr / old * p
    value[free] = x
    return value
