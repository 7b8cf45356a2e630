"""Geometry over arrays of pairs, for what does not fit into one generated function."""

from __future__ import annotations

import numpy as np

from laminar.functions.geometry import EPS_SCALE, FLT_EPS, LEAST_COSINE, LEAST_EPS, LEAST_NORMAL

NONE, TRANSVERSE, COPLANAR, GRAZING = range(4)
NAMES = np.array(["none", "transverse", "coplanar", "grazing"])


def _largest(v: np.ndarray) -> np.ndarray:
    """Axis of the largest component; y or z only where strictly larger than both others."""
    x, y, z = np.abs(v).T
    return np.where((y > x) & (y > z), 1, np.where((z > x) & (z > y), 2, 0))


def _normals(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    size = np.sqrt((n * n).sum(1))
    return n / np.where(size < LEAST_NORMAL, 1, size)[:, None], size


def _ends(t: np.ndarray, d: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each triangle's edges from its apex (the corner alone on its side) pass the other plane; whether there is one."""
    on = np.take_along_axis(t, axis[:, None, None].repeat(3, 1), 2)[:, :, 0]
    next_, last = np.roll(d, -1, 1), np.roll(d, -2, 1)
    alone = ((d > 0) & (next_ <= 0) & (last <= 0)) | ((d < 0) & (next_ >= 0) & (last >= 0))
    apex = alone.argmax(1)
    row = np.arange(len(t))
    out = []
    for step in (1, 2):
        other = (apex + step) % 3
        with np.errstate(divide="ignore", invalid="ignore"):
            share = d[row, apex] / (d[row, apex] - d[row, other])
            out.append(on[row, apex] + (on[row, other] - on[row, apex]) * share)
    return np.minimum(*out), np.maximum(*out), alone.any(1)


def _flat_apart(p: np.ndarray, q: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Whether an edge of either triangle separates the two in the plane that drops the normal's largest axis."""
    kept = np.array([[1, 2], [0, 2], [0, 1]])[_largest(normal)]
    flat = [np.take_along_axis(t, kept[:, None].repeat(3, 1), 2) for t in (p, q)]
    apart = np.zeros(len(p), bool)
    for mine, other in (flat, flat[::-1]):
        for i in range(3):
            a, edge = mine[:, i], mine[:, (i + 1) % 3] - mine[:, i]
            side = lambda x: edge[:, 0] * (x[:, 1] - a[:, 1]) - edge[:, 1] * (x[:, 0] - a[:, 0])  # noqa: E731,B023
            own = side(mine[:, (i + 2) % 3])
            apart |= np.all([side(other[:, k]) * own <= -1e-12 for k in range(3)], axis=0)
    return apart


def contact(p: np.ndarray, q: np.ndarray, touch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verdict, penetration and angle in degrees of n triangle pairs, given as (n, 3 corners, 3)."""
    n = len(p)
    return contact_among(np.concatenate([p, q]), np.arange(n), np.arange(n, 2 * n), touch)


def contact_among(t: np.ndarray, i: np.ndarray, j: np.ndarray, touch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of pairs (i, j) among triangles t. Normals are taken once a triangle, and each test only of pairs still open:
    most of them end with boxes or with all corners beside the other's plane. Penetration and angle are 0 where one of these decides."""
    n = len(i)
    verdict, pen, angle = np.full(n, NONE), np.zeros(n), np.zeros(n)
    if not n:
        return verdict, pen, angle
    low, high = t.min(1), t.max(1)
    normal, length = _normals(t)
    far = np.abs(t).max((1, 2))
    open_ = np.flatnonzero(~((high[i] < low[j] - touch) | (high[j] < low[i] - touch)).any(1))
    thin = (length[i[open_]] < LEAST_NORMAL) | (length[j[open_]] < LEAST_NORMAL)
    verdict[open_[thin]] = GRAZING
    open_ = open_[~thin]
    i, j = i[open_], j[open_]
    eps = np.maximum(LEAST_EPS, EPS_SCALE * FLT_EPS * np.maximum(far[i], far[j]))[:, None]
    p, q, np_, nq = t[i], t[j], normal[i], normal[j]
    dp = np.einsum("nk,nik->ni", nq, p - q[:, :1])
    dq = np.einsum("nk,nik->ni", np_, q - p[:, :1])
    left = np.flatnonzero(~((dp > eps).all(1) | (dp < -eps).all(1) | (dq > eps).all(1) | (dq < -eps).all(1)))
    if len(left) < len(i):
        open_, eps, dp, dq, p, q, np_, nq = (x[left] for x in (open_, eps, dp, dq, p, q, np_, nq))
    n = len(open_)
    flat = (np.abs(dp) < eps).all(1)
    graze = (np.abs(dp) < eps).any(1) | (np.abs(dq) < eps).any(1)
    angle[open_] = np.degrees(np.arccos(np.minimum(1.0, np.abs((np_ * nq).sum(1)))))
    line = np.cross(np_, nq)
    axis = _largest(line)
    p0, p1, p_ok = _ends(p, dp, axis)
    q0, q1, q_ok = _ends(q, dq, axis)
    size = np.sqrt((line * line).sum(1))
    cosine = np.where(size > LEAST_NORMAL, np.abs(line[np.arange(n), axis]) / np.where(size > 0, size, 1), 1.0)
    shared = np.minimum(p1, q1) - np.maximum(p0, q0)
    reach = shared / np.maximum(cosine, LEAST_COSINE)
    separate = np.zeros(n, bool)
    if flat.any():
        separate[flat] = _flat_apart(p[flat], q[flat], np_[flat])
    alone = ~(p_ok & q_ok)
    verdict[open_] = np.select([flat & separate, flat, graze | alone, ~(shared > 0), reach <= touch], [NONE, COPLANAR, GRAZING, NONE, GRAZING], TRANSVERSE)
    measured = ~(flat | graze | alone) & (shared > 0)
    pen[open_] = np.where(measured, reach, 0.0)
    return verdict, pen, angle


def meeting(t: np.ndarray, cells: np.ndarray, first: np.ndarray, who: np.ndarray, place: np.ndarray, touch: float, exclude: int, across: bool | None, most: int = 1 << 20):
    """Yields index arrays i < j of triangles t whose boxes meet in the cell that owns the pair, cell by cell, without those that lie
    clearly beside the other's plane: signed distances of a cell are one matrix product, with a margin over its rounding.

    cells: cell number of each entry, ascending; who: the triangle of each entry; first: whether the cell is its box's first along each axis.
    place: surface, v, u of each triangle; pairs within `exclude` of the same surface are left out, and others by `across`."""
    low, high = t.min(1), t.max(1)
    normal, length = _normals(t)
    normal[length < LEAST_NORMAL] = 0  # thin ones lie beside nothing
    height = (normal * t[:, 0]).sum(1)
    far = np.abs(t).max() if len(t) else 0.0
    clear = max(LEAST_EPS, EPS_SCALE * FLT_EPS * far) + 1e-12 * far
    thin = length < LEAST_NORMAL
    ends = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    for begin, end in zip(ends[:-1], ends[1:]):
        if end - begin < 2:
            continue
        m, own = who[begin:end], first[begin:end]
        lo, hi, s, v, u = low[m] - touch, high[m], *(x[m] for x in place)
        corner, n, h, bare = t[m], normal[m], height[m], thin[m]
        step = max(1, most // len(m))
        for k in range(0, len(m), step):
            r = slice(k, min(k + step, len(m)))
            met = np.arange(k, r.stop)[:, None] < np.arange(len(m))[None]
            for a in range(3):
                met &= hi[r, a, None] >= lo[None, :, a]
                met &= hi[None, :, a] >= lo[r, a, None]
                met &= own[r, a, None] | own[None, :, a]
            if across is not None:
                met &= (s[r, None] != s[None]) if across else (s[r, None] == s[None])
            mine = [corner[r, c] @ n.T - h for c in range(3)]
            theirs = [n[r] @ corner[:, c].T - h[r, None] for c in range(3)]
            for d in (mine, theirs):
                beside = (np.minimum(np.minimum(d[0], d[1]), d[2]) > clear) | (np.maximum(np.maximum(d[0], d[1]), d[2]) < -clear)
                if bare.any():
                    beside &= ~(bare[r, None] | bare[None])
                met &= ~beside
            x, y = np.nonzero(met)
            x += k
            fine = ~((s[x] == s[y]) & (np.abs(v[x] - v[y]) <= exclude) & (np.abs(u[x] - u[y]) <= exclude))
            yield m[x[fine]], m[y[fine]]


def point_triangle(points: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Distance of n points from n triangles (n, 3 corners, 3), in the precision given: least over the plane's foot, where
    it falls inside, and the three edges."""
    a, b, c = triangles[:, 0], triangles[:, 1], triangles[:, 2]
    normal = np.cross(b - a, c - a)
    size = (normal * normal).sum(1)
    best = np.full(len(points), np.inf, points.dtype)
    inside = size > 0
    for p, q in ((a, b), (b, c), (c, a)):
        edge, to = q - p, points - p
        length = (edge * edge).sum(1)
        t = np.clip((to * edge).sum(1) / np.where(length > 0, length, 1), 0, 1)
        away = to - t[:, None] * edge
        best = np.minimum(best, (away * away).sum(1))
        inside &= (np.cross(edge, to) * normal).sum(1) >= 0
    height = ((points - a) * normal).sum(1)
    foot = height * height / np.where(size > 0, size, 1)
    return np.sqrt(np.where(inside, foot, best))


def segment(p: np.ndarray, q: np.ndarray, eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Ends (n, 2, 3) of the segment in which n pairs of triangles (n, 3 corners, 3) cross, and whether there is one: the overlap
    of the stretches that both cut from the line of their planes. None for parallel planes or a single point."""
    n = [np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) for t in (p, q)]
    line = np.cross(*n)
    size = np.linalg.norm(line, axis=1)
    ok = size >= eps * np.maximum(np.linalg.norm(n[0], axis=1), 1) * np.maximum(np.linalg.norm(n[1], axis=1), 1)
    line = line / np.where(size > 0, size, 1)[:, None]
    stretch = []
    for own, other, normal in ((p, q, n[1]), (q, p, n[0])):
        side = np.einsum("nij,nj->ni", own - other[:, :1], normal)
        after, beyond = np.roll(side, -1, 1), np.roll(own, -1, 1)
        apart = side - after
        between = own + (side / np.where(apart == 0, 1, apart))[:, :, None] * (beyond - own)
        points = np.concatenate([own, between], 1)
        given = np.concatenate([side == 0, side * after < 0], 1)
        at = np.einsum("nij,nj->ni", points, line)
        ok &= given.sum(1) >= 2
        rows = np.arange(len(own))
        low, high = np.where(given, at, np.inf).argmin(1), np.where(given, at, -np.inf).argmax(1)
        stretch.append((at[rows, low], at[rows, high], points[rows, low], points[rows, high]))
    (a0, a1, first, last), (b0, b1, _, _) = stretch
    lo, hi = np.maximum(a0, b0), np.minimum(a1, b1)
    span = a1 - a0
    ok &= (hi > lo) & (span >= eps)
    span = np.where(span > 0, span, 1)
    ends = np.stack([first + ((t - a0) / span)[:, None] * (last - first) for t in (lo, hi)], 1)
    return ends, ok
