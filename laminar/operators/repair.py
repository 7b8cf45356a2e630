"""Repair: the least certified displacement that parts the two branches of a crossing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.functions import intervals, kernels

#: Growth of the trial shift, its first step, its limit, and halvings of the bracket that follow.
GROWTH, FIRST, MOST, HALVINGS = 2.0, 0.25, 64.0, 24


def transverse(a: np.ndarray, b: np.ndarray, touch: float = 0.0) -> int:
    """Transverse contacts between two sets of triangles (n, 3, 3)."""
    low_a, high_a, low_b, high_b = a.min(1), a.max(1), b.min(1), b.max(1)
    i, j = np.nonzero(((high_a[:, None] >= low_b[None]) & (high_b[None] >= low_a[:, None])).all(2))
    return int((kernels.contact(a[i], b[j], touch)[0] == kernels.TRANSVERSE).sum())


def moved(a: np.ndarray, b: np.ndarray, d: np.ndarray, t: float, shares: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Both sides after a shift by t along d, split by shares, as single precision holds them."""
    return intervals.quantised(a + shares[0] * t * d), intervals.quantised(b - shares[1] * t * d)


def certified_shift(a: np.ndarray, b: np.ndarray, d: np.ndarray, shares: tuple[float, float], others: np.ndarray | None = None) -> float:
    """Least t found at which the stored coordinates have no transverse contact, nor any new one with `others`; Infinity if none.

    The shift grows until it is clean, then the bracket is halved; only shifts that were tested are returned."""
    base = 0 if others is None else transverse(a, others) + transverse(b, others)

    def clean(t: float) -> bool:
        p, q = moved(a, b, d, t, shares)
        return transverse(p, q) == 0 and (others is None or transverse(p, others) + transverse(q, others) <= base)

    low, high = 0.0, FIRST
    if clean(0.0):
        return 0.0
    while not clean(high):
        low, high = high, high * GROWTH
        if high > MOST:
            return float("inf")
    for _ in range(HALVINGS):
        middle = 0.5 * (low + high)
        if clean(middle):
            high = middle
        else:
            low = middle
    return high


def search(a: np.ndarray, b: np.ndarray, others: np.ndarray | None = None, splits=((0.5, 0.5), (1.0, 0.0), (0.0, 1.0)), tried: int = 6) -> tuple[float, np.ndarray, tuple[float, float]]:
    """The least certified shift over directions and splits; directions are ranked by rigid clearance and the first few tried."""
    normal = lambda t: np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]).sum(0)
    directions = intervals.candidate_directions(*(n / max(np.linalg.norm(n), 1e-12) for n in (normal(a), normal(b))))
    reach = [intervals.rigid_clearance(a, b, d[None])[0] for d in directions]
    best = (float("inf"), np.zeros(3), (0.5, 0.5))
    for k in np.argsort(reach, kind="stable")[:tried]:
        for split in splits:
            if (t := certified_shift(a, b, directions[k], split, others)) < best[0]:
                best = (t, directions[k], split)
    return best


def budget_interval(p: np.ndarray, q: np.ndarray, d: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Shifts t of p along d that keep its distance from q within `most`: the roots of a quadratic; NaN where none does."""
    gap = p - q
    b, c, a = (gap * d).sum(-1), (gap * gap).sum(-1) - most * most, (np.broadcast_to(d, gap.shape) ** 2).sum(-1)
    root = b * b - a * c
    with np.errstate(invalid="ignore"):
        root = np.sqrt(root)
    return (-b - root) / a, (-b + root) / a


def repairs(triangles: DataFrame) -> DataFrame:
    """For each event (event_id, side a or b, nine corner coordinates): the state, least shift, direction and split.

    An event is one group, as small as the two patches that cross; events spread over tasks."""
    corners = [f"{c}{k}" for c in "efg" for k in "xyz"]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (frame[frame.side == s][corners].to_numpy(float).reshape(-1, 3, 3) for s in "ab")
        t, d, split = search(a, b) if len(a) and len(b) else (0.0, np.zeros(3), (0.5, 0.5))
        state = "unresolved" if np.isinf(t) else "clean" if t == 0 else "repaired"
        return pd.DataFrame([(frame.event_id.iloc[0], state, t, *map(float, d), float(split[0]))], columns=["event_id", "state", "shift", "dx", "dy", "dz", "share_a"])

    return triangles.groupBy("event_id").applyInPandas(solve, "event_id long, state string, shift double, dx double, dy double, dz double, share_a double")


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of each surface: vertices moved, the largest and root mean square move, vertices lost and won."""
    key = ["surface_id", "v", "u"]
    a = before.select(*key, F.col("valid").alias("ok0"), *[F.col(k).cast("double").alias(f"{k}0") for k in "xyz"])
    b = after.select(*key, F.col("valid").alias("ok1"), *[F.col(k).cast("double").alias(f"{k}1") for k in "xyz"])
    square = sum(((F.col(f"{k}1") - F.col(f"{k}0")) * (F.col(f"{k}1") - F.col(f"{k}0")) for k in "xyz"), F.lit(0.0))
    met = a.join(b, key).withColumn("d2", F.when(F.col("ok0") & F.col("ok1"), square))
    return met.groupBy("surface_id").agg(F.count_if(F.col("d2") > 0).alias("n_moved"), F.sqrt(F.max("d2")).alias("largest"), F.sqrt(F.avg("d2")).alias("rms"), F.count_if(F.col("ok0") & ~F.col("ok1")).alias("n_lost"), F.count_if(~F.col("ok0") & F.col("ok1")).alias("n_won"))
