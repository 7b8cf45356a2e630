import numpy as np
from test_mesh import grid, plane

from laminar.operators import repair


def wall(x, lean=0.13):
    y = np.linspace(0, 4, 5)
    out = []
    for y0, y1 in zip(y[:-1], y[1:]):
        p = [np.array([x + lean * z, yy, z]) for yy in (y0, y1) for z in (-1.0, 1.3)]
        out += [[p[0], p[1], p[3]], [p[0], p[3], p[2]]]
    return np.array(out)


def floor():
    out = []
    for x in range(-3, 3):
        for y in range(-1, 6):
            p = [np.array([x + a, y + b + 0.17, 0.11 * x]) for a in (0, 1) for b in (0, 1)]
            out += [[p[0], p[1], p[3]], [p[0], p[3], p[2]]]
    return np.array(out, float)


def test_shift_is_clean_and_not_much_larger_than_needed():
    a, b = wall(0.2), floor()
    assert repair.transverse(a, b) > 0
    t, d, split = repair.search(a, b, tried=3)
    assert 0 < t < 3
    assert repair.transverse(*repair.moved(a, b, d, t, split)) == 0


def test_clean_event_is_left(spark):
    a, b = wall(0.2), wall(3.0)
    rows = [(1, s, *map(float, t.ravel())) for s, side in (("a", a), ("b", b)) for t in side]
    rows += [(2, s, *map(float, t.ravel())) for s, side in (("a", a[:2]), ("b", floor())) for t in side]
    names = ["event_id", "side", *[f"{c}{k}" for c in "efg" for k in "xyz"]]
    out = {r.event_id: r for r in repair.repairs(spark.createDataFrame(rows, names)).collect()}
    assert (out[1].state, out[1].shift) == ("clean", 0.0) and out[2].state == "repaired"


def test_budget_interval():
    low, high = repair.budget_interval(np.array([[1.0, 0, 0]]), np.zeros((1, 3)), np.array([1.0, 0, 0]), 3.0)
    assert (low[0], high[0]) == (-4.0, 2.0)


def test_displacement(spark):
    points = plane(3, 3)
    moved = points.copy()
    moved[1, 1, 2] = 4.0
    moved[0, 0] = -1
    r = repair.displacement(grid(spark, points), grid(spark, moved)).first()
    assert (r.n_moved, r.largest, r.n_lost, r.n_won) == (1, 4.0, 1, 0)
