import numpy as np
from pyspark.sql import functions as F
from test_mesh import grid, plane

from laminar.functions import kernels
from laminar.operators import graph, mesh, regions, spectrum

E = "surface_id long, a long, b long, w double"
S = "surface_id long, event long, side string, cell long, offset double, exact boolean"


def test_segment_ends():
    flat = np.array([[0, 0, 0], [4, 0, 0], [0, 4, 0]], float)
    upright = np.array([[1, 1, -1], [1, 1, 1], [1, 9, 0]], float)
    ends, ok = kernels.segment(np.stack([flat, flat, flat, upright]), np.stack([upright, upright + [0, 0, 5], flat + [0, 0, 1], flat]))
    assert ok.tolist() == [True, False, False, True]
    for i in (0, 3):
        assert np.allclose(sorted(ends[i].tolist()), [[1, 1, 0], [1, 3, 0]])


def test_segment_equals_points_on_both():
    rng = np.random.default_rng(0)
    p, q = rng.normal(size=(2, 400, 3, 3))
    ends, ok = kernels.segment(p, q)
    assert 30 < ok.sum() < 250
    for k in (0, 1):
        for t in (p, q):
            assert kernels.point_triangle(ends[ok][:, k], t[ok]).max() < 1e-9


def test_separation_adds_offsets(spark):
    line = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(6)] + [(0, 20, 21, 1.0)], E)
    seeds = [(0, 1, "a", 0, 0.5, True), (0, 1, "a", 1, 0.9, True), (0, 1, "b", 4, 0.25, True), (0, 2, "a", 0, 0.0, False), (0, 2, "b", 21, 0.0, True), (0, 3, "a", 0, 0.0, True), (0, 3, "b", 99, 0.0, True)]
    out = {r.event: (r.separation, r.same_component, r.endpoint_exact) for r in spectrum.separations(line, spark.createDataFrame(seeds, S)).collect()}
    assert abs(out[1][0] - 4.15) < 1e-9 and out[1][1:] == (True, True)
    assert out[2] == (None, False, False) and out[3] == (None, None, False)


def test_seeds_lie_on_the_right_sides(spark):
    def sheet(v, u):
        return (2.0 * u, 2.0 * v, 0.0) if u < 4 else (3.0, 2.0 * v + 0.3, 2.0 * (u - 6) + 0.7)

    cells = [(0, v, u, *map(float, sheet(v, u)), True) for v in range(4) for u in range(9)]
    quads = mesh.quads(mesh.with_validity(spark.createDataFrame(cells, mesh.VERTEX)))
    rows = [(0, 7, 1, 1, 1, 1, 5, False), (0, 8, 2, 1, 5, 1, 1, True), (0, 9, 3, 0, 0, 2, 2, False)]
    out = spectrum.seeds(spark.createDataFrame(rows, "surface_id long, event long, row long, v1 int, u1 int, v2 int, u2 int, swapped boolean"), quads, 0)
    seen = {}
    for r in out.withColumn("v", regions.decoded(F.col("cell"))[1]).withColumn("u", regions.decoded(F.col("cell"))[2]).collect():
        seen.setdefault((r.event, r.side), {})[r.v, r.u] = (round(r.offset, 9), r.exact)
    assert seen[7, "a"] == seen[8, "a"] and seen[7, "b"] == seen[8, "b"]
    assert all(u in (1, 2) and o[0] > 0 and o[1] for (_, u), o in seen[7, "a"].items()) and all(u in (5, 6) for _, u in seen[7, "b"])
    assert set(seen[9, "a"]) == {(0, 0), (0, 1), (1, 0), (1, 1)} and set(seen[9, "b"].values()) == {(0.0, False)}


def test_spectrum_without_contacts(spark):
    none = spark.createDataFrame([], "surface_id long, row long, v1 int, u1 int, v2 int, u2 int, penetration float")
    assert spectrum.spectrum(grid(spark, plane(4, 4, 2.0, 0.0)), none, 7.91).count() == 0
    assert graph.edges(mesh.quads(grid(spark, plane(2, 2, 2.0, 0.0))), 0).count() == 5
