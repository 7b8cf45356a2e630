import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminar.functions import kernels
from laminar.operators import census, excise, graph, mesh, regions


def grid(spark, points, valid=None, surface=0):
    rows, cols = points.shape[:2]
    data = [(surface, v, u, *map(float, points[v, u]), bool(valid is None or valid[v, u])) for v in range(rows) for u in range(cols)]
    return mesh.with_validity(spark.createDataFrame(data, mesh.VERTEX))


def plane(rows, cols, pitch=6.0, z=0.0):
    v, u = np.indices((rows, cols))
    return np.dstack([pitch * u, pitch * v, np.full((rows, cols), z)])


def hairpin(gap, cross=False, width=8, arm=20, cap=10, pitch=6.0):
    """Out along x at height 0, round a half circle, back at `gap`; crossing: the way back sweeps from +gap to -gap."""
    t = np.linspace(0, math.pi, cap)
    out = [(pitch * i, 0.0) for i in range(arm)]
    end = out[-1][0]
    turn = [(end + pitch + gap / 2 * math.sin(a), gap / 2 * (1 - math.cos(a))) for a in t]
    back = [(end - pitch * i + 1.3, gap - (2 * gap * i / (arm - 1) if cross else 0.0)) for i in range(arm)]
    line = np.array(out + turn + back)
    points = np.zeros((width, len(line), 3))
    points[:, :, 0], points[:, :, 2] = line[:, 0], line[:, 1]
    points[:, :, 1] = (np.arange(width) * pitch)[:, None] + np.where(np.arange(len(line)) >= arm, 0.7, 0.0)
    return points


def found(spark, points, d=0, **how):
    return census.contacts(mesh.triangles(mesh.quads(grid(spark, points)), d), **how)


def count(contacts, verdict="transverse"):
    return contacts.where(F.col("verdict") == verdict).count()


def test_flat_sheet_is_clean(spark):
    out = census.verdict_counts(found(spark, plane(12, 12))).first()
    assert (out.n_transverse, out.n_coplanar) == (0, 0)


def test_hairpins(spark):
    assert count(found(spark, hairpin(3.0))) == 0
    crossing = found(spark, hairpin(6.0, cross=True))
    assert count(crossing) > 0
    assert crossing.where("verdict = 'transverse' AND penetration <= 0").count() == 0


def test_transverse_does_not_depend_on_cells(spark):
    assert len({count(found(spark, hairpin(6.0, cross=True), cell=c)) for c in (7.0, 12.0, 40.0)}) == 1


def test_join_equals_all_pairs(spark):
    points = hairpin(6.0, cross=True, width=4, arm=8, cap=5)
    tri = mesh.triangles(mesh.quads(grid(spark, points)), 0).toPandas()
    shape = tri[census._CORNERS].to_numpy().reshape(-1, 3, 3)
    i, j = np.triu_indices(len(tri), 1)
    far = (np.abs(tri.v.to_numpy()[i] - tri.v.to_numpy()[j]) > 1) | (np.abs(tri.u.to_numpy()[i] - tri.u.to_numpy()[j]) > 1)
    verdict, _, _ = kernels.contact(shape[i[far]], shape[j[far]], 0.0)
    assert int((verdict == kernels.TRANSVERSE).sum()) == count(found(spark, points))


def test_checkerboard_has_no_quad(spark):
    v, u = np.indices((4, 4))
    assert mesh.quads(grid(spark, plane(4, 4, 10.0), (v + u) % 2 == 0)).count() == 0


def test_empty_surface_gives_one_row(spark):
    out = census.verdict_counts(found(spark, np.full((3, 3, 3), -1.0))).first()
    assert out.n_contacts == 0


def test_validity_marks(spark):
    points = plane(2, 3)
    points[0, 0] = -1
    points[0, 1, 2] = np.nan
    points[1, 1, 2] = -5
    out = {(r.v, r.u): (r.valid, r.valid_upstream) for r in grid(spark, points).collect()}
    assert out[0, 0] == (False, False) and out[0, 1] == (False, False) and out[1, 1] == (True, False)


def test_areas_and_edge_limit(spark):
    quads = mesh.areas(mesh.quads(grid(spark, plane(3, 3, 10.0))))
    assert all(abs(r.area - 100) < 1e-9 and abs(r.area_d0 - r.area_d1) < 1e-9 for r in quads.collect())
    assert mesh.quads(grid(spark, plane(3, 3, 60.0))).where("retained").count() == 0  # the diagonal is longer


def test_regions_and_events(spark):
    contacts = spark.createDataFrame([(0, 0, 0, 0, 0, 10, 0, 0, "transverse", 1.0, 9.0), (0, 1, 0, 0, 0, 11, 0, 0, "transverse", 2.0, 9.0), (0, 12, 0, 0, 0, 2, 0, 0, "transverse", 1.0, 9.0), (0, 0, 20, 0, 0, 10, 20, 0, "transverse", 1.0, 9.0)], "s1 long, v1 int, u1 int, t1 int, s2 long, v2 int, u2 int, t2 int, verdict string, penetration float, angle_deg float")
    assert regions.events(contacts).count() == 2
    assert regions.regions(contacts).select("region_v", "region_u").distinct().count() == 4
    best = regions.sites(contacts).orderBy("at_u").first()
    assert (best.v1, best.v2) == (1, 11)


def test_distances_on_a_plane(spark):
    points = plane(7, 7, 1.0)
    for d, corner in ((0, 5 * math.sqrt(2)), (1, 10.0)):
        e = graph.edges(mesh.quads(grid(spark, points)), d)
        start = spark.createDataFrame([(0, 0)], "surface_id long, cell long")
        got = graph.distance_field(e, start).where(F.col("cell") == 5 * regions.COLUMNS + 5).first().distance
        assert abs(got - corner) < 1e-9


def test_slit_parts_the_graph(spark):
    valid = np.ones((6, 7), bool)
    valid[:, 3] = False
    e = graph.edges(mesh.quads(grid(spark, plane(6, 7, 1.0), valid)), 0)
    assert sorted(r.n_vertices for r in graph.graph_components(e).collect()) == [18, 18]


def test_greedy_and_exact_covers():
    cover = [np.array([1, 2]), np.array([2, 3]), np.array([3, 4])]
    incident = {1: [(1, 1.0)], 2: [(2, 1.0)], 3: [(3, 1.0)], 4: [(4, 5.0)]}
    assert excise.greedy(cover, incident) == [2, 3]
    best, proven = excise.exact(cover, incident, float("inf"))
    assert proven and sorted(best) in ([2, 3], [1, 3], [2, 4], [2, 3]) and 3 in best or 2 in best


def test_covers_hold_nothing_redundant():
    """Random systems against all subsets: every set covered, no vertex to spare, and a single quad's price paid once."""
    from itertools import combinations

    rng = np.random.default_rng(5)
    for _ in range(40):
        cover = [rng.choice(9, rng.integers(1, 4), replace=False) for _ in range(rng.integers(1, 8))]
        incident = {x: [(int(q), float(q % 5 + 1)) for q in rng.choice(12, 2, replace=False)] for x in range(9)}
        got = excise.greedy(cover, incident)
        covers = lambda some: all(set(c.tolist()) & set(some) for c in cover)  # noqa: E731,B023
        assert covers(got) and not any(covers(set(got) - {x}) for x in got)
        area = lambda some: sum({q: a for x in some for q, a in incident[x]}.values())  # noqa: E731,B023
        best = min(area(s) for k in range(1, 10) for s in combinations(range(9), k) if covers(s))
        assert area(got) >= best
        found, proven = excise.exact(cover, incident, float("inf"))
        assert proven and abs(area(found) - best) < 1e-9


def test_pair_verdicts_of_either_diagonal_and_what_cannot_be_tested(spark):
    flat = lambda s, z, n=6, dx=0.0: [(s, v, u, u * 10.0 + dx, v * 10.0, z, True) for v in range(n) for u in range(n)]
    steep = [(2, v, u, 23.0 + 0.1 * v, v * 10.0 + 0.3, u * 10.0 - 24.0, True) for v in range(6) for u in range(6)]
    checker = [(4, v, u, u * 10.0, v * 10.0, 1.0, (u + v) % 2 == 0) for v in range(6) for u in range(6)]
    few = [(5, 0, u, u * 10.0, 0.0, 0.0, True) for u in range(3)]
    rows = flat(1, 0.0) + steep + flat(3, 500.0) + checker + few + flat(6, 0.5, dx=3.3) + flat(7, 0.2, dx=49.0)
    vertices = mesh.with_validity(spark.createDataFrame(rows, mesh.VERTEX))
    quads = mesh.quads(vertices)
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 1), (1, 9), (1, 6), (1, 7)], "a long, b long")
    out = {(r.a, r.b): r for r in census.pair_verdicts(edges, vertices, census.of_both_diagonals(quads), quads).collect()}
    assert len(out) == 8 and out[1, 2].verdict == "conflict" and out[1, 2].n_d0 + out[1, 2].n_d1 == out[1, 2].n_transverse > 0
    reasons = {(1, 3): "extents do not meet", (1, 4): "surface has no triangle", (1, 5): "surface has no triangle", (1, 1): "one surface twice", (1, 9): "surface not found"}
    assert all(out[k].verdict == "not_testable" and out[k].reason == why for k, why in reasons.items())
    assert out[1, 6].verdict == "not_testable" and out[1, 7].reason in ("extents do not meet", "too few points in the shared extent")
    bent = [(8, v, u, u * 10.0, v * 10.0, 5.0 if (v, u) == (0, 0) else 0.0, True) for v in range(2) for u in range(2)]
    needle = [(9, v, u, 3.0 + 0.2 * u, 3.0 + 0.2 * u, 0.5 + 2.0 * v, True) for v in range(2) for u in range(2)]
    both = mesh.with_validity(spark.createDataFrame(bent + needle, mesh.VERTEX))
    q = mesh.quads(both)
    one = census.pair_verdicts(spark.createDataFrame([(8, 9)], "a long, b long"), both, census.of_both_diagonals(q), q).first()
    assert (one.verdict == "conflict") == (one.n_d0 + one.n_d1 > 0) and one.n_transverse == one.n_d0 + one.n_d1


def test_dominated_sets_go(spark):
    sets = spark.createDataFrame([([1, 2], 1), ([1, 2, 3], 2), ([1, 2], 3), ([4, 5], 4)], "coverage array<long>, cid long")
    out = {tuple(r.coverage): r.n for r in excise.reduced(sets).collect()}
    assert out == {(1, 2): 2, (4, 5): 1}


def test_excision_ends_clean(spark):
    surface = grid(spark, hairpin(6.0, cross=True, width=4, arm=8, cap=5))
    now, removed, state = excise.excise(surface)
    assert state == "clean" and removed.count() > 0
    for d in (0, 1):
        assert count(census.contacts(mesh.triangles(mesh.quads(now), d))) == 0
    kept = now.where("valid").join(surface.select("v", "u", F.col("x").alias("x0"), F.col("z").alias("z0")), ["v", "u"])
    assert kept.where("x <> x0 OR z <> z0").count() == 0
    assert excise.certificate(surface, now).first().retained_fraction < 1


@pytest.mark.parametrize("rounds", [1, 2])
def test_erosion(spark, rounds):
    out = mesh.eroded(grid(spark, plane(7, 7)), rounds).where("valid").count()
    assert out == (7 - 2 * rounds) ** 2
