import math

import numpy as np
from pyspark.sql import functions as F
from test_mesh import grid, plane

from laminar.operators import events, gaps, mesh


def sheets(spark, *heights, n=25, pitch=20.0):
    out = None
    for i, z in enumerate(heights):
        found = mesh.triangles(mesh.quads(grid(spark, plane(n, n, pitch, z), surface=i)), 0)
        found = found.withColumn("tag", F.col("surface_id").cast("int"))
        out = found if out is None else out.unionByName(found)
    return out


def ask(spark, points, tri, reach=128.0, exclude=0):
    rows = [(i, *map(float, p), -100) for i, p in enumerate(points)]
    found = gaps.nearest_sheets(spark.createDataFrame(rows, "qid long, x double, y double, z double, grp int"), tri, reach, exclude)
    return {r.qid: r for r in found.collect()}


def test_sheet_stack(spark):
    r = ask(spark, [(110, 110, 0), (230, 230, 900)], sheets(spark, 0.0, 12.0))
    assert (r[0].w1, r[0].d1, r[0].w2, r[0].d2) == (0, 0, 1, 12)
    assert r[1].w1 is None and math.isinf(r[1].d1)


def test_random_probes(spark):
    rng = np.random.default_rng(0)
    points = rng.uniform([40, 40, -30], [420, 420, 60], (60, 3))
    r = ask(spark, points, sheets(spark, 0.0, 35.0))
    for i, p in enumerate(points):
        want = sorted([abs(p[2]), abs(p[2] - 35)])
        assert abs(r[i].d1 - want[0]) < 0.05 and abs(r[i].d2 - want[1]) < 0.05


def test_own_group_is_left_out(spark):
    rows = spark.createDataFrame([(0, 110.0, 110.0, 0.0, 0)], "qid long, x double, y double, z double, grp int")
    r = gaps.nearest_sheets(rows, sheets(spark, 0.0, 12.0), 64.0, 1).first()
    assert (r.w1, r.d1, r.w2) == (1, 12, None)


def test_nearest_sheets_query_asks_for_every_valid_cell(spark, tmp_path):
    from laminar.plans import catalog

    values = [[float(u % 3) for u in range(64)] for _ in range(5)]
    values[3][7] = float("nan")
    spark.createDataFrame([(v, 0, e) for v, e in enumerate(values)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = catalog.QUERIES["nearest_sheets"](spark, str(tmp_path)).toPandas()
    assert len(out) == out.qid.nunique() == 5 * 64 - 1


def test_gap_report(spark):
    rows = [(v, u, u, u + 40 if v < 6 else None, 3.0 if v < 6 else float("inf")) for v in range(10) for u in range(10)]
    results = spark.createDataFrame(rows, "v int, u int, col int, w1 int, d1 double")
    r = gaps.analyse(results, 10).first()
    assert (r.n_queries, r.n_measurable, r.largest_blob, r.largest_blob_4c, r.valid) == (100, 60, 60, 60, True)
    assert r.coverage == 0.6 and r.frac_flagged == 0.6 and r.du_median == 40
    assert not gaps.analyse(results, 30).first().valid
    none = gaps.analyse(results.withColumn("d1", F.lit(float("inf"))), 10).first()
    assert none.valid and none.frac_flagged == 0 and none.largest_blob == 0
    assert gaps.exclusion(results, 5) == 10 and gaps.exclusion(results, 11) is None


def test_planted_patch(spark):
    points = plane(12, 30, 1.0)
    points[:, :, 2] = np.arange(30) // 10 * 5.0
    out = {(r.v, r.u): r.z for r in gaps.planted(grid(spark, points), 2, 10, 20, 30, 10, feather=2).collect()}
    assert out[5, 25] == 5.0 and out[0, 25] == 10.0 and out[2, 25] == 10.0 and out[3, 25] == 7.5


def test_revolution_period(spark):
    t = np.linspace(0, 3 * math.pi, 61)
    points = np.zeros((4, 61, 3))
    points[:, :, 0], points[:, :, 1] = 50 * np.cos(t), 50 * np.sin(t)
    points[:, :, 2] = np.arange(4)[:, None]
    r = gaps.revolution_periods(grid(spark, points)).first()
    assert abs(r.period - 40) < 2
    assert gaps.revolution_periods(grid(spark, plane(4, 6))).first().period is None  # fewer than eight columns


def rows(spark, *contacts):
    return spark.createDataFrame([(0, i, *c) for i, c in enumerate(contacts)], "surface_id long, row long, v1 int, u1 int, v2 int, u2 int")


def test_oriented_events(spark):
    contacts = rows(spark, (0, 0, 10, 0), (1, 0, 11, 0), (12, 0, 2, 0), (0, 20, 10, 20))
    found = events.oriented(contacts)
    assert found.select("event").distinct().count() == 2 and found.where("ambiguous").count() == 0
    cells = events.sides(contacts, found)
    a = {(r.v, r.u) for r in cells.where("event = 0 AND side = 'a'").collect()}
    assert a == {(0, 0), (1, 0), (2, 0)}
    assert events.self_touching(cells).count() == 0


def test_contradiction_is_ambiguous(spark):
    contacts = rows(spark, (0, 0, 0, 1), (0, 1, 0, 0))
    found = events.oriented(contacts)
    assert found.where("ambiguous").count() == 2
    assert events.self_touching(events.sides(contacts, found)).count() == 1


def test_matching(spark):
    cell = lambda e, *cells: [(7, e, s, v, u) for s, v, u in cells]
    d0 = cell(0, ("a", 0, 0), ("b", 10, 0)) + cell(1, ("a", 50, 0), ("b", 60, 0)) + cell(2, ("a", 90, 0), ("b", 99, 0))
    d1 = cell(0, ("b", 0, 1), ("a", 10, 1)) + cell(1, ("a", 50, 0), ("b", 60, 0)) + cell(2, ("a", 51, 0), ("b", 61, 0))
    schema = "surface_id long, event long, side string, v int, u int"
    out = {(r.diagonal, r.event): r for r in events.matched(spark.createDataFrame(d0, schema), spark.createDataFrame(d1, schema)).collect()}
    assert out[0, 0].state == out[1, 0].state == "matched" and out[0, 0].swapped and out[0, 0].partner == 0
    assert {out[0, 1].state, out[1, 1].state, out[1, 2].state} == {"ambiguous"} and out[0, 1].group_id == out[1, 2].group_id
    assert out[0, 2].state == "unmatched" and len(out) == 6


def test_matching_keeps_to_a_surface_and_counts_touching_pairs(spark):
    schema = "surface_id long, event long, side string, v int, u int"
    line = lambda s, e, v, n: [(s, e, "a", v, k) for k in range(n)] + [(s, e, "b", v + 20, k) for k in range(n)]
    d0 = line(1, 1, 0, 3) + line(2, 1, 0, 1)
    d1 = line(1, 5, 1, 3) + line(3, 1, 0, 1)
    out = {(r.surface_id, r.diagonal, r.event): r for r in events.matched(spark.createDataFrame(d0, schema), spark.createDataFrame(d1, schema)).collect()}
    assert out[1, 0, 1].state == "matched" and out[1, 0, 1].partner == 5 and out[1, 0, 1].score == 14  # three facing cells touch in 7 pairs a side
    assert out[2, 0, 1].state == out[3, 1, 1].state == "unmatched" and len(out) == 4
