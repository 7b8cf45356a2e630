import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mesh import grid, plane
from test_queries import SF, rows

from laminar.operators import corpus, cuts, events, gaps, mesh, spatial

NAMES = ["cut_boundary", "floor_taint", "centre_line_length", "surface_disagreement", "vertex_distance", "partner_cells", "manifest_identity", "published_agreement", "verification_summary", "verification_failures"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    from laminar.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert len(got) and rows(got) == rows(want.astype(object).where(want.notna(), None))


def quads(spark, removed, n=4, pitch=2.0):
    gone = F.concat_ws(",", "v", "u").isin(*[f"{v},{u}" for v, u in removed]) if removed else F.lit(False)
    found = mesh.quads(mesh.with_validity(grid(spark, plane(n, n, pitch, 0.0))))
    return found.withColumn("removed", gone).withColumn("kept", ~gone)


def test_cut_boundary(spark):
    inner, corner, none = (cuts.cut_boundary(quads(spark, gone)).first() for gone in ([(1, 1)], [(0, 0)], []))
    assert (inner.n_edges, inner.length) == (4, 8.0) and (corner.n_edges, corner.length) == (2, 4.0) and (none.n_edges, none.length) == (0, 0.0)


def test_pieces_meet_at_corners(spark):
    kept = quads(spark, [(0, 1), (1, 0), (0, 2), (1, 1), (2, 1)]).where("kept")
    r = cuts.piece_report(kept).first()
    assert (r.n_quads, r.n_pieces, r.largest, r.n_single) == (4, 3, 2, 2)


def test_witnesses(spark):
    key = "s1 long, v1 int, u1 int, t1 int, s2 long, v2 int, u2 int, t2 int"
    found = spark.createDataFrame([(0, 0, 0, 0, 0, 5, 5, 1), (0, 0, 0, 1, 0, 9, 9, 0), (0, 20, 20, 0, 0, 30, 30, 0)], key)
    gone = spark.createDataFrame([(0, 0, 1), (0, 6, 5)], "surface_id long, v int, u int")
    out = {(r.v1, r.t1): (r.at_v, r.at_u, r.end, r.scope) for r in cuts.witnesses(found, gone, 0).collect()}
    assert out == {(0, 0): (0, 1, 1, "triangle_participant"), (0, 1): (0, 1, 1, "quad_retention"), (20, 0): (None, None, None, None)}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    points, asked = rng.normal(size=(300, 3)) ** 3 * 40, rng.normal(size=(80, 3)) * 60
    p = spark.createDataFrame([(*map(float, x), i % 2, i) for i, x in enumerate(points)] + [(None, 0.0, 0.0, 0, 999)], "x double, y double, z double, g int, i int")
    q = spark.createDataFrame([(i, *map(float, x), i % 2) for i, x in enumerate(asked)] + [(500, None, 0.0, 0.0, 0), (501, 0.0, 0.0, 0.0, 7)], "qid long, x double, y double, z double, g int")
    out = {r.qid: r for r in spatial.nearest(q, p, list("xyz"), 0.5, F.col("p_i") >= 10, ("g",), ("i",)).collect()}
    assert len(out) == 82 and out[500].d is None and out[501].d is None
    for i, x in enumerate(asked):
        d = np.linalg.norm(points - x, axis=1)
        d[(np.arange(300) % 2 != i % 2) | (np.arange(300) < 10)] = np.inf
        assert out[i].near_i == int(d.argmin()) and abs(out[i].d - d.min()) < 1e-9
    assert [r.d for r in spatial.nearest(q.limit(2), p.where("false"), list("xyz"), 0.5).collect()] == [None, None]
    assert spatial.nearest(q.where("false"), p, list("xyz"), 0.5).count() == 0


def test_nearest_sheets_equal_brute_force_over_shells(spark):
    from laminar.functions import kernels

    rng = np.random.default_rng(2)
    shape = (rng.uniform(0, 90, (150, 1, 3)) + rng.normal(size=(150, 3, 3)) * 4).astype(np.float32)
    points = rng.uniform(-10, 100, (60, 3)).astype(np.float32)
    names = [f"{c}{k}" for c in "efg" for k in "xyz"]
    tri = spark.createDataFrame([(i % 12, *map(float, t.ravel())) for i, t in enumerate(shape)], "tag int, " + ", ".join(f"{c} double" for c in names))
    ask = spark.createDataFrame([(i, *map(float, x), i % 12) for i, x in enumerate(points)], "qid long, x double, y double, z double, grp int")
    out = {r.qid: r for r in gaps.nearest_sheets(ask, tri, 30.0, 2, 1.5).collect()}
    for i, x in enumerate(points):
        d = kernels.point_triangle(np.repeat(x[None], 150, 0), shape)
        tags = sorted((min(d[t::12]), t) for t in range(12) if abs(t - i % 12) >= 2)
        tags = [(a, t) for a, t in tags if a <= 30.0] + [(np.inf, None)] * 2
        assert (out[i].w1, out[i].w2) == (tags[0][1], tags[1][1])
        assert np.allclose([out[i].d1, out[i].d2], [tags[0][0], tags[1][0]], rtol=1e-5)


def test_centre_line_fills_gaps(spark):
    cells = [(0, v, u, float(u), 0.0, 0.0, not (u == 2 or (u in (0, 5) and v))) for v in range(3) for u in range(6)] + [(1, 0, 0, 0.0, 0.0, 0.0, True)]
    sheet = spark.createDataFrame(cells, mesh.VERTEX)
    out = {(r.surface_id, r.u): r.s for r in cuts.arclength(sheet).collect()}
    assert out == {(0, 0): 0.0, (0, 1): 0.0, (0, 2): 1.0, (0, 3): 2.0, (0, 4): 3.0, (0, 5): 3.0, (1, 0): 0.0}


def test_disagreement_thins_evenly(spark):
    flat = mesh.with_validity(grid(spark, plane(12, 12, 1.0, 0.0), surface=0).unionByName(grid(spark, plane(12, 12, 1.0, 3.0), surface=1)))
    flat = flat.unionByName(flat.where("v = 0 AND u = 0 AND surface_id = 1").withColumn("v", F.lit(50)).withColumn("z", F.lit(0.0).cast("float")))
    edges = spark.createDataFrame([(0, 1), (0, 7)], "a long, b long")
    for most in (4000, 37):
        out = {r.b: r for r in gaps.disagreement(flat, edges, 1.0, most).collect()}
        assert out[1].n_points == 144 and out[7].n_points is None
        d = [min(3.0, (v * v + u * u) ** 0.5) for v in range(12) for u in range(12)]
        if most < 144:
            d = [d[i] for i in np.linspace(0, 143, most).astype(int)]
        assert abs(out[1].mean - np.mean(d)) < 1e-9 and abs(out[1].p90 - np.percentile(d, 90)) < 1e-9


def test_product_space_events(spark):
    pairs = spark.createDataFrame([(0, 0, 0, 0, 9, 9), (0, 10, 9, 0, 1, 1), (0, 1, 0, 0, 20, 20), (0, 0, 0, 0, 9, 9)], "s1 long, v1 int, u1 int, s2 long, v2 int, u2 int")
    out = {(r.v1, r.v2): r.event for r in events.in_product_space(pairs).collect()}
    assert len(out) == 3 and out[0, 9] == out[10, 1] != out[1, 20]


def test_manifests(spark):
    table = lambda rows: spark.createDataFrame(rows, "k int, part string, digest string")
    a = table([(1, "x", "a"), (1, "y", None), (2, "x", "a"), (3, "x", None), (4, "x", "a"), (4, "y", "b")])
    b = table([(1, "x", "a"), (2, "x", "b"), (3, "x", "a"), (4, "x", "a"), (5, "x", "a")])
    assert {r.k: r.same for r in corpus.same_identity(a, b, "k", "part", "digest").collect()} == {1: True, 2: False, 3: None, 4: False, 5: None}
    assert {r.k: r.agrees for r in corpus.published_agrees(a, b, "k", "part", "digest").collect()} == {1: True, 2: False, 3: None, 4: False, 5: None}


def test_verification(spark):
    rows = spark.createDataFrame([("a", "done", True, True, True), ("b", None, False, None, False), ("c", "done", None, False, None)], "name string, state string, same boolean, clean boolean, ok boolean")
    r = corpus.verification(rows, "state", F.lit(True), F.col("same"), F.col("clean").isNotNull(), F.col("clean"), F.col("ok")).first()
    assert (r.n_records, r.n_match, r.n_mismatch, r.n_censused, r.n_clean, r.n_not_clean, r.n_ok, r.n_failed, r.states) == (3, 1, 2, 2, 1, 1, 1, 2, "done=2,none=1")
    failed = corpus.verification_failures(rows, "name", F.col("same"), F.col("clean"), F.col("ok"))
    assert sorted((x.name, x.problem) for x in failed.collect()) == [("b", "digest differs"), ("c", "digest differs")]
