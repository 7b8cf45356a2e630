import json

import numpy as np
from pyspark.sql import functions as F

from laminar.functions import intervals
from laminar.operators import corpus, mesh, stats
from laminar.sources import files
from laminar.streaming import running


def test_tiff_round_trip():
    x = np.random.default_rng(0).normal(size=(5, 7)).astype(np.float32)
    assert (files.decode_tiff(files.encode_tiff(x)) == x).all()
    m = (x > 0).astype("u1")
    assert (files.decode_tiff(files.encode_tiff(m)) == m).all()


def test_surface_folder_round_trip(spark, tmp_path):
    rows = [(0, v, u, 1.5 * u, 2.0 * v, 3.0, not (v == 1 and u == 1)) for v in range(3) for u in range(4)]
    files.write_surface_folder(spark.createDataFrame(rows, mesh.VERTEX), str(tmp_path / "m1"))
    got = files.read_surfaces(spark, str(tmp_path))
    assert got.count() == 12 and got.where("valid").count() == 11
    assert got.where("v = 2 AND u = 3").first().x == 4.5
    assert json.load(open(tmp_path / "m1" / "meta.json"))["bbox"][1] == [4.5, 4.0, 3.0]


def test_contacts_csv(spark, tmp_path):
    rows = [(1, 2, 5, 6, "transverse", 0.5, 12.345, 0, 1, 0, 0), (0, 2, 5, 6, "grazing", 0.0, 1.0, 0, 1, 0, 0)]
    contacts = spark.createDataFrame(rows, files.CONTACT)
    files.write_contacts(contacts, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*.csv")).read_text().splitlines()
    assert text[1].startswith("0,2,5,6,grazing,0,1.00") and ",0.5,12.3" in text[2]
    assert files.read_contacts(spark, str(tmp_path / "c"), "transverse").count() == 1
    out = files.out_of_range(contacts, 6, 7).first()
    assert (out.n_inside, out.n_outside) == (0, 2)


def test_obj_edges_catalog(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nvt 0 0\nvt 0.5 0\nvt 1 1\nf 1/1 2/2 3/3\n")
    points, faces = files.read_obj(spark, str(tmp_path / "a.obj"), 10.0)
    assert points.count() == 3 and faces.first().tag == 5
    (tmp_path / "e.txt").write_text("a,b\n# none\ns1,s2\ns3 s4\n")
    assert [(r.a, r.b) for r in files.read_edges(spark, str(tmp_path / "e.txt")).orderBy("ordinal").collect()] == [("s1", "s2"), ("s3", "s4")]
    (tmp_path / "c.json").write_text(json.dumps({"samples": {"p": {"segments": {"a": {"long_id": "x-w012_b"}, "b": {"long_id": "y"}, "c": {"long_id": "w003"}}}}}))
    assert [r.winding for r in files.read_catalog(spark, str(tmp_path / "c.json"), "p").collect()] == [3, 12, None]


def test_point_collection(spark):
    said = files.point_collection(spark.createDataFrame([(2, 1.0, 2.0, 3.0), (1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double"), "n").first().value
    assert json.loads(said) == {"name": "n", "points": {"1": {"p": [0.0, 0.0, 0.0]}, "2": {"p": [1.0, 2.0, 3.0]}}}


def test_intervals_against_sampling():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 40, 3, 3))
    d = np.array([0.0, 0.0, 1.0])
    low, high = intervals.pair_intervals(a, b, d)
    for i in range(40):
        for t in np.linspace(-4, 4, 41):
            l0, h0 = intervals.pair_intervals(a[[i]] + t * d, b[[i]], d)
            meets = not np.isnan(l0[0]) and l0[0] <= 0 <= h0[0]
            assert meets == (not np.isnan(low[i]) and low[i] - 1e-9 <= t <= high[i] + 1e-9)


def test_least_exit_parts_triangles():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = rng.normal(size=(2, 3, 3))
        depth, way = intervals.least_exit(a, b)
        low, high = intervals.pair_intervals(a[None], b[None], np.array([0.3, 0.5, 0.8]))
        if depth > 0:
            moved = a + way * 1.0001
            l1, h1 = intervals.pair_intervals(moved[None], b[None], way / np.linalg.norm(way))
            assert np.isnan(l1[0]) or not l1[0] <= 0 <= h1[0]


def test_harmonic_is_linear_on_a_path():
    got = intervals.harmonic(5, np.array([[0, 1], [1, 2], [2, 3], [3, 4]]), {0: 0.0, 4: 1.0})
    assert np.allclose(got, [0, 0.25, 0.5, 0.75, 1])


def test_auc_ties_and_empty_class(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, False), ("b", 2.0, True)], "g string, s double, p boolean")
    out = {r.g: r.auc for r in stats.rank_auc(rows, ["g"], "s", "p").collect()}
    assert out == {"a": 0.5, "b": None}


def test_truncation_never_rounds_up(spark):
    got = spark.createDataFrame([(0.98997,), (0.9999999,)], "x double").select(corpus.truncated_pct(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == [98.997, 99.999]


def test_stream_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 {i:02d}:10:00", "k", float(i)) for i in range(6)], "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.limit(3).write.parquet(str(tmp_path / "in"))
    go = lambda: running.run_once(running.stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    go()
    rows.where("event_id >= 3").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert running.windowed(rows).count() == 6
