import json

from test_mesh import grid, hairpin, plane

from laminar import cli
from laminar.sources import files


def folder(spark, points, path):
    files.write_surface_folder(grid(spark, points), str(path))


def test_check_and_transform(spark, tmp_path, capsys):
    folder(spark, plane(8, 9), tmp_path / "flat" / "s")
    folder(spark, hairpin(6.0, cross=True, width=4, arm=8, cap=5), tmp_path / "bent" / "s")
    assert cli.main(["check", str(tmp_path / "flat")]) == 0
    assert json.loads(capsys.readouterr().out)["clean"] is True
    assert cli.main(["check", str(tmp_path / "bent")]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["clean"] is False and said["sites"]
    assert cli.main(["transform", str(tmp_path / "bent"), str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out)["clean"] is True
    assert cli.main(["check", str(tmp_path / "none")]) == 2


def test_check_pairs(spark, tmp_path, capsys):
    folder(spark, plane(8, 9), tmp_path / "m" / "s1")
    steep = plane(8, 9)
    steep[:, :, 0], steep[:, :, 2] = 20 + 0.7 * steep[:, :, 1], steep[:, :, 0] - 20.3
    folder(spark, steep, tmp_path / "m" / "s2")
    folder(spark, plane(8, 9, z=900.0), tmp_path / "m" / "s3")
    (tmp_path / "e.csv").write_text("a,b\ns1,s2\ns1,s3\ns1,s9\n")
    args = ["check-pairs", "--root", str(tmp_path / "m"), "--edges", str(tmp_path / "e.csv")]
    assert cli.main(args) == 0
    said = json.loads(capsys.readouterr().out)["edges"]
    assert [e["verdict"] for e in said] == ["conflict", "not_testable", "not_testable"]
    assert [e["reason"] for e in said] == [None, "extents do not meet", "surface not found"]
    assert cli.main([*args, "--fail-on-conflict"]) == 1
