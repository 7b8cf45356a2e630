"""Command line: check, transform, check-pairs and status.

check reports and ends with 0 whether or not the surface is clean; transform with 0 only when the written and reloaded
result is; check-pairs with 1 only with --fail-on-conflict and a conflict. Bad input ends with 2.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.functions.geometry import EXCLUDE, MAX_EDGE
from laminar.operators import census, corpus, excise, mesh, regions
from laminar.scratch import written
from laminar.ship import ship
from laminar.sources import files


#: Sites that a report lists; it says when there are more.
SITES = 2000


def surfaces(spark: SparkSession, path: str) -> DataFrame:
    """All mesh folders below a path, numbered in order of their paths, with validity."""
    found = files.read_surfaces(spark, path)
    folders = [r[0] for r in found.select("folder").distinct().orderBy("folder").collect()]
    if not folders:
        raise FileNotFoundError(f"no mesh below {path}")
    number = spark.createDataFrame(list(enumerate(folders)), "surface_id long, folder string")
    return mesh.with_validity(found.join(number, "folder"))


def check(spark: SparkSession, path: str, max_edge: float = MAX_EDGE, exclude: int = EXCLUDE) -> dict:
    """Counts under both diagonals, and sites of every surface below a path: of diagonal 0, or of 1 where only that one crosses."""
    vertices = surfaces(spark, path)
    found = written(census.of_both_diagonals(mesh.quads(vertices, max_edge), exclude=exclude, across=False), "contacts")
    counts = [census.verdict_counts(found.where(F.col("diagonal") == d)).first().asDict() for d in (0, 1)]
    clean = all(c["n_transverse"] == 0 for c in counts)
    shown = 0 if counts[0]["n_transverse"] else 1
    hit = found.where((F.col("verdict") == "transverse") & (F.col("diagonal") == shown))
    events = [] if clean else [r.asDict() for r in regions.sites(hit).orderBy("region_a", "region_b").limit(SITES + 1).collect()]
    boxes = [r.asDict() for r in mesh.bounding_boxes(vertices).orderBy("surface_id").collect()]
    return {"schema": "laminar_check/v1", "path": path, "clean": clean, "d0": counts[0], "d1": counts[1], "sites_diagonal": shown, "sites": events[:SITES], "sites_truncated": len(events) > SITES, "surfaces": boxes}


def transform(spark: SparkSession, path: str, out: str, budget: float = 0.01) -> dict:
    """Excises one surface, writes it, and judges what was written by reading it again."""
    vertices = surfaces(spark, path).drop("surface", "folder")
    now, removed, state = excise.excise(vertices)
    files.write_surface_folder(now, f"{out}/surface")
    after = check(spark, out)
    said = excise.certificate(vertices, now, budget).first().asDict()
    return {"schema": "laminar_transform/v1", "state": state, "removed_vertices": removed.count(), "clean": after["clean"], "reloaded": after, **said}


def check_pairs(spark: SparkSession, root: str, edges: str) -> dict:
    """A verdict for every edge of a list, in its order; a surface that is not there makes its edges not testable."""
    vertices = written(surfaces(spark, root), "surfaces")
    quads = written(mesh.quads(vertices), "quads")
    named = vertices.select("surface", "surface_id").distinct()
    if (twice := named.groupBy("surface").count().where("count > 1").first()) is not None:
        raise ValueError(f"several meshes are called {twice.surface}")
    asked = files.read_edges(spark, edges)
    for end in ("a", "b"):
        asked = asked.withColumnRenamed(end, f"name_{end}").join(named.select(F.col("surface").alias(f"name_{end}"), F.col("surface_id").alias(end)), f"name_{end}", "left")
    rows = census.pair_verdicts(asked, vertices, census.of_both_diagonals(quads), quads).orderBy("ordinal").collect()
    return {"schema": "laminar_pairs/v1", "edges": [{"a": r.name_a, "b": r.name_b, "verdict": r.verdict, "reason": r.reason, "n_transverse": r.n_transverse, "n_d0": r.n_d0, "n_d1": r.n_d1, "overlap_points": r.overlap_points} for r in rows]}


def status(spark: SparkSession, catalog: str, sample: str) -> dict:
    """Windings of a sample and the numbers missing between them."""
    rows = files.read_catalog(spark, catalog, sample).withColumn("sample", F.lit(sample))
    gaps = corpus.missing_numbers(rows, "sample", "winding").orderBy("winding").collect()
    return {"windings": [r.winding for r in rows.collect()], "missing": [r.winding for r in gaps]}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="laminar", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("check").add_argument("path")
    one = sub.add_parser("transform")
    one.add_argument("path")
    one.add_argument("out")
    one.add_argument("--budget", type=float, default=0.01)
    pairs = sub.add_parser("check-pairs")
    pairs.add_argument("--root", required=True)
    pairs.add_argument("--edges", required=True)
    pairs.add_argument("--fail-on-conflict", action="store_true")
    state = sub.add_parser("status")
    state.add_argument("catalog")
    state.add_argument("sample")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("laminar").getOrCreate()
    ship(spark)
    try:
        if args.command == "check":
            said = check(spark, args.path)
        elif args.command == "transform":
            said = transform(spark, args.path, args.out, args.budget)
        elif args.command == "check-pairs":
            said = check_pairs(spark, args.root, args.edges)
        else:
            said = status(spark, args.catalog, args.sample)
    except Exception as bad:  # noqa: BLE001
        print(f"laminar: {str(bad).splitlines()[0]}", file=sys.stderr)
        return 2
    print(json.dumps(said, indent=1, default=str))
    if args.command == "transform":
        return 0 if said["clean"] else 1
    if args.command == "check-pairs" and args.fail_on_conflict:
        return int(any(e["verdict"] == "conflict" for e in said["edges"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
