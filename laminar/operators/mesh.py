"""Gridded surfaces: vertices, quads, triangles, row-local metrics and grid stencils."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laminar.functions import geometry as G

#: A table of grid points; a missing cell is (-1, -1, -1), not finite, or not valid.
VERTEX = "surface_id long, v int, u int, x float, y float, z float, valid boolean"


def with_validity(vertices: DataFrame) -> DataFrame:
    """valid: given, finite and not the missing mark; valid_upstream: valid with z > 0, kept beside it."""
    marked = (F.col("x") == -1) & (F.col("y") == -1) & (F.col("z") == -1)
    finite = F.lit(True)
    for k in "xyz":
        finite = finite & F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(F.col(k)) < float("inf"))
    given = F.coalesce(F.col("valid"), F.lit(True)) if "valid" in vertices.columns else F.lit(True)
    valid = F.coalesce(given & finite & ~marked, F.lit(False))
    return vertices.withColumn("valid", valid).withColumn("valid_upstream", F.col("valid") & F.coalesce(F.col("z") > 0, F.lit(False)))


def quads(vertices: DataFrame, max_edge: float = G.MAX_EDGE) -> DataFrame:
    """Quads whose four corners are valid, with corner coordinates as doubles, longest edge and retained.

    Every vertex goes to the quads it is a corner of, which then need one grouping instead of three joins."""
    points = vertices.where("valid").select("surface_id", "v", "u", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    corner = F.explode(F.array(*[F.struct(F.lit(dv).alias("dv"), F.lit(du).alias("du")) for dv, du in G.CORNERS.values()])).alias("c")
    spread = points.select("*", corner).select("surface_id", (F.col("v") - F.col("c.dv")).alias("v"), (F.col("u") - F.col("c.du")).alias("u"), (F.col("c.dv") * 2 + F.col("c.du")).alias("k"), "x", "y", "z")
    parts = [F.max(F.when(F.col("k") == dv * 2 + du, F.col(a))).alias(f"{name}{a}") for name, (dv, du) in G.CORNERS.items() for a in "xyz"]
    whole = spread.groupBy("surface_id", "v", "u").agg(F.count("*").alias("n"), *parts).where("n = 4").drop("n")
    longest = whole.selectExpr("*", f"{G.LONGEST_EDGE} AS max_edge")
    return longest.withColumn("retained", F.lit(True) if max_edge <= 0 else F.col("max_edge") <= max_edge)


def triangles(found: DataFrame, diagonal: int = 0) -> DataFrame:
    """The two triangles of each retained quad under a diagonal, with box and unit normal."""
    parts = []
    for t, corners in enumerate(G.TRIANGLES[diagonal]):
        points = [F.col(f"{p}{a}").alias(f"{c}{a}") for c, p in zip("efg", corners) for a in "xyz"]
        parts.append(F.struct(F.lit(t).alias("t"), *points))
    flat = found.where("retained").select("surface_id", "v", "u", F.explode(F.array(*parts)).alias("q")).select("surface_id", "v", "u", "q.*")
    return G.staged(flat, G.TRIANGLE).drop("rawx", "rawy", "rawz")


def areas(found: DataFrame, voxel_um: float | None = None) -> DataFrame:
    """Area of each quad under both diagonals, and their mean; in mm2 (diagonal 0) with a voxel size."""
    out = G.staged(found, G.QUAD_AREA).select(*found.columns, "area_d0", "area_d1", "area")
    return out if voxel_um is None else out.withColumn("area_mm2", F.col("area_d0") * (voxel_um / 1000.0) ** 2)


def metrics(found: DataFrame) -> DataFrame:
    return G.staged(found, G.QUAD_METRICS).select(*found.columns, "twist", "aspect", "planarity", "longest", "shortest")


def _along(axis: str):
    other = "u" if axis == "v" else "v"
    return Window.partitionBy("surface_id", other).orderBy(axis)


def _neighbour(column: str, axis: str, step: int):
    """Value `step` cells on along an axis; null where the grid has no such valid cell."""
    move = F.lead if step > 0 else F.lag
    w = _along(axis)
    found = None
    for k in range(1, abs(step) + 1):  # gaps shift rows: the wanted cell is at most |step| rows away
        here = F.when(move(axis, k).over(w) == F.col(axis) + step, move(column, k).over(w))
        found = here if found is None else F.coalesce(found, here)
    return found


def normals(vertices: DataFrame, reach: int = 2) -> DataFrame:
    """Unit normal by central differences over `reach` cells; one-sided at a border, null where both sides are missing."""
    points = vertices.where("valid").select("surface_id", "v", "u", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    for axis in "vu":
        for k in "xyz":
            points = points.withColumn(f"{axis}_{k}", F.coalesce(_neighbour(k, axis, reach), F.col(k)) - F.coalesce(_neighbour(k, axis, -reach), F.col(k)))
    n = {"x": "u_y*v_z - u_z*v_y", "y": "u_z*v_x - u_x*v_z", "z": "u_x*v_y - u_y*v_x"}
    out = points.selectExpr("*", *[f"{e} AS r{k}" for k, e in n.items()]).selectExpr("*", "sqrt(rx*rx + ry*ry + rz*rz) AS rl")
    return out.selectExpr("surface_id", "v", "u", *[f"CASE WHEN rl > 1e-12 THEN r{k} / rl END AS n{k}" for k in "xyz"])


def wobble(vertices: DataFrame) -> DataFrame:
    """Length of the four-neighbour Laplacian of each valid cell that has all four neighbours."""
    points = vertices.where("valid").select("surface_id", "v", "u", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    terms = [sum((_neighbour(k, a, s) for a in "vu" for s in (1, -1)), F.lit(0.0)) / 4 - F.col(k) for k in "xyz"]
    laplacian = points.select("surface_id", "v", "u", *[t.alias(f"l{k}") for k, t in zip("xyz", terms)])
    return laplacian.where("lx IS NOT NULL AND ly IS NOT NULL AND lz IS NOT NULL").selectExpr("surface_id", "v", "u", "sqrt(lx*lx + ly*ly + lz*lz) AS wobble")


def sampled(vertices: DataFrame, stride: int) -> DataFrame:
    """Every stride-th valid cell in both directions."""
    return vertices.where("valid").where((F.col("v") % stride == 0) & (F.col("u") % stride == 0))


def bounding_boxes(vertices: DataFrame) -> DataFrame:
    """Box of each surface's valid points, zeros where it has none."""
    ends = [f(F.when(F.col("valid"), F.col(k).cast("double"))).alias(f"{n}_{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in "xyz"]
    out = vertices.groupBy("surface_id").agg(F.count_if("valid").alias("n_valid"), F.count_if(F.col("valid") & ~F.col("valid_upstream")).alias("z_floor_cells"), *ends)
    return out.na.fill(0.0, [f"{n}_{k}" for n in ("lo", "hi") for k in "xyz"])


def eroded(vertices: DataFrame, rounds: int = 1) -> DataFrame:
    """valid after `rounds` erosions by the 3 x 3 neighbourhood; cells beyond the grid count as missing."""
    cells = vertices.select("surface_id", "v", "u", "valid")
    for _ in range(rounds):
        step = F.explode(F.array(*[F.struct(F.lit(a).alias("dv"), F.lit(b).alias("du")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
        votes = cells.where("valid").select("surface_id", "v", "u", step).select("surface_id", (F.col("v") + F.col("s.dv")).alias("v"), (F.col("u") + F.col("s.du")).alias("u"))
        full = votes.groupBy("surface_id", "v", "u").agg(F.count("*").alias("n")).where("n = 9").select("surface_id", "v", "u", F.lit(True).alias("stays"))
        cells = cells.join(full, ["surface_id", "v", "u"], "left").select("surface_id", "v", "u", F.coalesce("stays", F.lit(False)).alias("valid"))
    return cells


def section(vertices: DataFrame, z: float) -> DataFrame:
    """Where each column of a surface first passes a z plane, by linear interpolation between rows."""
    w = _along("v")
    points = vertices.where("valid").select("surface_id", "v", "u", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    step = points.select("*", *[F.lead(k).over(w).alias(f"{k}1") for k in ("v", "x", "y", "z")])
    hit = step.where((F.col("v1") == F.col("v") + 1) & ((F.col("z") - z) * (F.col("z1") - z) <= 0) & (F.col("z") != F.col("z1")))
    t = (F.lit(z) - F.col("z")) / (F.col("z1") - F.col("z"))
    at = hit.select("surface_id", "u", "v", *[(F.col(k) + t * (F.col(f"{k}1") - F.col(k))).alias(f"at_{k}") for k in "xy"])
    return at.withColumn("k", F.row_number().over(Window.partitionBy("surface_id", "u").orderBy("v"))).where("k = 1").drop("k")
