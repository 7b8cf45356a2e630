"""What a cut leaves: its boundary, the pieces that remain, witnesses for what it destroyed, and reports in physical units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laminar.functions import geometry as G
from laminar.operators import mesh, regions

_QUAD = ["surface_id", "v", "u"]


def side_edges(quads: DataFrame) -> DataFrame:
    """The four perimeter edges of each quad with corners: its first vertex (ev, eu), along (0: to the next column, 1: to the next row), length."""
    sides = [("p00", "p01", 0, 0, 0), ("p10", "p11", 1, 0, 0), ("p00", "p10", 0, 0, 1), ("p01", "p11", 0, 1, 1)]
    edge = [F.struct((F.col("v") + dv).alias("ev"), (F.col("u") + du).alias("eu"), F.lit(along).alias("along"), F.expr(G.distance(p, q)).alias("length")) for p, q, dv, du, along in sides]
    return quads.select("*", F.explode(F.array(*edge)).alias("edge")).select(*quads.columns, "edge.*")


def cut_boundary(quads: DataFrame) -> DataFrame:
    """Of each surface the edges between a removed and a kept quad, and their length. quads: corners, removed, kept.

    Every surface has a row; an edge is found by one grouping, no neighbour join."""
    edges = side_edges(quads.select(*_QUAD, "removed", "kept", *[f"{p}{k}" for p in G.CORNERS for k in "xyz"]))
    both = edges.groupBy("surface_id", "ev", "eu", "along").agg(F.bool_or("removed").alias("r"), F.bool_or("kept").alias("k"), F.min("length").alias("length"))
    cut = F.col("r") & F.col("k")
    return both.groupBy("surface_id").agg(F.count_if(cut).alias("n_edges"), F.sum(F.when(cut, F.col("length")).otherwise(0.0)).alias("length"))


def quad_components(quads: DataFrame) -> DataFrame:
    """surface_id, v, u and piece (its least quad, as a number) of each quad given: quads are tied by a shared corner."""
    cells = quads.select(regions.code(F.col("surface_id"), F.col("v"), F.col("u")).alias("cell"))
    s, v, u = regions.decoded(F.col("cell"))
    return regions.labelled(cells).select(s.alias("surface_id"), v.alias("v"), u.alias("u"), F.col("region").alias("piece"))


def piece_report(quads: DataFrame) -> DataFrame:
    """Of each surface: its quads, its pieces, the quads of the largest one, and the pieces of a single quad."""
    sizes = quad_components(quads).groupBy("surface_id", "piece").agg(F.count("*").alias("n"))
    return sizes.groupBy("surface_id").agg(F.sum("n").alias("n_quads"), F.count("*").alias("n_pieces"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("n_single"))


def _candidates(diagonal: int) -> list[tuple[int, int, int, int, str]]:
    """(end, triangle, dv, du, scope) in the order in which a witness is sought: an end's triangle, then its quad's other corner."""
    out = []
    for end in (1, 2):
        for t, corners in enumerate(G.TRIANGLES[diagonal]):
            own = [G.CORNERS[c] for c in corners]
            out += [(end, t, dv, du, "triangle_participant") for dv, du in own]
            out += [(end, t, dv, du, "quad_retention") for dv, du in G.CORNERS.values() if (dv, du) not in own]
    return out


def witnesses(contacts: DataFrame, invalidated: DataFrame, diagonal: int) -> DataFrame:
    """Contacts (s, v, u, t of both ends) with the invalidated vertex (surface_id, v, u) that destroys each: at_v, at_u, the end it lies
    on and its scope: a corner of the contact's triangle, or only of that triangle's quad. Null where no corner is invalidated."""
    key = [f"{n}{i}" for i in (1, 2) for n in "svut"]
    places = [F.struct(F.lit(rank).alias("rank"), F.col(f"s{end}").alias("surface_id"), (F.col(f"v{end}") + dv).alias("v"), (F.col(f"u{end}") + du).alias("u"), F.lit(end).alias("end"), F.lit(scope).alias("scope"), (F.col(f"t{end}") == t).alias("ours"))
              for rank, (end, t, dv, du, scope) in enumerate(_candidates(diagonal))]
    asked = contacts.select(*key).distinct()
    spread = asked.select(*key, F.explode(F.array(*places)).alias("p")).where("p.ours").select(*key, "p.*")
    hit = spread.join(invalidated.select(*_QUAD).distinct(), _QUAD)
    best = hit.groupBy(*key).agg(F.min(F.struct("rank", "v", "u", "end", "scope")).alias("w"))
    return asked.join(best, key, "left").select(*key, F.col("w.v").alias("at_v"), F.col("w.u").alias("at_u"), F.col("w.end").alias("end"), F.col("w.scope").alias("scope"))


def under_both(contacts: DataFrame) -> DataFrame:
    """Quad pairs that cross transversely under either diagonal. contacts: with a column diagonal."""
    pair = ["s1", "v1", "u1", "s2", "v2", "u2"]
    one = lambda d: contacts.where((F.col("verdict") == "transverse") & (F.col("diagonal") == d)).select(*pair)
    return one(0).intersect(one(1))


def physical_report(vertices: DataFrame, contacts: DataFrame, voxel_um: float, cut_mm: float) -> DataFrame:
    """Of each surface, in physical units: column pitch, area, and of its own transverse contacts their number, farthest reach and its
    99th percentile, area of the quads that take part (each once), its share of all, events beyond cut_mm, and the middle depth.

    Areas are of all quads with four valid corners, under diagonal 0. Surfaces without a contact have zeros and no percentile."""
    mm = voxel_um / 1000.0
    quads = mesh.areas(mesh.quads(vertices), voxel_um).select(*_QUAD, "area_mm2")
    points = vertices.where("valid").select(*_QUAD, *[F.col(k).cast("double").alias(k) for k in "xyz"])
    w = Window.partitionBy("surface_id", "v").orderBy("u")
    step = sum(((F.lead(k).over(w) - F.col(k)) * (F.lead(k).over(w) - F.col(k)) for k in "xyz"), F.lit(0.0))
    steps = points.select("surface_id", F.when(F.lead("u").over(w) == F.col("u") + 1, F.sqrt(step)).alias("step"))
    pitch = steps.groupBy("surface_id").agg((F.median("step") * voxel_um).alias("pitch_um"))
    whole = quads.groupBy("surface_id").agg(F.sum("area_mm2").alias("total_area_mm2"))
    own = contacts.where("verdict = 'transverse' AND s1 = s2").join(pitch.select(F.col("surface_id").alias("s1"), "pitch_um"), "s1")
    own = own.withColumn("sep_mm", F.greatest(F.abs(F.col("v1") - F.col("v2")), F.abs(F.col("u1") - F.col("u2"))) * F.col("pitch_um") / 1000.0)
    sums = own.groupBy(F.col("s1").alias("surface_id")).agg(
        F.count("*").alias("pairs"), F.max("sep_mm").alias("overlap_extent_mm"), F.percentile("sep_mm", F.lit(0.99)).alias("overlap_extent_p99_mm"),
        F.median(F.col("penetration").cast("double")).alias("median_penetration_vx"))
    ends = own.select(F.col("s1").alias("surface_id"), F.explode(F.array(*[F.struct(F.col(f"v{i}").alias("v"), F.col(f"u{i}").alias("u")) for i in (1, 2)])).alias("q"))
    twice = ends.select("surface_id", "q.v", "q.u").distinct().join(quads, _QUAD).groupBy("surface_id").agg(F.sum("area_mm2").alias("duplicated_area_mm2"))
    far = regions.events(own.where(F.col("sep_mm") > cut_mm).drop("pitch_um", "sep_mm"))
    far = far.groupBy(regions.decoded(F.col("region_a"))[0].alias("surface_id")).agg(F.count("*").alias("events_beyond_cut"))
    out = whole.join(pitch, "surface_id", "left").join(sums, "surface_id", "left").join(twice, "surface_id", "left").join(far, "surface_id", "left")
    out = out.na.fill(0, ["pairs", "events_beyond_cut"]).na.fill(0.0, ["overlap_extent_mm", "duplicated_area_mm2"])
    share = F.when(F.col("total_area_mm2") > 0, F.col("duplicated_area_mm2") / F.col("total_area_mm2")).otherwise(0.0)
    return out.select("surface_id", "pitch_um", "total_area_mm2", "pairs", "overlap_extent_mm", "overlap_extent_p99_mm", "duplicated_area_mm2", share.alias("duplicated_fraction"), "events_beyond_cut", "median_penetration_vx")


def floor_taint(vertices: DataFrame, contacts: DataFrame) -> DataFrame:
    """Of each surface: valid cells on or under the floor (z <= 0), its own transverse contacts, those with an end on a quad that has such a
    corner, their share, and whether without them nothing would be left of the verdict."""
    low = vertices.where(F.col("valid") & (F.col("z") <= 0)).select(*_QUAD)
    corner = F.explode(F.array(*[F.struct(F.lit(dv).alias("dv"), F.lit(du).alias("du")) for dv, du in G.CORNERS.values()])).alias("c")
    bad = low.select("*", corner).select("surface_id", (F.col("v") - F.col("c.dv")).alias("v"), (F.col("u") - F.col("c.du")).alias("u")).distinct()
    rows = contacts.where("verdict = 'transverse' AND s1 = s2")
    for i in (1, 2):
        side = bad.select(F.col("surface_id").alias("s1"), F.col("v").alias(f"v{i}"), F.col("u").alias(f"u{i}"), F.lit(True).alias(f"bad{i}"))
        rows = rows.join(side, ["s1", f"v{i}", f"u{i}"], "left")
    tainted = F.col("bad1").isNotNull() | F.col("bad2").isNotNull()
    counts = rows.groupBy(F.col("s1").alias("surface_id")).agg(F.count("*").alias("transverse_rows"), F.count_if(tainted).alias("rows_touching_floor"))
    cells = vertices.groupBy("surface_id").agg(F.count_if(F.col("valid") & (F.col("z") <= 0)).alias("floor_cells"))
    out = cells.join(counts, "surface_id", "left").na.fill(0, ["transverse_rows", "rows_touching_floor"])
    some = F.col("transverse_rows") > 0
    return out.withColumn("fraction", F.when(some, F.col("rows_touching_floor") / F.col("transverse_rows")).otherwise(0.0)).withColumn("would_flip", some & (F.col("rows_touching_floor") == F.col("transverse_rows")))


def arclength(vertices: DataFrame, least: int = 3) -> DataFrame:
    """surface_id, u, s: length along the centre line of column medians up to each column of the surface's grid.

    Columns of fewer than `least` valid cells are filled in linearly, level beyond the first and last line point; a surface with
    under two line points has zeros."""
    columns = vertices.groupBy("surface_id", "u").agg(F.count_if("valid").alias("n"), *[F.median(F.when(F.col("valid"), F.col(k).cast("double"))).alias(k) for k in "xyz"])
    line = columns.where(F.col("n") >= least)
    w = Window.partitionBy("surface_id").orderBy("u")
    step = F.sqrt(sum(((F.col(k) - F.lag(k).over(w)) * (F.col(k) - F.lag(k).over(w)) for k in "xyz"), F.lit(0.0)))
    known = line.select("surface_id", "u", F.coalesce(step, F.lit(0.0)).alias("step")).withColumn("s", F.sum("step").over(w))
    at = columns.select("surface_id", "u").join(known.select("surface_id", "u", "s", F.col("u").alias("ku")), ["surface_id", "u"], "left")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = at.select("surface_id", "u", *[f(c, True).over(o).alias(f"{c}_{n}") for c in ("s", "ku") for n, f, o in (("a", F.last, before), ("b", F.first, after))])
    t = (F.col("u") - F.col("ku_a")) / (F.col("ku_b") - F.col("ku_a"))
    between = F.when(F.col("ku_a") == F.col("ku_b"), F.col("s_a")).otherwise(F.col("s_a") + t * (F.col("s_b") - F.col("s_a")))
    return at.select("surface_id", "u", F.coalesce(between, "s_a", "s_b", F.lit(0.0)).alias("s"))
