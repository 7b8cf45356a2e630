"""Nearest sheets: distances from points to triangles of other groups, and what a surface's own gaps say."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laminar.functions import kernels
from laminar.operators import regions, spatial
from laminar.scratch import written

#: Distance under which a cell is flagged, under which a grower would merge, share of a period to exclude,
#: and how many exclusions away flagged partners must lie.
FLAG, GROWER, AUTO, SAFETY = 6.0, 12.0, 0.25, 2.0

_CORNERS = [f"{c}{k}" for c in "efg" for k in "xyz"]


def nearest_sheets(queries: DataFrame, triangles: DataFrame, reach: float, exclude: int, first: float | None = None) -> DataFrame:
    """Of each query (qid, x, y, z, grp) the nearest two tags of triangles (tag, corners) within `reach`: w1, d1, w2, d2.

    A tag counts when it is `exclude` or more away from grp. Shells: the search begins within `first` (a sixteenth of the reach where
    not given, 4 at least) and goes on in cells four times as wide for queries that have not met two tags yet, so that few rows pay for
    a far reach; two tags found within a shell's reach are the nearest of all. Triangles go to every cell that their box meets, queries to
    every cell within the shell's reach; a pair that meets in several cells is measured in the first. Distances are taken in single precision on
    Arrow batches and summed to a minimum per tag map-side. Infinity and null where there is none within `reach`; qid is unique."""
    kinds = dict(triangles.dtypes)["tag"]
    corners = triangles.select("tag", *[F.col(c).cast("float").alias(c) for c in _CORNERS])
    still = queries.select("qid", "grp", *[F.col(k).cast("float").alias(k) for k in "xyz"])
    shell, parts = min(reach, first or max(4.0, reach / 16)), []
    while True:
        best = written(_tags_within(still, corners, kinds, shell, exclude), "sheets")
        last = shell >= reach
        settled = best if last else best.where("w2 IS NOT NULL")
        parts.append(settled)
        if last:
            break
        still = written(still.join(settled.select("qid"), "qid", "left_anti"), "sheets-open")
        if still.isEmpty():
            break
        shell = min(reach, shell * 4)
    two = parts[0]
    for part in parts[1:]:
        two = two.unionByName(part)
    none = F.lit(float("inf")).cast("float")
    return queries.select("qid").join(two, "qid", "left").select("qid", "w1", F.coalesce("d1", none).alias("d1"), "w2", F.coalesce("d2", none).alias("d2"))


def _tags_within(queries: DataFrame, corners: DataFrame, kinds: str, reach: float, exclude: int) -> DataFrame:
    """qid, w1, d1, w2, d2 of the queries that have a tag within `reach`."""
    # Cells wider than the reach: a query's surroundings meet few of them, and boxes out of reach are left out before Arrow.
    size = 3.0 * reach
    cells, at = corners, queries
    for k in "xyz":
        low, high = (F.floor(f(*[f"{c}{k}" for c in "efg"]) / size).cast("int") for f in (F.least, F.greatest))
        cells = cells.withColumn(f"g_{k}", low).withColumn(f"c_{k}", F.explode(F.sequence(low, high)))
        low, high = (F.floor((F.col(k) + way * reach) / size).cast("int") for way in (-1, 1))
        at = at.withColumn(f"c_{k}", F.explode(F.sequence(low, high)))
    keys = ["c_x", "c_y", "c_z"]
    met = at.join(cells.select("tag", *_CORNERS, "g_x", "g_y", "g_z", *keys), keys).where(F.abs(F.col("tag") - F.col("grp")) >= exclude)
    for k in "xyz":
        low, high = (f(*[f"{c}{k}" for c in "efg"]) for f in (F.least, F.greatest))
        met = met.where((F.col(k) >= low - reach) & (F.col(k) <= high + reach))
        met = met.where(F.col(f"c_{k}") == F.greatest(F.floor((F.col(k) - reach) / size).cast("int"), f"g_{k}"))

    def measure(batches):
        for batch in batches:
            points = np.stack([batch.column(k).to_numpy() for k in "xyz"], 1)
            shape = np.stack([batch.column(c).to_numpy() for c in _CORNERS], 1).reshape(-1, 3, 3)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("tag"), pa.array(kernels.point_triangle(points, shape).astype(np.float32))], names=["qid", "tag", "d"])

    found = met.select("qid", "tag", "x", "y", "z", *_CORNERS).mapInArrow(measure, f"qid long, tag {kinds}, d float").where(F.col("d") <= reach)
    best = found.groupBy("qid", "tag").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "tag"))).where("r <= 2")
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    return best.groupBy("qid").agg(pick("tag", 1).alias("w1"), pick("d", 1).alias("d1"), pick("tag", 2).alias("w2"), pick("d", 2).alias("d2"))


def exclusion(results: DataFrame, probe: int, reach: float = 4 * FLAG) -> int | None:
    """Columns to leave out around a cell, from a probe with a small exclusion (u, w1, d1): a quarter of the median step to the
    partner. None with under 50 partners in reach, or a period under four probes."""
    row = results.where(F.col("d1") < reach).agg(F.count("*").alias("n"), F.median(F.abs(F.col("w1") - F.col("u"))).alias("period")).first()
    if row.n < 50 or row.period < 4 * probe:
        return None
    return int(max(row.period * AUTO, 3))


def analyse(results: DataFrame, exclude: int) -> DataFrame:
    """One row of a surface's gaps (v, u on the sampled grid, col, w1, d1). Shares are of all cells submitted, not of the measured."""
    ok = F.col("d1") < float("inf")
    flagged = results.where(ok & (F.col("d1") < FLAG))
    cells = flagged.select(regions.code(F.lit(0), F.col("v"), F.col("u")).alias("cell"))
    blobs = [regions.labelled(cells, diagonal=d).groupBy("region").agg(F.count("*").alias("n")) for d in (True, False)]
    top = blobs[0].agg(F.max("n").alias("largest_blob"), F.slice(F.sort_array(F.collect_list("n"), False), 1, 5).alias("t"), F.sum("n").alias("all"))
    top = top.select("largest_blob", (F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x) / F.col("all")).alias("top5_share")).first()
    four = blobs[1].agg(F.max("n").alias("n")).first().n
    du = F.abs(F.col("w1") - F.col("col")).cast("double")
    sums = results.agg(
        F.count("*").alias("n_queries"), F.count_if(ok).alias("n_measurable"), F.median(F.when(ok, F.col("d1").cast("double"))).alias("median_gap"),
        F.count_if(ok & (F.col("d1") < GROWER)).alias("n_grower"), F.count_if(ok & (F.col("d1") < FLAG)).alias("n_flagged"),
        F.percentile(F.when(ok & (F.col("d1") < FLAG), du), F.lit(0.1)).alias("p10"), F.median(F.when(ok & (F.col("d1") < FLAG), du)).alias("p50"),
    )
    many = F.col("n_flagged") > 20
    near = many & (F.col("p10") < SAFETY * exclude)
    reason = F.when(F.col("n_measurable") == 0, "no neighbour in reach").when(F.col("n_flagged") == 0, "nothing flagged").when(~many, "too few flagged").when(near, "partners too near the exclusion").otherwise("ok")
    return sums.select(
        "n_queries", "n_measurable", (F.col("n_measurable") / F.col("n_queries")).alias("coverage"), "median_gap", (F.col("n_grower") / F.col("n_queries")).alias("frac_grower"),
        (F.col("n_flagged") / F.col("n_queries")).alias("frac_flagged"), F.lit(top.largest_blob or 0).alias("largest_blob"), (F.lit(top.largest_blob or 0) / F.col("n_queries")).alias("blob_fraction"),
        F.lit(four or 0).alias("largest_blob_4c"), F.lit(top.top5_share or 0.0).alias("top5_share"), F.when(many, F.col("p10")).alias("du_p10"), F.when(many, F.col("p50")).alias("du_median"),
        (~F.coalesce(near, F.lit(False))).alias("valid"), reason.alias("reason"))


def planted(vertices: DataFrame, v0: int, v1: int, u0: int, u1: int, period: int, feather: int = 6) -> DataFrame:
    """A surface whose cells [v0, v1) x [u0, u1) follow the wrap one period before, blended over `feather` cells at the edge."""
    u0 = max(period, u0)
    before = vertices.where("valid").select("surface_id", "v", (F.col("u") + period).alias("u"), *[F.col(k).alias(f"{k}0") for k in "xyz"])
    hit = F.col("v").between(v0, v1 - 1) & F.col("u").between(u0, u1 - 1)
    edge = F.least(F.col("v") - v0, F.lit(v1 - 1) - F.col("v"), F.col("u") - u0, F.lit(u1 - 1) - F.col("u"))
    w = F.least(F.lit(1.0), edge / F.lit(float(max(feather, 1))))
    ok = hit & F.col("valid") & F.col("x0").isNotNull()
    out = vertices.join(before, ["surface_id", "v", "u"], "left")
    return out.withColumns({k: F.when(ok, (w * F.col(f"{k}0") + (1 - w) * F.col(k)).cast("float")).otherwise(F.col(k)) for k in "xyz"}).select(vertices.columns)


def revolution_periods(vertices: DataFrame) -> DataFrame:
    """Columns a surface needs for a full turn, from how its centre line of column medians winds; null where it hardly turns."""
    valid = vertices.where("valid")
    line = valid.groupBy("surface_id", "u").agg(F.count("*").alias("n"), *[F.median(F.col(k).cast("double")).alias(k) for k in "xyz"]).where("n >= 3")

    def turn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("u")
        period = float("nan")
        if len(frame) >= 8:
            points = frame[list("xyz")].to_numpy()
            points = points - points.mean(0)
            _, _, axes = np.linalg.svd(points, full_matrices=False)
            flat = points @ axes[:2].T
            turned = abs(float(np.diff(np.unwrap(np.arctan2(flat[:, 1], flat[:, 0]))).sum()))
            if turned >= 0.35:
                period = (frame.u.iloc[-1] - frame.u.iloc[0]) * 2 * np.pi / turned
        return pd.DataFrame({"surface_id": [frame.surface_id.iloc[0]], "period": [period]})

    return line.groupBy("surface_id").applyInPandas(turn, "surface_id long, period double")


def disagreement(vertices: DataFrame, edges: DataFrame, first: float, most: int | None = None, least: int = 50) -> DataFrame:
    """Of each edge (a, b) of surfaces: how far a's points within b's box lie from b's points: n_points, median, p90, mean.

    All of these points are asked, or `most` of them where given, evenly spaced in grid order (n_points counts all); the search begins within
    a quarter of `first`. An edge has a row of nulls where either surface, or what lies in the box, has under `least` points."""
    points = written(vertices.where("valid").select("surface_id", "v", "u", *[F.col(k).cast("double").alias(k) for k in "xyz"]), "points")
    boxes = points.groupBy("surface_id").agg(F.count("*").alias("m"), *[f(k).alias(f"{n}_{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in "xyz"])
    met = edges.select("a", "b").distinct().join(boxes.select(F.col("surface_id").alias("b"), F.col("m").alias("mb"), *[f"{n}_{k}" for n in ("lo", "hi") for k in "xyz"]), "b")
    met = met.join(boxes.select(F.col("surface_id").alias("a"), F.col("m").alias("ma")), "a").where((F.col("ma") >= least) & (F.col("mb") >= least))
    inside = F.lit(True)
    for k in "xyz":
        inside = inside & F.col(k).between(F.col(f"lo_{k}"), F.col(f"hi_{k}"))
    of_a = points.withColumnRenamed("surface_id", "a").join(met, "a").where(inside)
    size = F.count("*")
    if most is not None:
        w = Window.partitionBy("a", "b")
        of_a = of_a.withColumn("i", F.row_number().over(w.orderBy("v", "u")).cast("long") - 1).withColumn("n_points", F.count("*").over(w))
        # Of n points the places floor(j (n - 1) / (most - 1)): i is one of them when the least j that reaches i lands on it.
        j = F.ceil(F.col("i") * (most - 1) / (F.col("n_points") - 1))
        of_a = of_a.where((F.col("n_points") <= most) | ((j < most) & (F.floor(j * (F.col("n_points") - 1) / (most - 1)) == F.col("i"))))
        size = F.max("n_points")
    asked = written(of_a.select(F.xxhash64("a", "b", "v", "u").alias("qid"), "a", "b", *"xyz", *([] if most is None else ["n_points"])), "disagreement")
    near = spatial.nearest(asked, points.withColumnRenamed("surface_id", "b").drop("v", "u"), list("xyz"), first / 4, by=("b",))
    out = near.groupBy("a", "b").agg(size.alias("n_points"), F.median("d").alias("median"), F.percentile("d", F.lit(0.9)).alias("p90"), F.avg("d").alias("mean"))
    return edges.join(out.where(F.col("n_points") >= least), ["a", "b"], "left")


def vertex_distance(vertices: DataFrame, exclude: int, first: float, block: int = 64, least: int = 8) -> DataFrame:
    """surface_id, v, u and d: distance to the nearest vertex of the same surface that lies `exclude` columns or more outside the
    query's block of `block` columns (blocks start at the surface's first column). Null where under `least` such vertices are left."""
    points = vertices.where("valid").select("surface_id", "v", "u", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    per = points.groupBy("surface_id", "u").agg(F.count("*").alias("n"))
    start = per.groupBy("surface_id").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.sum("n").alias("all"))
    blocks = start.select("surface_id", "all", F.explode(F.sequence("u0", "u1", F.lit(block))).alias("from"))
    near = blocks.join(per, "surface_id").groupBy("surface_id", "from", "all").agg(F.sum(F.when(F.col("u").between(F.col("from") - exclude, F.col("from") + block - 1 + exclude), F.col("n")).otherwise(0)).alias("beside"))
    open_ = near.where(F.col("all") - F.col("beside") >= least).select("surface_id", "from")
    asked = points.join(start.select("surface_id", "u0"), "surface_id").withColumn("from", (F.col("u0") + F.floor((F.col("u") - F.col("u0")) / block) * block).cast("int"))
    asked = asked.withColumn("qid", regions.code(F.col("surface_id"), F.col("v"), F.col("u")))
    allowed = (F.col("p_u") < F.col("from") - exclude) | (F.col("p_u") > F.col("from") + block - 1 + exclude)
    found = spatial.nearest(asked.join(open_, ["surface_id", "from"]).select("qid", "surface_id", "from", *"xyz"), points.drop("v"), list("xyz"), first, allowed, ("surface_id",), ("u",))
    return asked.join(found.select("qid", "d"), "qid", "left").select("surface_id", "v", "u", "d")


def partners(vertices: DataFrame, wanted: DataFrame, half: int = 2, first: float = 16.0) -> DataFrame:
    """wanted (surface_id, v, u, column) with the valid cell nearest in space to cell (v, u) among columns column - half .. column + half:
    near_v, near_u, d; the first in grid order on ties, null where no such cell, or cell (v, u) itself, is valid."""
    points = vertices.where("valid").select("surface_id", "v", "u", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    asked = wanted.join(points, ["surface_id", "v", "u"], "left").withColumn("qid", F.xxhash64("surface_id", "v", "u", "column"))
    once = asked.dropDuplicates(["qid"]).select("qid", "surface_id", "column", *"xyz")
    found = spatial.nearest(once, points, list("xyz"), first, F.abs(F.col("p_u") - F.col("column")) <= half, ("surface_id",), ("v", "u"))
    return asked.select("qid", *wanted.columns).join(found.select("qid", "near_v", "near_u", "d"), "qid", "left").drop("qid")
