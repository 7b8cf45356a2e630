"""Contacts between triangles: the spatial join, its verdicts, and what is counted from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laminar.functions import geometry as G
from laminar.functions import kernels
from laminar.operators import mesh
from laminar.scratch import written

CELL = 12.0
_CORNERS = [f"{c}{k}" for c in "efg" for k in "xyz"]
_BOX = [f"{e}_{k}" for e in ("lo", "hi") for k in "xyz"]
#: Ends of a contact, in total order.
KEY = ["v1", "u1", "t1", "v2", "u2", "t2", "s1", "s2"]


#: Cells along each axis of the blocks that triangles are dealt by, and how far blocks are shifted, so that the origin is inside of one.
SIDE, SHIFT = 4, 2


def _judged(triangles: DataFrame, cell: float, exclude: int, touch: float, across: bool | None, by: tuple, tell, schema: str) -> DataFrame:
    """Rows that `tell` makes of each block's contacts: (values of `by`, ids of its triangles, i, j, verdict, penetration, angle).

    Triangles are dealt by blocks of cells, once for each block that their box meets, and meet in the cells of their block on Arrow batches:
    candidate pairs, far more than triangles, are never rows of Spark. A pair of boxes that meet is found in the one cell that owns it, that of
    the larger of the two low corners, without neighbours on the same surface. across: pairs of different surfaces only, or of the same only;
    by: columns that must be equal, such as a diagonal. Within surfaces only, blocks hold one surface each."""
    if across is False and "surface_id" not in by:
        by = (*by, "surface_id")
    ids = [c for c in ("surface_id", "v", "u", "t") if c not in by]
    dealt = triangles.select(*by, *ids, *_CORNERS)
    for k in "xyz":
        ends = [F.floor((F.floor(f(*[F.col(f"{c}{k}") for c in "efg"]) / cell) + SHIFT) / SIDE).cast("int") for f in (F.least, F.greatest)]
        dealt = dealt.withColumn(f"b_{k}", F.explode(F.sequence(*ends)))
    keys = [*by, "b_x", "b_y", "b_z"]

    def block(key, parts):
        whole = pa.Table.from_batches(parts)
        place = [np.full(whole.num_rows, key[by.index(c)]) if c in by else whole.column(c).to_numpy() for c in ("surface_id", "v", "u", "t")]
        order = np.lexsort(place[::-1])
        place = [x[order] for x in place]
        t = np.stack([whole.column(c).to_numpy() for c in _CORNERS], 1)[order].reshape(-1, 3, 3)
        low, high = t.min(1), t.max(1)
        g, last = (np.floor(x / cell).astype(np.int64) for x in (low, high))
        origin = np.array(key[len(by) :], np.int64) * SIDE - SHIFT
        who, at = np.arange(len(t)), np.zeros((len(t), 0), np.int64)
        for a in range(3):
            begin = np.maximum(g[who, a], origin[a])
            n = np.minimum(last[who, a], origin[a] + SIDE - 1) - begin + 1
            here = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, at = np.repeat(who, n), np.c_[np.repeat(at, n, 0), here]
        number = ((at - origin) * np.array([SIDE * SIDE, SIDE, 1])).sum(1)
        sort = np.argsort(number, kind="stable")
        who, at = who[sort], at[sort]
        found, size = [], 0
        for pair in kernels.meeting(t, number[sort], at == g[who], who, place[:3], touch, exclude, across):
            found.append(pair)
            size += len(pair[0])
            if size > 30_000:
                yield key, place, *_hits(t, found, touch)
                found, size = [], 0
        if size:
            yield key, place, *_hits(t, found, touch)

    def judge(batches):
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], 0)])
            for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
                now = tuple(c[begin].item() for c in columns)
                if now != key and parts:
                    yield from (tell(*x) for x in block(key, parts))
                    parts = []
                key = now
                parts.append(batch.slice(begin, end - begin))
        if parts:
            yield from (tell(*x) for x in block(key, parts))

    # A set number: by bytes alone, AQE would join blocks into fewer tasks than there are cores, and pairs grow faster than triangles.
    spark = triangles.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(judge, schema)


def _hits(t: np.ndarray, found: list, touch: float):
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    verdict, pen, angle = kernels.contact_among(t, i, j, touch)
    hit = np.flatnonzero(verdict)
    return i[hit], j[hit], verdict[hit], pen[hit].astype(np.float32), angle[hit].astype(np.float32)


def contacts(triangles: DataFrame, cell: float = CELL, exclude: int = G.EXCLUDE, touch: float = G.TOUCH, across: bool | None = None, by: tuple = (), only: str | None = None, keep: tuple | None = None) -> DataFrame:
    """Contacts with verdict, penetration and angle, ends in order of (surface, v, u, triangle), after the columns `by`.

    only: contacts of one verdict. keep: the columns wanted, all where not given; others never leave the test."""
    kinds = dict(triangles.dtypes)
    types = {**{c: kinds[c] for c in by}, **{f"{n}{i}": "long" if n == "s" else "int" for i in (1, 2) for n in "svut"}, "verdict": "string", "penetration": "float", "angle_deg": "float"}
    names, code = list(keep or types), kernels.NAMES.tolist().index(only) if only else None

    def tell(key, place, i, j, verdict, pen, angle):
        if code is not None:
            fits = verdict == code
            i, j, verdict, pen, angle = (x[fits] for x in (i, j, verdict, pen, angle))
        values = {c: lambda c=c: np.full(len(i), key[by.index(c)]) for c in by}
        for k, ends in ((1, i), (2, j)):
            values |= {f"{n}{k}": lambda x=x, ends=ends: x[ends] for n, x in zip("svut", place)}
        values |= {"verdict": lambda: pa.array(kernels.NAMES.tolist()).take(pa.array(verdict)), "penetration": lambda: pen, "angle_deg": lambda: angle}
        kind = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "float": pa.float32(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([x if isinstance(x := values[c](), pa.Array) else pa.array(x, kind.get(types[c])) for c in names], names=names)

    return _judged(triangles, cell, exclude, touch, across, by, tell, ", ".join(f"{c} {types[c]}" for c in names))


def pair_counts(triangles: DataFrame, cell: float = CELL, exclude: int = G.EXCLUDE, touch: float = G.TOUCH, across: bool | None = None, by: tuple = ()) -> DataFrame:
    """Transverse contacts of each unordered pair of surfaces, counted a block: by, s1, s2, n; a pair has many rows."""
    kinds = dict(triangles.dtypes)

    def tell(key, place, i, j, verdict, pen, angle):
        fits = verdict == kernels.TRANSVERSE
        ends, n = np.unique(np.c_[place[0][i[fits]], place[0][j[fits]]].reshape(-1, 2), axis=0, return_counts=True)
        head = [pa.array([key[k]] * len(n), {"int": pa.int32(), "bigint": pa.int64()}.get(kinds[c])) for k, c in enumerate(by)]
        return pa.RecordBatch.from_arrays([*head, pa.array(ends[:, 0], pa.int64()), pa.array(ends[:, 1], pa.int64()), pa.array(n, pa.int64())], names=[*by, "s1", "s2", "n"])

    return _judged(triangles, cell, exclude, touch, across, by, tell, ", ".join([*(f"{c} {kinds[c]}" for c in by), "s1 long, s2 long, n long"]))


def of_both_diagonals(quads: DataFrame, found=contacts, **how) -> DataFrame:
    """Contacts under either diagonal, in a column of that name, from one pass; found: `contacts`, or `pair_counts` for numbers only."""
    both = [mesh.triangles(quads, d).withColumn("diagonal", F.lit(d)) for d in (0, 1)]
    return found(both[0].unionByName(both[1]), by=("diagonal",), **how)


VERDICTS = ("transverse", "coplanar", "grazing")


def verdict_counts(found: DataFrame) -> DataFrame:
    """One row, also for no contact at all."""
    return found.agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS], F.count("*").alias("n_contacts"))


def both_diagonals(vertices: DataFrame, **how) -> DataFrame:
    """Counts under either diagonal, their sum and lesser, and whether all is clean."""
    found = of_both_diagonals(mesh.quads(mesh.with_validity(vertices)), **how)
    out = found.agg(*[F.count_if((F.col("verdict") == v) & (F.col("diagonal") == d)).alias(f"{v}_d{d}") for v in VERDICTS for d in (0, 1)])
    for v in VERDICTS:
        out = out.withColumn(f"{v}_sum", F.col(f"{v}_d0") + F.col(f"{v}_d1")).withColumn(f"{v}_least", F.least(f"{v}_d0", f"{v}_d1"))
    return out.withColumn("clean", F.col("transverse_sum") == 0)


def multiset(found: DataFrame) -> DataFrame:
    return found.groupBy("s1", "v1", "u1", "s2", "v2", "u2").agg(F.count("*").alias("n"))


def multiset_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose count differs: before, after, and whether it grew."""
    key = ["s1", "v1", "u1", "s2", "v2", "u2"]
    a, b = multiset(before).withColumnRenamed("n", "n_before"), multiset(after).withColumnRenamed("n", "n_after")
    out = a.join(b, key, "full_outer").na.fill(0, ["n_before", "n_after"])
    return out.where("n_before <> n_after").withColumn("grew", F.col("n_after") > F.col("n_before"))


def is_submultiset(after: DataFrame, before: DataFrame) -> bool:
    key = ["s1", "v1", "u1", "s2", "v2", "u2"]
    return after.select(*key).exceptAll(before.select(*key)).isEmpty()


#: Parts of a degree in which angles are counted, so that only those around a percentile are sorted.
_PARTS = 100


def by_surface_pair(found: DataFrame) -> DataFrame:
    """Transverse contacts of each unordered pair of surfaces: number, by diagonal where there is such a column, angles, share under
    10 degrees, deepest.

    Percentiles are exact: contacts are counted by hundredths of a degree, and those in the hundredths that hold a wanted place are
    numbered. No group's angles are gathered."""
    pair = ["surface_a", "surface_b"]
    kept = [c for c in ("diagonal", "angle_deg", "penetration") if c in found.columns]
    hits = written(found.where("verdict = 'transverse'").select(F.least("s1", "s2").alias("surface_a"), F.greatest("s1", "s2").alias("surface_b"), *kept), "pair-hits")
    angle = F.col("angle_deg").cast("double")
    hits = hits.withColumn("part", F.floor(angle * _PARTS))
    split = [F.count_if(F.col("diagonal") == d).alias(f"n_d{d}") for d in (0, 1)] if "diagonal" in kept else []
    shallow = F.when(F.abs(angle - 10) < 1e-5, F.round(angle, 6) < 10).otherwise(angle < 10)
    parts = written(hits.groupBy(*pair, "part").agg(F.count("*").alias("n"), *[s.alias(f"n_d{d}") for d, s in enumerate(split)], F.count_if(shallow).alias("shallow"), F.max("penetration").cast("double").alias("deepest")), "pair-parts")
    whole = parts.groupBy(*pair).agg(F.sum("n").alias("n"), *[F.sum(f"n_d{d}").alias(f"n_d{d}") for d in range(len(split))], (F.sum("shallow") / F.sum("n")).alias("shallow_share"), F.max("deepest").alias("deepest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*pair).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = {"angle_median": 0.5, "angle_p10": 0.1, "angle_p90": 0.9}
    at = {name: (F.col("whole") - 1) * q for name, q in shares.items()}
    spans = parts.select(*pair, "part", "n", before.alias("before")).join(whole.select(*pair, F.col("n").alias("whole")), pair)
    holds = F.lit(False)
    for place in at.values():
        for end in (F.floor(place), F.ceil(place)):
            holds = holds | ((end >= F.col("before")) & (end < F.col("before") + F.col("n")))
    near = hits.join(F.broadcast(spans.where(holds).select(*pair, "part", "before", "whole")), [*pair, "part"])
    numbered = near.withColumn("r", F.row_number().over(Window.partitionBy(*pair, "part").orderBy("angle_deg")) - 1 + F.col("before")).withColumn("a", F.round(angle, 6))
    value = lambda end: F.max(F.when(F.col("r") == end, F.col("a")))
    lines = [(value(F.floor(p)) + (value(F.ceil(p)) - value(F.floor(p))) * F.max(p - F.floor(p))).alias(name) for name, p in at.items()]
    return whole.join(numbered.groupBy(*pair).agg(*lines), pair).select(*pair, "n", *[f"n_d{d}" for d in range(len(split))], *shares, "shallow_share", "deepest")


#: Points that a surface needs, and points in the shared box from which the absence of contact is decided.
LEAST_POINTS, LEAST_OVERLAP = 4, 8


def extents(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges (a, b) with whether the boxes of both surfaces' valid points meet, and how many points of either lie in the shared box.

    Boxes are one row a surface; points meet only the edges of their own surface whose boxes meet."""
    points = vertices.where("valid").select("surface_id", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    boxes = points.groupBy("surface_id").agg(F.count("*").alias("m"), *[f(k).alias(f"{n}_{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in "xyz"])
    side = lambda e: boxes.select(F.col("surface_id").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in boxes.columns[1:]])
    met = edges.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where((F.col("a_m") >= LEAST_POINTS) & (F.col("b_m") >= LEAST_POINTS))
    for k in "xyz":
        met = met.withColumn(f"lo_{k}", F.greatest(f"a_lo_{k}", f"b_lo_{k}")).withColumn(f"hi_{k}", F.least(f"a_hi_{k}", f"b_hi_{k}")).where(F.col(f"hi_{k}") >= F.col(f"lo_{k}"))
    met = met.select("a", "b", *_BOX)
    ends = met.withColumn("surface_id", F.explode(F.array("a", "b")))
    inside = F.lit(True)
    for k in "xyz":
        inside = inside & F.col(k).between(F.col(f"lo_{k}"), F.col(f"hi_{k}"))
    counts = points.join(ends, "surface_id").where(inside).groupBy("a", "b").agg(F.count("*").alias("overlap_points"))
    found = met.select("a", "b", F.lit(True).alias("meet")).join(counts, ["a", "b"], "left")
    return edges.join(found, ["a", "b"], "left").withColumn("meet", F.coalesce("meet", F.lit(False))).withColumn("overlap_points", F.coalesce("overlap_points", F.lit(0).cast("long")))


def pair_verdicts(edges: DataFrame, vertices: DataFrame, found: DataFrame, quads: DataFrame) -> DataFrame:
    """Every candidate edge (a, b) in its order with n_d0, n_d1, their sum, points in the shared box, and a verdict: conflict,
    no_conflict, or not_testable with a reason.

    found: contacts of both diagonals, or their `pair_counts`, within surfaces too, which make a reason of a clean pair, not a verdict. A surface that is missing, has no
    triangle, is the same as the other or nowhere near it cannot be tested; a contact outranks too small an overlap. No edge is lost."""
    ones = found if "n" in found.columns else found.where("verdict = 'transverse'").withColumn("n", F.lit(1))
    split = [F.coalesce(F.sum(F.when(F.col("diagonal") == d, F.col("n"))), F.lit(0)).alias(f"n_d{d}") for d in (0, 1)]
    stats = written(ones.groupBy(F.least("s1", "s2").alias("surface_a"), F.greatest("s1", "s2").alias("surface_b")).agg(F.sum("n").alias("n"), *split), "pair-stats")
    named = lambda s: stats.select(F.col("surface_a").alias("_sa"), F.col("surface_b").alias("_sb"), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "n_d0", "n_d1")])
    sizes = quads.groupBy("surface_id").agg((2 * F.count_if("retained")).alias("n"))
    known = vertices.select("surface_id").distinct().join(sizes, "surface_id", "left").select("surface_id", F.coalesce("n", F.lit(0)).alias("n"))
    out = extents(edges, vertices)
    for e in "ab":
        out = out.join(known.select(F.col("surface_id").alias(e), F.col("n").alias(f"_n_{e}")), e, "left")
        alone = stats.where("surface_a = surface_b").select(F.col("surface_a").alias(e), F.col("n").alias(f"_self_{e}"))
        out = out.join(alone, e, "left")
    out = out.join(named("pair"), (F.least("a", "b") == F.col("_sa")) & (F.greatest("a", "b") == F.col("_sb")), "left")
    n = F.coalesce("pair_n", F.lit(0))
    missing = F.col("_n_a").isNull() | F.col("_n_b").isNull()
    rules = [(missing, "surface not found"), (F.col("a") == F.col("b"), "one surface twice"), ((F.col("_n_a") == 0) | (F.col("_n_b") == 0), "surface has no triangle"), (~F.col("meet"), "extents do not meet")]
    untestable = F.lit(None).cast("string")
    for when, why in reversed(rules):
        untestable = F.when(when, why).otherwise(untestable)
    sparse = (n == 0) & (F.col("overlap_points") < LEAST_OVERLAP)
    own = (n == 0) & ((F.coalesce("_self_a", F.lit(0)) > 0) | (F.coalesce("_self_b", F.lit(0)) > 0))
    out = out.withColumn("_why", untestable)
    tested = F.col("_why").isNull()
    verdict = F.when(~tested | sparse, "not_testable").when(n > 0, "conflict").otherwise("no_conflict")
    reason = F.when(~tested, F.col("_why")).when(sparse, "too few points in the shared extent").when(own, "a surface crosses itself, not the other")
    counts = [F.when(tested, F.coalesce(f"pair_{c}", F.lit(0))).otherwise(F.lit(0)).alias(f"{c}") for c in ("n_d0", "n_d1")]
    total = F.when(tested, n).otherwise(F.lit(0)).alias("n_transverse")
    return out.select(*edges.columns, *counts, total, "overlap_points", verdict.alias("verdict"), reason.alias("reason"))


def deepest_sites(found: DataFrame, events: DataFrame) -> DataFrame:
    """Of each event the deepest contact, first in order on ties, and the middle of its two quads."""
    first = Window.partitionBy("event_id").orderBy(F.desc("penetration"), *KEY)
    best = found.join(events, ["s1", "v1", "u1", "t1", "s2", "v2", "u2", "t2"]).withColumn("k", F.row_number().over(first)).where("k = 1")
    return best.select("event_id", *KEY, "penetration", ((F.col("v1") + F.col("v2")) / 2).alias("at_v"), ((F.col("u1") + F.col("u2")) / 2).alias("at_u"))
