"""What contacts form: regions of touching quads, events between regions, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.operators.components import components
from laminar.scratch import written

#: A grid cell as one number: 2**20 columns, 2**21 rows, then the surface.
COLUMNS, ROWS = 1 << 20, 1 << 21


def code(surface, v, u):
    return (surface.cast("long") * ROWS + v) * COLUMNS + u


def decoded(c):
    return F.floor(c / (ROWS * COLUMNS)).cast("long"), (F.floor(c / COLUMNS) % ROWS).cast("int"), (c % COLUMNS).cast("int")


def cells_of(contacts: DataFrame) -> DataFrame:
    """Quads at either end of a contact."""
    ends = F.array(*[code(F.col(f"s{i}"), F.col(f"v{i}"), F.col(f"u{i}")) for i in (1, 2)])
    return contacts.select(F.explode(ends).alias("cell")).distinct()


def labelled(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """cell, region: connected by sides, and by corners with `diagonal`; a region is named by its least cell.

    Neighbours meet in an equi-join on the cell's number; components settle in rounds over all surfaces at once."""
    steps = [1, COLUMNS, *([COLUMNS - 1, COLUMNS + 1] if diagonal else [])]
    right = cells.select("cell", F.explode(F.array(*[F.lit(s) for s in steps])).alias("s")).select("cell", (F.col("cell") + F.col("s")).alias("b"))
    edges = right.join(cells.select(F.col("cell").alias("b")), "b")
    found = components(edges.select(F.col("cell").alias("a"), "b"), "a", "b")
    return cells.join(found, F.col("cell") == F.col("node"), "left").select("cell", F.coalesce("component", "cell").alias("region"))


def regions(contacts: DataFrame) -> DataFrame:
    s, v, u = decoded(F.col("cell"))
    rs, rv, ru = decoded(F.col("region"))
    return labelled(cells_of(contacts)).select(s.alias("surface_id"), v.alias("v"), u.alias("u"), rv.alias("region_v"), ru.alias("region_u"))


def with_regions(contacts: DataFrame) -> DataFrame:
    """Contacts with the region of either end."""
    contacts = written(contacts, "contacts")  # else the census runs again for every end
    found = written(labelled(cells_of(contacts)), "regions")
    out = contacts
    for i in (1, 2):
        side = found.select(F.col("cell").alias(f"_c{i}"), F.col("region").alias(f"region{i}"))
        out = out.join(side, code(F.col(f"s{i}"), F.col(f"v{i}"), F.col(f"u{i}")) == F.col(f"_c{i}")).drop(f"_c{i}")
    return out


def events(contacts: DataFrame) -> DataFrame:
    """Unordered pairs of regions that contacts tie; a region may pair with itself."""
    out = with_regions(contacts).withColumn("region_a", F.least("region1", "region2")).withColumn("region_b", F.greatest("region1", "region2"))
    separation = F.greatest(F.abs(F.col("v1") - F.col("v2")), F.abs(F.col("u1") - F.col("u2")))
    return out.groupBy("region_a", "region_b").agg(F.count("*").alias("n_contacts"), F.max("penetration").cast("double").alias("deepest"), F.max(separation).alias("separation"))


def sites(contacts: DataFrame) -> DataFrame:
    """The deepest contact of each event, first in order on ties, and the middle of its two quads."""
    out = with_regions(contacts).withColumn("region_a", F.least("region1", "region2")).withColumn("region_b", F.greatest("region1", "region2"))
    # A minimum, taken map-side: an event may have most of the contacts.
    order = [(-F.col("penetration")).alias("depth"), *"v1 u1 t1 v2 u2 t2 s1 s2".split()]
    best = out.groupBy("region_a", "region_b").agg(F.min(F.struct(*order)).alias("best")).select("region_a", "region_b", "best.*")
    return best.select("region_a", "region_b", "v1", "u1", "v2", "u2", ((F.col("v1") + F.col("v2")) / 2).alias("at_v"), ((F.col("u1") + F.col("u2")) / 2).alias("at_u"))


#: Grid separations at which survival is counted.
SEPARATIONS = (2, 5, 10, 20, 50, 100, 200, 500, 1000)


def summary(contacts: DataFrame) -> DataFrame:
    """One row: contacts, separations, how many survive each threshold, depths and angles."""
    sep = F.greatest(F.abs(F.col("v1") - F.col("v2")), F.abs(F.col("u1") - F.col("u2")))
    rows = contacts.withColumn("sep", sep)
    counts = [F.count_if(F.col("sep") > t).alias(f"n_over_{t}") for t in SEPARATIONS]
    depth = F.round(F.col("penetration").cast("double"), 4)
    return rows.agg(F.count("*").alias("n_pairs"), F.max("sep").alias("sep_max"), F.median("sep").alias("sep_median"), *counts, F.round(F.median(depth), 3).alias("depth_median"), F.min(depth).alias("depth_min"))
