"""Regions, events, surface graphs and excision over the folded sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminar.functions.geometry import distance
from laminar.operators import census, events, excise, gaps, graph, mesh, regions
from laminar.plans.mesh_queries import _contacts, _found, _quads, _sheet
from laminar.queries import query
from laminar.scratch import written

_C, _R = regions.COLUMNS, regions.ROWS


def _code(s, v, u):
    return f"(({s}::BIGINT * {_R} + {v}) * {_C} + {u})"


def _components(nodes: str, edges: str) -> str:
    """node, comp (least node reachable), by falling labels until none changes. edges: a, b both ways."""
    return f"""WITH RECURSIVE n AS MATERIALIZED ({nodes}), e AS MATERIALIZED ({edges}), t(node, comp) USING KEY (node) AS (SELECT node, node FROM n UNION
      SELECT e.b, min(t.comp) FROM t JOIN e ON e.a = t.node JOIN recurring.t x ON x.node = e.b WHERE t.comp < x.comp GROUP BY e.b) SELECT node, comp FROM t"""


_HITS = f"SELECT * FROM ({_contacts(0, True, False)}) WHERE verdict = 'transverse'"
_K = f"SELECT *, {_code('s1', 'v1', 'u1')} AS c1, {_code('s2', 'v2', 'u2')} AS c2 FROM ({_HITS})"
_CELLS = f"SELECT DISTINCT unnest([c1, c2]) AS node FROM ({_K})"
_STEPS = [s * k for s in (1, -1) for k in (1, _C, _C - 1, _C + 1)]
_NEAR = f"SELECT n.node AS a, m.node AS b FROM (SELECT node, unnest([{', '.join(f'node + {s}' for s in _STEPS)}]) AS b FROM ({_CELLS})) n JOIN ({_CELLS}) m ON m.node = n.b"
_LABELS = _components(_CELLS, _NEAR)


def _hits(spark, sf_dir, diagonal: int = 0):
    """Transverse contacts of each label's sheet with itself: what regions and events are made of."""
    return census.contacts(mesh.triangles(mesh.quads(_sheet(spark, sf_dir, True)), diagonal), across=False, only="transverse")


def _cell(c, names):
    s, v, u = names
    return f"{c} // ({_R}::BIGINT * {_C}) AS {s}, (({c} // {_C}) % {_R})::INT AS {v}, ({c} % {_C})::INT AS {u}"


@query("regions_components", f"SELECT {_cell('node', ('surface_id', 'v', 'u'))}, ((comp // {_C}) % {_R})::INT AS region_v, (comp % {_C})::INT AS region_u FROM ({_LABELS})")
def regions_components(spark, sf_dir):
    return regions.regions(_hits(spark, sf_dir))


_EVENTS = f"WITH k AS ({_K}), l AS ({_LABELS}) SELECT k.*, least(a.comp, b.comp) AS region_a, greatest(a.comp, b.comp) AS region_b, greatest(abs(v1 - v2), abs(u1 - u2)) AS sep FROM k JOIN l a ON a.node = c1 JOIN l b ON b.node = c2"


@query("crossing_events", f"SELECT region_a, region_b, count(*) AS n_contacts, round(max(penetration)::DOUBLE, 3) AS deepest, max(sep) AS separation FROM ({_EVENTS}) GROUP BY ALL")
def crossing_events(spark, sf_dir):
    return regions.events(_hits(spark, sf_dir)).withColumn("deepest", F.round("deepest", 3))


_ORDER = "penetration DESC, v1, u1, t1, v2, u2, t2, s1, s2"


@query("crossing_sites", f"SELECT region_a, region_b, v1, u1, v2, u2, (v1 + v2) / 2 AS at_v, (u1 + u2) / 2 AS at_u FROM (SELECT *, row_number() OVER (PARTITION BY region_a, region_b ORDER BY {_ORDER}) AS r FROM ({_EVENTS})) WHERE r = 1")
def crossing_sites(spark, sf_dir):
    return regions.sites(_hits(spark, sf_dir))


_over = ", ".join(f"count(*) FILTER (WHERE sep > {t}) AS n_over_{t}" for t in regions.SEPARATIONS)


@query("event_summary", f"SELECT count(*) AS n_pairs, max(sep) AS sep_max, median(sep)::DOUBLE AS sep_median, {_over}, round(median(d), 3) AS depth_median, min(d) AS depth_min FROM (SELECT greatest(abs(v1 - v2), abs(u1 - u2)) AS sep, round(penetration::DOUBLE, 4) AS d FROM ({_HITS}))")
def event_summary(spark, sf_dir):
    return regions.summary(_hits(spark, sf_dir))


def _edges(diagonal: int) -> str:
    pairs = [("p00", "p01", 0, 0, 0, 1), ("p10", "p11", 1, 0, 1, 1), ("p00", "p10", 0, 0, 1, 0), ("p01", "p11", 0, 1, 1, 1), *([("p00", "p11", 0, 0, 1, 1)] if diagonal == 0 else [])]
    parts = [f"SELECT surface_id, {_code('surface_id', f'v + {v1}', f'u + {u1}')} AS a, {_code('surface_id', f'v + {v2}', f'u + {u2}')} AS b, {distance(p, q)} AS w FROM q WHERE retained" for p, q, v1, u1, v2, u2 in pairs]
    return f"WITH q AS ({_quads()}) SELECT surface_id, a, b, min(w) AS w FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@query("surface_graph_edges", f"SELECT surface_id, a, b, round(w, 6) AS w FROM ({_edges(0)})")
def surface_graph_edges(spark, sf_dir):
    return graph.edges(mesh.quads(_sheet(spark, sf_dir)), 0).withColumn("w", F.round("w", 6))


@query("surface_graph_components")
def surface_graph_components(spark, sf_dir):
    return graph.graph_components(graph.edges(mesh.quads(_sheet(spark, sf_dir)), -1))


@query("surface_distance_field")
def surface_distance_field(spark, sf_dir):
    """Distance along the surface from its first cell."""
    found = graph.edges(mesh.quads(_sheet(spark, sf_dir)), 0)
    sources = found.groupBy("surface_id").agg(F.min("a").alias("cell"))
    return graph.distance_field(found, sources).withColumn("distance", F.round("distance", 6))


_HIT = f"SELECT DISTINCT s1, v1, u1, s2, v2, u2 FROM ({_contacts(0)}) WHERE verdict = 'transverse'"
_corners = ", ".join(_code(f"s{i}", f"v{i} + {dv}", f"u{i} + {du}") for i in (1, 2) for dv in (0, 1) for du in (0, 1))
_SETS = f"SELECT list_sort(list_distinct([{_corners}])) AS coverage FROM ({_HIT})"
_text = lambda c: f"array_to_string({c}, ',')"


@query("excise_constraints", f"SELECT {_text('coverage')} AS coverage, count(*) AS n FROM ({_SETS}) GROUP BY coverage")
def excise_constraints(spark, sf_dir):
    found = excise.constraints(_found(spark, sf_dir)).groupBy("coverage").agg(F.count("*").alias("n"))
    return found.select(F.array_join(F.transform("coverage", lambda x: x.cast("string")), ",").alias("coverage"), "n")


@query("excise_reduced", f"WITH s AS (SELECT coverage, count(*) AS n FROM ({_SETS}) GROUP BY coverage), f AS (SELECT coverage, unnest(coverage) AS x FROM s), d AS (SELECT DISTINCT b FROM (SELECT p.coverage AS a, q.coverage AS b, count(*) AS m FROM f p JOIN f q ON p.x = q.x AND len(p.coverage) < len(q.coverage) GROUP BY ALL) WHERE m = len(a)) SELECT {_text('coverage')} AS coverage, n FROM s WHERE coverage NOT IN (SELECT b FROM d)")
def excise_reduced(spark, sf_dir):
    found = excise.reduced(excise.constraints(_found(spark, sf_dir)))
    return found.select(F.array_join(F.transform("coverage", lambda x: x.cast("string")), ",").alias("coverage"), "n")


@query("excise_cover")
def excise_cover(spark, sf_dir):
    """Vertices whose removal covers all contacts of one diagonal, per independent component."""
    found = mesh.quads(_sheet(spark, sf_dir))
    sets = excise.independent(excise.reduced(excise.constraints(_found(spark, sf_dir))))
    return excise.solve(sets, mesh.areas(found).where("retained").select("surface_id", "v", "u", "area"))


@query("excise_certificate")
def excise_certificate(spark, sf_dir):
    """Each label's sheet cut free of its own crossings: census, cover, removal and recensus until clean, then areas before and after."""
    whole = _sheet(spark, sf_dir, True)
    now, removed, state = excise.excise(whole, across=False)
    lost = removed.distinct().select(regions.decoded(F.col("vertex"))[0].alias("surface_id")).groupBy("surface_id").agg(F.count("*").alias("n_removed"))
    found = excise.certificate(whole, now).join(lost, "surface_id", "left")
    return found.select("surface_id", F.lit(state).alias("state"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "quads_before", "quads_after", *[F.round(c, 4).alias(c) for c in ("area_before", "area_after", "retained_fraction")], "within_budget", "clean_by_emptiness")


def _rows(spark, sf_dir, diagonal: int):
    found = _hits(spark, sf_dir, diagonal).select("s1", "v1", "u1", "v2", "u2").distinct()
    found = found.select(F.col("s1").alias("surface_id"), F.xxhash64("s1", "v1", "u1", "v2", "u2").alias("row"), "v1", "u1", "v2", "u2")
    return written(found, "contact-rows")


@query("oriented_events")
def oriented_events(spark, sf_dir):
    return events.oriented(_rows(spark, sf_dir, 0))


@query("events_matched_across_diagonals")
def events_matched(spark, sf_dir):
    cells = []
    for d in (0, 1):
        rows = _rows(spark, sf_dir, d)
        cells.append(written(events.sides(rows, events.oriented(rows)), "event-sides"))
    return events.matched(*cells)


@query("nearest_sheets")
def nearest_sheets(spark, sf_dir):
    """Of every cell, the nearest parts of the same sheet at least eight columns away."""
    found = mesh.triangles(mesh.quads(_sheet(spark, sf_dir)), 0).withColumn("tag", F.col("u"))
    cells = _sheet(spark, sf_dir).where("valid")
    queries = cells.select(regions.code(F.col("surface_id"), F.col("v"), F.col("u")).alias("qid"), "x", "y", "z", F.col("u").alias("grp"))
    return gaps.nearest_sheets(queries, found, 16.0, 8)
