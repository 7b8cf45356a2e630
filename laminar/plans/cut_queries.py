"""Cuts, taint, physical reports, nearest vertices and manifests, over the folded sheet of each label and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminar.functions import geometry as G
from laminar.operators import census, corpus, cuts, events, gaps, mesh, spectrum
from laminar.plans.graph_queries import _C, _STEPS, _code, _components, _hits
from laminar.plans.mesh_queries import _D, VALID, _contacts, _quads, _sheet
from laminar.queries import query
from laminar.scratch import written
from laminar.sources.views import folded_sql, read

_POINTS = f"SELECT surface_id, v, u, {_D} FROM ({folded_sql(True)}) WHERE {VALID}"
_PAIR = "s1, v1, u1, s2, v2, u2"


def _cross(diagonal: int) -> str:
    return f"SELECT * FROM ({_contacts(diagonal, True, False)}) WHERE verdict = 'transverse'"


@query("crossing_under_both", f"SELECT {_PAIR} FROM ({_cross(0)}) INTERSECT SELECT {_PAIR} FROM ({_cross(1)})")
def crossing_under_both(spark, sf_dir):
    return cuts.under_both(census.of_both_diagonals(mesh.quads(_sheet(spark, sf_dir, True)), across=False))


_ENDS = f"WITH h AS MATERIALIZED ({_cross(0)}) SELECT DISTINCT surface_id, v, u FROM (SELECT s1 AS surface_id, v1 AS v, u1 AS u FROM h UNION ALL SELECT s2, v2, u2 FROM h)"
_MARKED = f"SELECT q.*, retained AND e.v IS NOT NULL AS removed, retained AND e.v IS NULL AS kept FROM ({_quads(True)}) q LEFT JOIN ({_ENDS}) e USING (surface_id, v, u)"
_SIDES = " UNION ALL ".join(
    f"SELECT surface_id, v + {dv} AS ev, u + {du} AS eu, {along} AS along, {G.distance(p, q)} AS length, removed, kept FROM m"
    for p, q, dv, du, along in (("p00", "p01", 0, 0, 0), ("p10", "p11", 1, 0, 0), ("p00", "p10", 0, 0, 1), ("p01", "p11", 0, 1, 1))
)


def _marked(spark, sf_dir):
    """Quads of each label's sheet; those at either end of a transverse contact count as removed."""
    hits = _hits(spark, sf_dir)
    ends = [hits.select(F.col(f"s{i}").alias("surface_id"), F.col(f"v{i}").alias("v"), F.col(f"u{i}").alias("u")) for i in (1, 2)]
    ends = ends[0].unionByName(ends[1]).distinct().withColumn("hit", F.lit(True))
    found = mesh.quads(_sheet(spark, sf_dir, True)).join(ends, ["surface_id", "v", "u"], "left")
    return found.withColumn("removed", F.col("retained") & F.col("hit").isNotNull()).withColumn("kept", F.col("retained") & F.col("hit").isNull())


@query("cut_boundary", f"WITH m AS MATERIALIZED ({_MARKED}), e AS ({_SIDES}), g AS (SELECT surface_id, ev, eu, along, bool_or(removed) AND bool_or(kept) AS cut, min(length) AS length FROM e GROUP BY ALL) SELECT surface_id, count(*) FILTER (WHERE cut) AS n_edges, round(coalesce(sum(length) FILTER (WHERE cut), 0), 4) AS length FROM g GROUP BY surface_id")
def cut_boundary(spark, sf_dir):
    return cuts.cut_boundary(_marked(spark, sf_dir)).withColumn("length", F.round("length", 4))


_KEPT = f"SELECT {_code('surface_id', 'v', 'u')} AS node FROM ({_MARKED}) WHERE kept"
_BESIDE = f"SELECT x.node AS a, y.node AS b FROM (SELECT node, unnest([{', '.join(f'node + {s}' for s in _STEPS)}]) AS b FROM n) x JOIN n y ON y.node = x.b"


@query("retained_pieces", f"SELECT surface_id, sum(n)::BIGINT AS n_quads, count(*) AS n_pieces, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS n_single FROM (SELECT comp // (2097152::BIGINT * {_C}) AS surface_id, comp, count(*) AS n FROM ({_components(_KEPT, _BESIDE)}) GROUP BY ALL) GROUP BY surface_id")
def retained_pieces(spark, sf_dir):
    return cuts.piece_report(written(_marked(spark, sf_dir).where("kept").select("surface_id", "v", "u"), "kept-quads"))


#: Contacts' ends that a vertex must be a corner of to count as taken out, in the query of witnesses.
_CROWDED = 6
_KEY = "s1, v1, u1, t1, s2, v2, u2, t2"
_AROUND = " UNION ALL ".join(f"SELECT s{i} AS surface_id, v{i} + {dv} AS v, u{i} + {du} AS u FROM h" for i in (1, 2) for dv, du in G.CORNERS.values())
_PLACES = " UNION ALL ".join(
    f"SELECT {_KEY}, {rank} AS rank, s{end} AS surface_id, v{end} + {dv} AS v, u{end} + {du} AS u, {end} AS e, '{scope}' AS scope FROM h WHERE t{end} = {t}" for rank, (end, t, dv, du, scope) in enumerate(cuts._candidates(0))
)


@query("deletion_witnesses", f"WITH h AS MATERIALIZED ({_cross(0)}), x AS (SELECT surface_id, v, u FROM ({_AROUND}) GROUP BY ALL HAVING count(*) >= {_CROWDED}), w AS (SELECT {_KEY}, arg_min({{'v': p.v, 'u': p.u, 'e': e, 'scope': scope}}, rank) AS w FROM ({_PLACES}) p JOIN x USING (surface_id, v, u) GROUP BY ALL) SELECT {_KEY}, w.w.v AS at_v, w.w.u AS at_u, w.w.e AS \"end\", w.w.scope AS scope FROM (SELECT DISTINCT {_KEY} FROM h) LEFT JOIN w USING ({_KEY})")
def deletion_witnesses(spark, sf_dir):
    hits = written(_hits(spark, sf_dir), "hits")
    corners = [F.struct(F.col(f"s{i}").alias("surface_id"), (F.col(f"v{i}") + dv).alias("v"), (F.col(f"u{i}") + du).alias("u")) for i in (1, 2) for dv, du in G.CORNERS.values()]
    out = hits.select(F.explode(F.array(*corners)).alias("c")).groupBy("c.surface_id", "c.v", "c.u").agg(F.count("*").alias("n")).where(F.col("n") >= _CROWDED)
    return cuts.witnesses(hits, out, 0)


_UM, _CUT = 7.91, 0.1
_MM2 = f"({_UM}::DOUBLE / 1000.0) * ({_UM}::DOUBLE / 1000.0)"
_AREA = f"SELECT surface_id, v, u, area_d0 * {_MM2} AS a FROM ({G.staged_sql(_quads(True), G.QUAD_AREA)})"
_STEP = f"SELECT surface_id, median(sqrt(d)) * {_UM}::DOUBLE AS pitch_um FROM (SELECT surface_id, CASE WHEN lead(u) OVER w = u + 1 THEN {' + '.join(f'power(lead({k}) OVER w - {k}, 2)' for k in 'xyz')} END AS d FROM ({_POINTS}) WINDOW w AS (PARTITION BY surface_id, v ORDER BY u)) GROUP BY surface_id"
_FAR_LABELS = _components("SELECT DISTINCT unnest([c1, c2]) AS node FROM far", f"SELECT x.node AS a, y.node AS b FROM (SELECT node, unnest([{', '.join(f'node + {s}' for s in _STEPS)}]) AS b FROM n) x JOIN n y ON y.node = x.b")
_PHYSICAL = f"""WITH a AS MATERIALIZED ({_AREA}), p AS MATERIALIZED ({_STEP}), h AS MATERIALIZED (SELECT h.*, greatest(abs(v1 - v2), abs(u1 - u2)) * pitch_um / 1000.0 AS sep, {_code('s1', 'v1', 'u1')} AS c1, {_code('s2', 'v2', 'u2')} AS c2 FROM ({_cross(0)}) h JOIN p ON p.surface_id = s1),
far AS MATERIALIZED (SELECT * FROM h WHERE sep > {_CUT}), l AS MATERIALIZED ({_FAR_LABELS}),
f AS (SELECT s1 AS surface_id, count(DISTINCT (least(x.comp, y.comp), greatest(x.comp, y.comp))) AS n FROM far JOIN l x ON x.node = c1 JOIN l y ON y.node = c2 GROUP BY s1),
t AS (SELECT surface_id, sum(a) AS a FROM (SELECT DISTINCT surface_id, v, u FROM (SELECT s1 AS surface_id, v1 AS v, u1 AS u FROM h UNION ALL SELECT s2, v2, u2 FROM h)) JOIN a USING (surface_id, v, u) GROUP BY surface_id),
s AS (SELECT s1 AS surface_id, count(*) AS n, max(sep) AS far, quantile_cont(sep, 0.99) AS p99, median(penetration::DOUBLE) AS pen FROM h GROUP BY s1), w AS (SELECT surface_id, sum(a) AS a FROM a GROUP BY surface_id)
SELECT surface_id, round(pitch_um, 4) AS pitch_um, round(w.a, 6) AS total_area_mm2, coalesce(s.n, 0) AS pairs, round(coalesce(far, 0), 6) AS overlap_extent_mm, round(p99, 6) AS overlap_extent_p99_mm, round(coalesce(t.a, 0), 6) AS duplicated_area_mm2, round(coalesce(t.a, 0) / w.a, 5) AS duplicated_fraction, coalesce(f.n, 0) AS events_beyond_cut, round(pen, 3) AS median_penetration_vx
FROM w LEFT JOIN p USING (surface_id) LEFT JOIN s USING (surface_id) LEFT JOIN t USING (surface_id) LEFT JOIN f USING (surface_id)"""


@query("physical_report", _PHYSICAL)
def physical_report(spark, sf_dir):
    out = cuts.physical_report(_sheet(spark, sf_dir, True), written(_hits(spark, sf_dir), "hits"), _UM, _CUT)
    digits = {"pitch_um": 4, "total_area_mm2": 6, "overlap_extent_mm": 6, "overlap_extent_p99_mm": 6, "duplicated_area_mm2": 6, "duplicated_fraction": 5, "median_penetration_vx": 3}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


_LOW = " OR ".join(f"{p}z <= 0" for p in G.CORNERS)
_TAINT = f"""WITH b AS MATERIALIZED (SELECT surface_id, v - dv AS v, u - du AS u FROM ({_POINTS}), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dv, du) WHERE z <= 0 GROUP BY ALL), h AS MATERIALIZED ({_cross(0)}),
r AS (SELECT h.s1 AS surface_id, count(*) AS n, count(*) FILTER (WHERE x.v IS NOT NULL OR y.v IS NOT NULL) AS t FROM h LEFT JOIN b x ON x.surface_id = s1 AND x.v = v1 AND x.u = u1 LEFT JOIN b y ON y.surface_id = s2 AND y.v = v2 AND y.u = u2 GROUP BY h.s1),
c AS (SELECT surface_id, count(*) FILTER (WHERE {VALID} AND z <= 0) AS floor_cells FROM ({folded_sql(True)}) GROUP BY surface_id)
SELECT surface_id, floor_cells, coalesce(n, 0) AS transverse_rows, coalesce(t, 0) AS rows_touching_floor, round(coalesce(t / n, 0), 6) AS fraction, coalesce(n > 0 AND n = t, false) AS would_flip FROM c LEFT JOIN r USING (surface_id)"""


@query("floor_taint", _TAINT)
def floor_taint(spark, sf_dir):
    return cuts.floor_taint(_sheet(spark, sf_dir, True), written(_hits(spark, sf_dir), "hits")).withColumn("fraction", F.round("fraction", 6))


_LINE = f"SELECT surface_id, u, median(x) AS x, median(y) AS y, median(z) AS z FROM ({_POINTS}) GROUP BY ALL HAVING count(*) >= 3"


@query("centre_line_length", f"SELECT surface_id, u, round(coalesce(sum(d) OVER (PARTITION BY surface_id ORDER BY u), 0), 6) AS s FROM (SELECT *, sqrt({' + '.join(f'power({k} - lag({k}) OVER w, 2)' for k in 'xyz')}) AS d FROM ({_LINE}) WINDOW w AS (PARTITION BY surface_id ORDER BY u))")
def centre_line_length(spark, sf_dir):
    return cuts.arclength(_sheet(spark, sf_dir, True)).withColumn("s", F.round("s", 6))


_between = lambda p, b: " AND ".join(f"{p}.{k} BETWEEN {b}.lo_{k} AND {b}.hi_{k}" for k in "xyz")
_far = lambda p, q: "sqrt(" + " + ".join(f"({p}.{k} - {q}.{k}) * ({p}.{k} - {q}.{k})" for k in "xyz") + ")"
_DISAGREE = f"""WITH p AS MATERIALIZED ({_POINTS}), x AS MATERIALIZED (SELECT surface_id, count(*) AS m, {', '.join(f'{f}({k}) AS {n}_{k}' for f, n in (('min', 'lo'), ('max', 'hi')) for k in 'xyz')} FROM p GROUP BY surface_id),
e AS (SELECT s.surface_id AS a, t.surface_id AS b FROM x s JOIN x t ON t.surface_id = s.surface_id + 1),
i AS (SELECT e.a, e.b, p.x, p.y, p.z, row_number() OVER (PARTITION BY e.a, e.b ORDER BY v, u) - 1 AS i, count(*) OVER (PARTITION BY e.a, e.b) AS n FROM e JOIN x bx ON bx.surface_id = e.b AND bx.m >= 50 JOIN x ax ON ax.surface_id = e.a AND ax.m >= 50 JOIN p ON p.surface_id = e.a AND {_between('p', 'bx')}),
q AS MATERIALIZED (SELECT * FROM i WHERE n >= 50), d AS (SELECT q.a, q.b, q.i, any_value(q.n) AS n, min({_far('q', 'p')}) AS d FROM q JOIN p ON p.surface_id = q.b GROUP BY ALL),
o AS (SELECT a, b, max(n) AS n_points, median(d) AS median, quantile_cont(d, 0.9) AS p90, avg(d) AS mean FROM d GROUP BY ALL) SELECT a, b, n_points, round(median, 6) AS median, round(p90, 6) AS p90, round(mean, 6) AS mean FROM e LEFT JOIN o USING (a, b)"""


@query("surface_disagreement", _DISAGREE)
def surface_disagreement(spark, sf_dir):
    sheet = _sheet(spark, sf_dir, True)
    ids = sheet.select("surface_id").distinct()
    edges = ids.select(F.col("surface_id").alias("a")).join(ids.select(F.col("surface_id").alias("b")), F.col("b") == F.col("a") + 1)
    return gaps.disagreement(sheet, written(edges, "edges"), 12.0).withColumns({c: F.round(c, 6) for c in ("median", "p90", "mean")})


_BLOCK, _APART = 8, 8
_VERTEX = f"""WITH p AS MATERIALIZED (SELECT *, u0 + (u - u0) // {_BLOCK} * {_BLOCK} AS f FROM (SELECT *, min(u) OVER (PARTITION BY surface_id) AS u0 FROM ({_POINTS}))), d AS (SELECT a.surface_id, a.v, a.u, min({_far('a', 'b')}) AS d, count(*) AS n FROM p a JOIN p b ON a.surface_id = b.surface_id AND (b.u < a.f - {_APART} OR b.u > a.f + {_BLOCK} - 1 + {_APART}) GROUP BY ALL)
SELECT p.surface_id, p.v, p.u, round(CASE WHEN n >= 8 THEN d END, 6) AS d FROM p LEFT JOIN d USING (surface_id, v, u)"""


@query("vertex_distance", _VERTEX)
def vertex_distance(spark, sf_dir):
    return gaps.vertex_distance(_sheet(spark, sf_dir, True), _APART, 6.0, _BLOCK).withColumn("d", F.round("d", 6))


_PARTNERS = f"""WITH p AS MATERIALIZED ({_POINTS}) SELECT a.surface_id, a.v, a.u, 63 - a.u AS "column", arg_min(struct_pack(v := b.v, u := b.u), (({_far('a', 'b')}), b.v, b.u)).v AS near_v, arg_min(struct_pack(v := b.v, u := b.u), (({_far('a', 'b')}), b.v, b.u)).u AS near_u, round(min({_far('a', 'b')}), 6) AS d
FROM p a LEFT JOIN p b ON a.surface_id = b.surface_id AND b.u BETWEEN 63 - a.u - 2 AND 63 - a.u + 2 GROUP BY a.surface_id, a.v, a.u"""


@query("partner_cells", _PARTNERS)
def partner_cells(spark, sf_dir):
    """Of every cell, the nearest one around the column that the fold lays over it."""
    sheet = _sheet(spark, sf_dir, True)
    return gaps.partners(sheet, sheet.where("valid").select("surface_id", "v", "u", (63 - F.col("u")).alias("column"))).withColumn("d", F.round("d", 6))


_near = lambda i, j: f"abs(x.v{i} - y.v{j}) <= 1 AND abs(x.u{i} - y.u{j}) <= 1"
_TIES = f"SELECT x.node AS a, y.node AS b FROM k x JOIN k y ON x.s1 = y.s1 AND x.node <> y.node AND (({_near(1, 1)} AND {_near(2, 2)}) OR ({_near(1, 2)} AND {_near(2, 1)}))"
_PRODUCT = f"WITH k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {_PAIR}) AS node FROM (SELECT DISTINCT {_PAIR} FROM ({_cross(0)}))), c AS MATERIALIZED ({_components('SELECT node FROM k', _TIES)}) SELECT surface_id, count(*) AS n_events, sum(n)::BIGINT AS n_pairs, max(n) AS largest FROM (SELECT s1 AS surface_id, comp, count(*) AS n FROM k JOIN c USING (node) GROUP BY ALL) GROUP BY surface_id"


@query("product_space_events", _PRODUCT)
def product_space_events(spark, sf_dir):
    found = events.in_product_space(_hits(spark, sf_dir))
    sizes = found.groupBy(F.col("s1").alias("surface_id"), "event").agg(F.count("*").alias("n"))
    return sizes.groupBy("surface_id").agg(F.count("*").alias("n_events"), F.sum("n").alias("n_pairs"), F.max("n").alias("largest"))


@query("segment_spectrum")
def segment_spectrum(spark, sf_dir):
    """Of each event of each label's sheet, how far its two sides lie apart along the surface."""
    key = ["s1", "v1", "u1", "v2", "u2"]
    found = _hits(spark, sf_dir).groupBy(*key).agg(F.max("penetration").alias("penetration"))
    found = found.select(F.col("s1").alias("surface_id"), F.xxhash64(*key).alias("row"), *key[1:], "penetration")
    out = spectrum.spectrum(_sheet(spark, sf_dir, True), written(found, "contact-rows"), _UM)
    return out.withColumns({c: F.round(c, 6) for c in ("median_length", "separation_mm")})


# ------------------------------------------------------------------ manifests: an order's lines are its files, parts and shipments their digests

_FILES = "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.08 THEN l_partkey END AS digest FROM lineitem"
_OTHER = "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.08 THEN CASE WHEN l_tax > 0.07 THEN l_suppkey ELSE l_partkey END END AS digest FROM lineitem"


def _manifests(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    here = F.when(F.col("l_discount") < 0.08, F.col("l_partkey")).alias("digest")
    there = F.when(F.col("l_discount") < 0.08, F.when(F.col("l_tax") > 0.07, F.col("l_suppkey")).otherwise(F.col("l_partkey"))).alias("digest")
    return [lines.select("l_orderkey", "l_linenumber", d) for d in (here, there)]


_SET = lambda t: f"SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber || ':' || digest) FILTER (WHERE digest IS NOT NULL)) AS parts FROM ({t}) GROUP BY l_orderkey"


@query("manifest_identity", f"SELECT l_orderkey, a.parts = b.parts AS same FROM ({_SET(_FILES)}) a JOIN ({_SET(_OTHER)}) b USING (l_orderkey)")
def manifest_identity(spark, sf_dir):
    return corpus.same_identity(*_manifests(spark, sf_dir), "l_orderkey", "l_linenumber", "digest")


@query("published_agreement", f"SELECT f.l_orderkey, bool_and(coalesce(p.digest = f.digest, false)) FILTER (WHERE p.digest IS NOT NULL) AS agrees FROM ({_FILES}) p JOIN ({_OTHER}) f USING (l_orderkey, l_linenumber) GROUP BY f.l_orderkey")
def published_agreement(spark, sf_dir):
    return corpus.published_agrees(*_manifests(spark, sf_dir), "l_orderkey", "l_linenumber", "digest")


_RECORD = {"checked": "o_orderstatus <> 'P'", "status": "o_totalprice > 20000", "censused": "o_orderstatus = 'F'", "clean": "o_custkey > 100", "ok": "o_totalprice > 20000 AND (o_orderstatus <> 'F' OR o_custkey > 100)"}
_if = lambda c: f"count(*) FILTER (WHERE {c})"
_SUMMARY = f"""SELECT count(*) AS n_records, {_if(_RECORD['checked'])} AS n_checked, {_if(_RECORD['checked'] + ' AND ' + _RECORD['status'])} AS n_match, {_if(_RECORD['checked'] + ' AND NOT ' + _RECORD['status'])} AS n_mismatch,
{_if(_RECORD['censused'])} AS n_censused, {_if(_RECORD['censused'] + ' AND ' + _RECORD['clean'])} AS n_clean, {_if(_RECORD['censused'] + ' AND NOT ' + _RECORD['clean'])} AS n_not_clean, {_if(_RECORD['ok'])} AS n_ok, {_if('NOT (' + _RECORD['ok'] + ')')} AS n_failed,
(SELECT string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority) FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) AS states FROM orders"""


@query("verification_summary", _SUMMARY)
def verification_summary(spark, sf_dir):
    c = {k: F.expr(v) for k, v in _RECORD.items()}
    return corpus.verification(read(spark, sf_dir, "orders"), "o_orderpriority", c["checked"], c["status"], c["censused"], c["clean"], c["ok"])


@query("verification_failures", f"SELECT o_orderkey, CASE WHEN NOT {_RECORD['status']} THEN 'digest differs' WHEN NOT {_RECORD['clean']} THEN 'not clean' ELSE 'refused' END AS problem FROM orders WHERE NOT ({_RECORD['ok']})")
def verification_failures(spark, sf_dir):
    return corpus.verification_failures(read(spark, sf_dir, "orders"), "o_orderkey", *[F.expr(_RECORD[k]) for k in ("status", "clean", "ok")])
