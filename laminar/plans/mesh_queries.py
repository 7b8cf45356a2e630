"""Queries over the folded sheet: validity, quads, triangles, stencils, contacts, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.functions import geometry as G
from laminar.operators import census, mesh
from laminar.queries import query
from laminar.sources.views import folded_sheet, folded_sql

# ------------------------------------------------------------------ the same things in DuckDB's SQL

_D = "x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z"
VALID = "NOT (x = -1 AND y = -1 AND z = -1) AND isfinite(x) AND isfinite(y) AND isfinite(z)"


def _quads(by_label: bool = False) -> str:
    points = f"(SELECT surface_id, v, u, {_D} FROM ({folded_sql(by_label)}) WHERE {VALID})"
    corner = lambda p: ", ".join(f"{p}.{k} AS {p}{k}" for k in "xyz")
    joins = " ".join(f"JOIN {points} {p} ON {p}.surface_id = p00.surface_id AND {p}.v = p00.v + {dv} AND {p}.u = p00.u + {du}" for p, (dv, du) in G.CORNERS.items() if p != "p00")
    inner = f"SELECT p00.surface_id, p00.v, p00.u, {', '.join(corner(p) for p in G.CORNERS)} FROM {points} p00 {joins}"
    return f"SELECT *, max_edge <= {G.MAX_EDGE} AS retained FROM (SELECT *, {G.LONGEST_EDGE} AS max_edge FROM ({inner}))"


def _triangles(diagonal: int, by_label: bool = False) -> str:
    parts = []
    for t, corners in enumerate(G.TRIANGLES[diagonal]):
        points = ", ".join(f"{p}{a} AS {c}{a}" for c, p in zip("efg", corners) for a in "xyz")
        parts.append(f"SELECT surface_id, v, u, {t} AS t, {points} FROM q WHERE retained")
    return f"WITH q AS ({_quads(by_label)}) " + G.staged_sql(" UNION ALL ".join(parts), G.TRIANGLE)


def _contacts(diagonal: int, by_label: bool = False, across: bool | None = None) -> str:
    grid = ", ".join(f"floor(lo_{k} / {census.CELL})::INT AS g_{k}, floor(hi_{k} / {census.CELL})::INT AS e_{k}" for k in "xyz")
    spread = f"SELECT *, unnest(range(g_x, e_x + 1)) AS c_x FROM (SELECT tr.*, {grid} FROM tr)"
    for k in "yz":
        spread = f"SELECT *, unnest(range(g_{k}, e_{k} + 1)) AS c_{k} FROM ({spread})"
    columns = ["surface_id", "v", "u", "t", *census._CORNERS, *census._BOX, "nx", "ny", "nz", "nl"]
    named = ", ".join(f"{t}.{c} AS {t}_{c}" for t in "pq" for c in columns)
    owner = " AND ".join(f"p.c_{k} = greatest(p.g_{k}, q.g_{k})" for k in "xyz")
    boxes = " AND ".join(f"p.lo_{k} <= q.hi_{k} AND q.lo_{k} <= p.hi_{k}" for k in "xyz")
    order = " OR ".join(
        "(" + " AND ".join([*(f"p.{c} = q.{c}" for c in ("surface_id", "v", "u", "t")[:i]), f"p.{k} < q.{k}"]) + ")" for i, k in enumerate(("surface_id", "v", "u", "t"))
    )
    near = f"p.surface_id = q.surface_id AND abs(p.v - q.v) <= {G.EXCLUDE} AND abs(p.u - q.u) <= {G.EXCLUDE}"
    side = {None: "", True: " AND p.surface_id <> q.surface_id", False: " AND p.surface_id = q.surface_id"}[across]
    met = f"SELECT {named} FROM c p JOIN c q ON p.c_x = q.c_x AND p.c_y = q.c_y AND p.c_z = q.c_z WHERE {boxes} AND {owner} AND NOT ({near}) AND ({order}){side}"
    ctes, last = [f"tr AS MATERIALIZED ({_triangles(diagonal, by_label)})", f"c AS MATERIALIZED ({spread})", f"m0 AS MATERIALIZED ({met})"], "m0"
    for i, stage in enumerate(G.CONTACT):
        ctes.append(f"m{i + 1} AS MATERIALIZED (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in stage)} FROM {last})")
        last = f"m{i + 1}"
    ends = ", ".join(f"{t}_{c} AS {n}{i}" for i, t in ((1, "p"), (2, "q")) for n, c in (("s", "surface_id"), ("v", "v"), ("u", "u"), ("t", "t")))
    return f"SELECT {ends}, verdict, penetration::FLOAT AS penetration, angle_deg::FLOAT AS angle_deg FROM (WITH {', '.join(ctes)} SELECT * FROM {last}) WHERE verdict <> 'none'"


# ------------------------------------------------------------------ rows

def _sheet(spark: SparkSession, sf_dir: str, by_label: bool = False) -> DataFrame:
    return mesh.with_validity(folded_sheet(spark, sf_dir, by_label))


def _found(spark: SparkSession, sf_dir: str, diagonal: int = 0) -> DataFrame:
    return census.contacts(mesh.triangles(mesh.quads(_sheet(spark, sf_dir)), diagonal))


def _across(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("s1", "s2", "verdict", "penetration", "angle_deg")
    return census.contacts(mesh.triangles(mesh.quads(_sheet(spark, sf_dir, True))), across=True, only="transverse", keep=wanted)


@query("mesh_validity", f"SELECT surface_id, count(*) FILTER (WHERE ok) AS n_valid, count(*) FILTER (WHERE ok AND NOT z > 0) AS z_floor_cells FROM (SELECT *, {VALID} AS ok FROM ({folded_sql(True)})) GROUP BY surface_id")
def mesh_validity(spark, sf_dir):
    return mesh.bounding_boxes(_sheet(spark, sf_dir, True)).select("surface_id", "n_valid", "z_floor_cells")


@query("mesh_bounding_boxes", f"SELECT surface_id, {', '.join(f'{f}({k}::DOUBLE) AS {n}_{k}' for n, f in (('lo', 'min'), ('hi', 'max')) for k in 'xyz')} FROM ({folded_sql(True)}) GROUP BY surface_id")
def mesh_bounding_boxes(spark, sf_dir):
    return mesh.bounding_boxes(_sheet(spark, sf_dir, True)).drop("n_valid", "z_floor_cells")


@query("mesh_quads_retained", f"SELECT surface_id, v, u, round(max_edge, 6) AS max_edge, retained FROM ({_quads()})")
def mesh_quads_retained(spark, sf_dir):
    return mesh.quads(_sheet(spark, sf_dir)).select("surface_id", "v", "u", F.round("max_edge", 6).alias("max_edge"), "retained")


@query("mesh_quad_area", f"SELECT surface_id, v, u, round(area_d0, 6) AS area_d0, round(area_d1, 6) AS area_d1, round(area, 6) AS area FROM ({G.staged_sql(_quads(), G.QUAD_AREA)})")
def mesh_quad_area(spark, sf_dir):
    return mesh.areas(mesh.quads(_sheet(spark, sf_dir))).select("surface_id", "v", "u", *[F.round(c, 6).alias(c) for c in ("area_d0", "area_d1", "area")])


@query("mesh_quad_metrics", f"SELECT surface_id, v, u, round(twist, 6) AS twist, round(aspect, 6) AS aspect, round(planarity, 6) AS planarity FROM ({G.staged_sql(_quads(), G.QUAD_METRICS)})")
def mesh_quad_metrics(spark, sf_dir):
    return mesh.metrics(mesh.quads(_sheet(spark, sf_dir))).select("surface_id", "v", "u", *[F.round(c, 6).alias(c) for c in ("twist", "aspect", "planarity")])


def _triangle_query(d: int):
    sql = f"SELECT surface_id, v, u, t, round(nl, 6) AS nl, round(nx, 6) + 0.0 AS nx, round(lo_z, 6) AS lo_z FROM ({_triangles(d)})"

    @query(f"tri_explode_d{d}", sql)
    def run(spark, sf_dir):
        found = mesh.triangles(mesh.quads(_sheet(spark, sf_dir)), d)
        return found.select("surface_id", "v", "u", "t", F.round("nl", 6).alias("nl"), (F.round("nx", 6) + 0.0).alias("nx"), F.round("lo_z", 6).alias("lo_z"))


def _contact_query(d: int):
    ends = "s1, v1, u1, t1, s2, v2, u2, t2, verdict"

    @query(f"census_contacts_d{d}", f"SELECT {ends}, round(penetration::DOUBLE, 3) AS penetration, round(angle_deg::DOUBLE, 2) AS angle_deg FROM ({_contacts(d)})")
    def run(spark, sf_dir):
        return _found(spark, sf_dir, d).select(*ends.split(", "), F.round(F.col("penetration").cast("double"), 3).alias("penetration"), F.round(F.col("angle_deg").cast("double"), 2).alias("angle_deg"))


for _d in (0, 1):
    _triangle_query(_d)
    _contact_query(_d)

_counts = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS n_{v}" for v in census.VERDICTS)


@query("census_verdict_counts", f"SELECT {_counts}, count(*) AS n_contacts FROM ({_contacts(0)})")
def census_verdict_counts(spark, sf_dir):
    return census.verdict_counts(_found(spark, sf_dir))


_by = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}' AND d = {d}) AS {v}_d{d}" for v in census.VERDICTS for d in (0, 1))
_more = ", ".join(f"{v}_d0 + {v}_d1 AS {v}_sum, least({v}_d0, {v}_d1) AS {v}_least" for v in census.VERDICTS)


@query("census_both_diagonals", f"SELECT *, {_more}, transverse_d0 + transverse_d1 = 0 AS clean FROM (SELECT {_by} FROM (SELECT verdict, 0 AS d FROM ({_contacts(0)}) UNION ALL SELECT verdict, 1 FROM ({_contacts(1)})))")
def census_both_diagonals(spark, sf_dir):
    return census.both_diagonals(folded_sheet(spark, sf_dir))


_key = "s1, v1, u1, s2, v2, u2"


@query("census_multiset", f"SELECT {_key}, count(*) AS n FROM ({_contacts(0)}) GROUP BY {_key}")
def census_multiset(spark, sf_dir):
    return census.multiset(_found(spark, sf_dir))


@query("census_multiset_difference", f"SELECT {_key}, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, coalesce(b.n, 0) > coalesce(a.n, 0) AS grew FROM (SELECT {_key}, count(*) AS n FROM ({_contacts(0)}) GROUP BY {_key}) a FULL JOIN (SELECT {_key}, count(*) AS n FROM ({_contacts(1)}) GROUP BY {_key}) b USING ({_key}) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def census_multiset_difference(spark, sf_dir):
    return census.multiset_difference(_found(spark, sf_dir, 0), _found(spark, sf_dir, 1))


@query("pair_contacts_by_surface", f"SELECT s1 AS surface_a, s2 AS surface_b, count(*) AS n, round(quantile_cont(a, 0.5), 3) AS angle_median, round(quantile_cont(a, 0.1), 3) AS angle_p10, round(quantile_cont(a, 0.9), 3) AS angle_p90, round(avg((a < 10)::INT), 6) AS shallow_share, round(max(penetration)::DOUBLE, 3) AS deepest FROM (SELECT *, round(angle_deg::DOUBLE, 6) AS a FROM ({_contacts(0, True, True)}) WHERE verdict = 'transverse') GROUP BY ALL")
def pair_contacts_by_surface(spark, sf_dir):
    found = census.by_surface_pair(_across(spark, sf_dir))
    return found.select("surface_a", "surface_b", "n", *[F.round(c, 3).alias(c) for c in ("angle_median", "angle_p10", "angle_p90")], F.round("shallow_share", 6).alias("shallow_share"), F.round("deepest", 3).alias("deepest"))


_EDGES = "SELECT a::BIGINT AS a, b::BIGINT AS b FROM range(0, 12) t(a), range(0, 12) s(b) WHERE a <= b"
_POINTS = f"SELECT surface_id, {_D} FROM ({folded_sql(True)}) WHERE {VALID}"
_LO, _HI = (" AND ".join(f"{k} {o} {f}(x.{e}_{k}, y.{e}_{k})" for k in "xyz") for o, f, e in ((">=", "greatest", "lo"), ("<=", "least", "hi")))
_PAIRED = " UNION ALL ".join(f"SELECT s1, s2, {d} AS d FROM ({_contacts(d, True)}) WHERE verdict = 'transverse'" for d in (0, 1))
_VERDICT = f"""WITH e AS ({_EDGES}), p AS MATERIALIZED ({_POINTS}), k AS MATERIALIZED ({_PAIRED}),
x AS MATERIALIZED (SELECT surface_id, count(*) AS m, {', '.join(f'{f}({k}) AS {n}_{k}' for f, n in (('min', 'lo'), ('max', 'hi')) for k in 'xyz')} FROM p GROUP BY surface_id),
t AS (SELECT surface_id, count(*) AS n FROM ({_triangles(0, True)}) GROUP BY surface_id),
c AS (SELECT s1, s2, count(*) AS n, count(*) FILTER (WHERE d = 0) AS n_d0, count(*) FILTER (WHERE d = 1) AS n_d1 FROM k GROUP BY ALL),
o AS (SELECT e.a, e.b, count(*) AS n FROM e JOIN x ON x.surface_id = e.a JOIN x y ON y.surface_id = e.b JOIN p ON p.surface_id IN (e.a, e.b) WHERE {_LO} AND {_HI} GROUP BY ALL),
j AS (SELECT e.a, e.b, x.m AS ma, y.m AS mb, coalesce(ta.n, 0) AS na, coalesce(tb.n, 0) AS nb, coalesce(c.n, 0) AS n, coalesce(c.n_d0, 0) AS n_d0, coalesce(c.n_d1, 0) AS n_d1, coalesce(sa.n, 0) + coalesce(sb.n, 0) AS own,
  CASE WHEN e.a = e.b THEN x.m * 2 ELSE coalesce(o.n, 0) END AS overlap, x.m >= 4 AND y.m >= 4 AND {' AND '.join(f'least(x.hi_{k}, y.hi_{k}) >= greatest(x.lo_{k}, y.lo_{k})' for k in 'xyz')} AS meet
  FROM e LEFT JOIN x ON x.surface_id = e.a LEFT JOIN x y ON y.surface_id = e.b LEFT JOIN t ta ON ta.surface_id = e.a LEFT JOIN t tb ON tb.surface_id = e.b LEFT JOIN c ON c.s1 = e.a AND c.s2 = e.b
  LEFT JOIN c sa ON sa.s1 = e.a AND sa.s2 = e.a LEFT JOIN c sb ON sb.s1 = e.b AND sb.s2 = e.b LEFT JOIN o ON o.a = e.a AND o.b = e.b),
w AS (SELECT *, CASE WHEN ma IS NULL OR mb IS NULL THEN 'surface not found' WHEN a = b THEN 'one surface twice' WHEN na = 0 OR nb = 0 THEN 'surface has no triangle' WHEN NOT meet THEN 'extents do not meet' END AS why FROM j)
SELECT a, b, CASE WHEN why IS NULL THEN n_d0 ELSE 0 END AS n_d0, CASE WHEN why IS NULL THEN n_d1 ELSE 0 END AS n_d1, CASE WHEN why IS NULL THEN n ELSE 0 END AS n_transverse, coalesce(overlap, 0) AS overlap_points,
CASE WHEN why IS NOT NULL OR (n = 0 AND overlap < 8) THEN 'not_testable' WHEN n > 0 THEN 'conflict' ELSE 'no_conflict' END AS verdict,
CASE WHEN why IS NOT NULL THEN why WHEN n = 0 AND overlap < 8 THEN 'too few points in the shared extent' WHEN n = 0 AND own > 0 THEN 'a surface crosses itself, not the other' END AS reason FROM w"""


@query("pair_verdicts", _VERDICT)
def pair_verdicts(spark, sf_dir):
    ids = spark.range(12)
    edges = ids.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("b")).where("a <= b")
    sheet = _sheet(spark, sf_dir, True)
    quads = mesh.quads(sheet)
    return census.pair_verdicts(edges, sheet, census.of_both_diagonals(quads, census.pair_counts), quads)


_square = " + ".join(f"power((n.{k} + s.{k} + w.{k} + o.{k}) / 4 - a.{k}, 2)" for k in "xyz")
_beside = " ".join(f"JOIN p {t} ON {t}.v = a.v + {dv} AND {t}.u = a.u + {du}" for t, dv, du in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("o", 0, 1)))


@query("mesh_wobble", f"WITH p AS (SELECT surface_id, v, u, {_D} FROM ({folded_sql()})) SELECT a.surface_id, a.v, a.u, round(sqrt({_square}), 6) AS wobble FROM p a {_beside}")
def mesh_wobble(spark, sf_dir):
    return mesh.wobble(_sheet(spark, sf_dir)).select("surface_id", "v", "u", F.round("wobble", 6).alias("wobble"))
