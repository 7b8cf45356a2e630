"""Scalar geometry as SQL expressions, in stages: each stage reads the columns of those before it.

Stages keep every expression small, so that Spark compiles them into one generated function each, and read the same in
any SQL dialect with greatest, least, abs, sqrt, acos and CASE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Fixed values of the contact test: relative size of single precision, how many of them a plane distance must exceed,
#: the least plane distance, the least normal length, and the floor of the direction cosine.
FLT_EPS, EPS_SCALE, LEAST_EPS, LEAST_NORMAL, LEAST_COSINE = 1.1920929e-7, 16.0, 1e-9, 1e-12, 1e-9
#: Pen length up to which a contact only grazes; longest quad edge that is kept; index distance that counts as adjacent.
TOUCH, MAX_EDGE, EXCLUDE = 0.0, 60.0, 1

Stage = list[tuple[str, str]]


def staged(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in stage])
    return df


def staged_sql(source: str, stages: list[Stage]) -> str:
    """The same stages as nested queries over a table or query."""
    for stage in stages:
        source = f"SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in stage)} FROM ({source})"
    return source


def distance(p: str, q: str) -> str:
    return f"sqrt(({p}x-{q}x)*({p}x-{q}x) + ({p}y-{q}y)*({p}y-{q}y) + ({p}z-{q}z)*({p}z-{q}z))"


def cross(a: str, b: str, c: str, out: str) -> Stage:
    """(b - a) x (c - a)"""
    d = lambda p, k: f"({p}{k}-{a}{k})"
    return [
        (f"{out}x", f"{d(b, 'y')}*{d(c, 'z')} - {d(b, 'z')}*{d(c, 'y')}"),
        (f"{out}y", f"{d(b, 'z')}*{d(c, 'x')} - {d(b, 'x')}*{d(c, 'z')}"),
        (f"{out}z", f"{d(b, 'x')}*{d(c, 'y')} - {d(b, 'y')}*{d(c, 'x')}"),
    ]


def length(n: str) -> str:
    return f"sqrt({n}x*{n}x + {n}y*{n}y + {n}z*{n}z)"


#: Corners of a quad, by row and column offset, and of its two triangles under either diagonal.
CORNERS = {"p00": (0, 0), "p01": (0, 1), "p10": (1, 0), "p11": (1, 1)}
TRIANGLES = {0: [("p00", "p01", "p11"), ("p00", "p11", "p10")], 1: [("p00", "p01", "p10"), ("p01", "p11", "p10")]}

LONGEST_EDGE = "greatest(" + ", ".join(distance(a, b) for a, b in [("p00", "p10"), ("p00", "p01"), ("p10", "p11"), ("p01", "p11"), ("p00", "p11"), ("p01", "p10")]) + ")"


def _area(diagonal: int) -> str:
    return " + ".join(f"0.5 * {length(f'd{diagonal}t{t}')}" for t in (0, 1))


#: Areas under both diagonals and their mean.
QUAD_AREA: list[Stage] = [
    [x for d in (0, 1) for t in (0, 1) for x in cross(*TRIANGLES[d][t], out=f"d{d}t{t}")],
    [("area_d0", _area(0)), ("area_d1", _area(1))],
    [("area", "0.5 * (area_d0 + area_d1)")],
]

_mid = lambda k: f"(p00{k} + p11{k} - p01{k} - p10{k})"
#: Twist (how far the diagonals miss each other), mean diagonal, aspect of the longest to the shortest side, planarity.
QUAD_METRICS: list[Stage] = [
    [("twist", f"0.5 * sqrt({_mid('x')}*{_mid('x')} + {_mid('y')}*{_mid('y')} + {_mid('z')}*{_mid('z')})"), ("diagonal", f"0.5 * ({distance('p00', 'p11')} + {distance('p01', 'p10')})")]
    + [(f"side{i}", distance(a, b)) for i, (a, b) in enumerate([("p00", "p01"), ("p01", "p11"), ("p11", "p10"), ("p10", "p00")])],
    [("longest", "greatest(side0, side1, side2, side3)"), ("shortest", "least(side0, side1, side2, side3)")],
    [("aspect", "CASE WHEN shortest > 0 THEN longest / shortest END"), ("planarity", "CASE WHEN diagonal > 0 THEN twist / diagonal END")],
]

#: Of one triangle with corners e, f, g: box, unit normal, and its length before.
TRIANGLE: list[Stage] = [
    [(f"lo_{k}", f"least(e{k}, f{k}, g{k})") for k in "xyz"] + [(f"hi_{k}", f"greatest(e{k}, f{k}, g{k})") for k in "xyz"] + cross("e", "f", "g", "raw"),
    [("nl", length("raw"))],
    [(f"n{k}", f"CASE WHEN nl >= {LEAST_NORMAL} THEN raw{k} / nl END") for k in "xyz"],
]


def _contact(touch: float) -> list[Stage]:
    """Verdict, penetration and angle of triangles p and q, of which all columns of TRIANGLE are known."""
    away = lambda n, p, o: f"{n}_nx*({p}x-{o}x) + {n}_ny*({p}y-{o}y) + {n}_nz*({p}z-{o}z)"
    near = lambda d: f"abs({d}) < eps"
    stages: list[Stage] = []
    boxes = " OR ".join(f"p_hi_{k} < q_lo_{k} - {touch} OR q_hi_{k} < p_lo_{k} - {touch}" for k in "xyz")
    sizes = ", ".join(f"abs({t}_{e}_{k})" for t in "pq" for e in ("lo", "hi") for k in "xyz")
    stages.append(
        [("apart", f"({boxes})"), ("thin", f"(p_nl < {LEAST_NORMAL} OR q_nl < {LEAST_NORMAL})"), ("eps", f"greatest({LEAST_EPS}, {EPS_SCALE} * {FLT_EPS} * greatest({sizes}))")]
        + [(f"dp{i}", away("q", f"p_{c}", "q_e")) for i, c in enumerate("efg")]
        + [(f"dq{i}", away("p", f"q_{c}", "p_e")) for i, c in enumerate("efg")]
        + [("dot", "p_nx*q_nx + p_ny*q_ny + p_nz*q_nz")]
        + [("Dx", "p_ny*q_nz - p_nz*q_ny"), ("Dy", "p_nz*q_nx - p_nx*q_nz"), ("Dz", "p_nx*q_ny - p_ny*q_nx")]
    )
    one_side = lambda s: f"(({s}0 > eps AND {s}1 > eps AND {s}2 > eps) OR ({s}0 < -eps AND {s}1 < -eps AND {s}2 < -eps))"
    flat = " AND ".join(near(f"dp{i}") for i in range(3))
    graze = " OR ".join(near(f"d{t}{i}") for t in "pq" for i in range(3))
    stages.append(
        [
            ("beside", f"({one_side('dp')} OR {one_side('dq')})"), ("flat", f"({flat})"), ("graze", f"({graze})"),
            ("angle", "acos(least(1.0, abs(dot))) * 180.0 / 3.14159265358979323846"),
            ("axis", "CASE WHEN abs(Dy) > abs(Dx) AND abs(Dy) > abs(Dz) THEN 1 WHEN abs(Dz) > abs(Dx) AND abs(Dz) > abs(Dy) THEN 2 ELSE 0 END"),
            ("drop", "CASE WHEN abs(p_ny) > abs(p_nx) AND abs(p_ny) > abs(p_nz) THEN 1 WHEN abs(p_nz) > abs(p_nx) AND abs(p_nz) > abs(p_ny) THEN 2 ELSE 0 END"),
        ]
    )
    alone = lambda s, i, j, k: f"(({s}{i} > 0 AND {s}{j} <= 0 AND {s}{k} <= 0) OR ({s}{i} < 0 AND {s}{j} >= 0 AND {s}{k} >= 0))"
    stages.append(
        [(f"{t}_apex", f"CASE WHEN {alone('d' + t, 0, 1, 2)} THEN 0 WHEN {alone('d' + t, 1, 2, 0)} THEN 1 WHEN {alone('d' + t, 2, 0, 1)} THEN 2 ELSE -1 END") for t in "pq"]
        + [(f"{t}{c}_t", f"CASE axis WHEN 0 THEN {t}_{c}x WHEN 1 THEN {t}_{c}y ELSE {t}_{c}z END") for t in "pq" for c in "efg"]
        + [(f"{t}{c}_s", f"CASE drop WHEN 0 THEN {t}_{c}y ELSE {t}_{c}x END") for t in "pq" for c in "efg"]
        + [(f"{t}{c}_r", f"CASE drop WHEN 2 THEN {t}_{c}y ELSE {t}_{c}z END") for t in "pq" for c in "efg"]
    )

    def end(t: str, step: int) -> str:
        arms = []
        for i in range(3):
            j = (i + step) % 3
            a, b = f"{t}{'efg'[i]}_t", f"{t}{'efg'[j]}_t"
            arms.append(f"WHEN {i} THEN {a} + ({b} - {a}) * (d{t}{i} / (d{t}{i} - d{t}{j}))")
        return f"CASE {t}_apex {' '.join(arms)} END"

    stages.append([(f"{t}_end{s}", end(t, s)) for t in "pq" for s in (1, 2)] + [("separate", _separate())])
    shared = "least(greatest(p_end1, p_end2), greatest(q_end1, q_end2)) - greatest(least(p_end1, p_end2), least(q_end1, q_end2))"
    cosine = f"abs(CASE axis WHEN 0 THEN Dx WHEN 1 THEN Dy ELSE Dz END) / {length('D')}"
    stages.append([("shared", shared), ("cosine", f"CASE WHEN {length('D')} > {LEAST_NORMAL} THEN {cosine} ELSE 1.0 END")])
    stages.append([("pen", f"shared / greatest(cosine, {LEAST_COSINE})")])
    verdict = f"""CASE WHEN apart THEN 'none' WHEN thin THEN 'grazing' WHEN beside THEN 'none'
      WHEN flat THEN CASE WHEN separate THEN 'none' ELSE 'coplanar' END WHEN graze THEN 'grazing'
      WHEN p_apex < 0 OR q_apex < 0 THEN 'grazing' WHEN shared <= 0 THEN 'none' WHEN pen <= {touch} THEN 'grazing' ELSE 'transverse' END"""
    stages.append([("verdict", verdict)])
    reached = "verdict = 'transverse' OR (verdict = 'grazing' AND NOT thin AND NOT graze AND p_apex >= 0 AND q_apex >= 0)"
    stages.append([("penetration", f"CASE WHEN {reached} THEN pen ELSE 0.0 END"), ("angle_deg", "CASE WHEN thin THEN 0.0 ELSE angle END")])
    return stages


def _separate() -> str:
    """Whether an edge of either triangle, in the plane that drops the normal's largest axis, has the other beyond it."""
    beyond = []
    for t, o in ("pq", "qp"):
        for i in range(3):
            a, b, c = (f"{t}{'efg'[(i + k) % 3]}" for k in range(3))
            side = lambda p: f"((-({b}_r-{a}_r))*({p}_s-{a}_s) + ({b}_s-{a}_s)*({p}_r-{a}_r))"  # noqa: E731,B023
            beyond.append("(" + " AND ".join(f"{side(o + k)} * {side(c)} <= -1e-12" for k in "efg") + ")")
    return "(" + " OR ".join(beyond) + ")"


CONTACT = _contact(TOUCH)


def contact(touch: float = TOUCH) -> list[Stage]:
    return _contact(float(touch))
