"""One small case of each finding of the round, which the code before it failed."""

import duckdb


def _tables(tmp_path, **sql):
    """Parquet files of the given selects, as a folder of tables and as a DuckDB connection over them."""
    con = duckdb.connect()
    for name, select in sql.items():
        con.execute(f"COPY ({select}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return str(tmp_path), con


def test_bands_round_halves_as_the_sql_does(spark, tmp_path):
    from laminar.plans import catalog

    part = "SELECT 'a' AS p_brand, unnest([900.1, 900.3, 900.5])::DOUBLE AS p_retailprice, 15 AS p_size"
    folder, con = _tables(tmp_path, part=part)
    want = con.execute(catalog.ORACLES["band_structure"]).fetchall()
    assert [tuple(r) for r in catalog.QUERIES["band_structure"](spark, folder).select("g", "band", "lo", "hi", "n_values").collect()] == want
    assert want == [("a", 0, 135.01, 135.07, 3)]


def test_disagreement_asks_every_point(spark, tmp_path):
    from laminar.plans import catalog

    # 70 rows of 64 values on each of two labels, the second label's far off for its last rows only: 4,480 points an edge, not 4,000.
    rows = "SELECT i AS vec_id, i % 2 AS label, [((i * 37 + j * 11) % 101 / 100.0 + CASE WHEN i > 130 THEN i * 3 ELSE 0 END)::FLOAT FOR j IN range(64)] AS embedding FROM range(140) t(i)"
    folder, con = _tables(tmp_path, embeddings=rows)
    got = catalog.QUERIES["surface_disagreement"](spark, folder).select("a", "b", "n_points", "median", "p90", "mean").collect()
    want = con.execute(catalog.ORACLES["surface_disagreement"]).fetchall()
    assert len(got) == len(want) == 1 and got[0].n_points > 4000
    assert all(abs(x - y) < 2e-6 for x, y in zip(got[0], want[0]))
    assert "4000" not in catalog.ORACLES["surface_disagreement"]


def test_disagreement_places_past_an_int(spark):
    from laminar.operators import gaps

    cells = spark.range(144).selectExpr("explode(array(0L, 1L)) AS surface_id", "int(id / 12) AS v", "int(id % 12) AS u", "float(id % 12) AS x", "float(int(id / 12)) AS y", "float(0) AS z", "true AS valid")
    edges = spark.createDataFrame([(0, 1)], "a long, b long")
    assert gaps.disagreement(cells, edges, 1.0, 100_000_000).first().n_points == 144


def test_census_meets_in_blocks_as_by_brute_force(spark):
    import numpy as np

    from laminar.functions import kernels
    from laminar.operators import census

    rng = np.random.default_rng(3)
    at = rng.uniform(-70, 70, (300, 1, 3)) * [1, 0.3, 0.1]
    shape = at + rng.uniform(-9, 9, (300, 3, 3))
    ids = [(int(k % 3), int(k * 5), int(k % 7 * 5), 0) for k in range(300)]
    names = ", ".join(f"{c}{k} double" for c in "efg" for k in "xyz")
    rows = spark.createDataFrame([(*i, *map(float, t.ravel())) for i, t in zip(ids, shape)], f"surface_id long, v int, u int, t int, {names}")
    order = sorted(range(300), key=lambda k: ids[k])
    i, j = (np.array(order)[x] for x in np.triu_indices(300, 1))
    verdict, _, _ = kernels.contact(shape[i], shape[j], 0.0)
    want = {(*ids[a], *ids[b]): str(kernels.NAMES[v]) for a, b, v in zip(i, j, verdict) if v}
    for across in (None, True, False):
        found = census.contacts(rows, across=across)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r[c] for c in ("s1", "v1", "u1", "t1", "s2", "v2", "u2", "t2")): r.verdict for r in found.collect()}
        assert len(want) > 100 and got == {k: v for k, v in want.items() if across is None or (k[0] != k[4]) == across}
    n = sum(v == "transverse" for v in want.values())
    assert n == census.contacts(rows, only="transverse", keep=("s1",)).count() == sum(r.n for r in census.pair_counts(rows).collect())


def test_percentiles_without_gathering_a_group(spark):
    import numpy as np

    from laminar.operators import census

    angle = np.random.default_rng(1).uniform(5, 40, 500).astype(np.float32)
    found = spark.createDataFrame([(1, 0, "transverse", 1.0, float(a)) for a in angle], "s1 long, s2 long, verdict string, penetration float, angle_deg float")
    out = census.by_surface_pair(found)
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    r, want = out.first(), np.percentile(angle.astype(float).round(6), [50, 10, 90])
    assert np.allclose([r.angle_median, r.angle_p10, r.angle_p90], want, atol=1e-9) and abs(r.shallow_share - (angle < 10).mean()) < 1e-12


def test_sites_take_no_window(spark):
    from laminar.operators import regions

    rows = [(0, 0, 0, 0, 0, 9, 9, 0, 1.0), (0, 0, 1, 0, 0, 9, 9, 1, 2.0), (0, 0, 1, 0, 0, 9, 9, 0, 2.0)]
    out = regions.sites(spark.createDataFrame(rows, "s1 long, v1 int, u1 int, t1 int, s2 long, v2 int, u2 int, t2 int, penetration float"))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.v1, r.u1, r.v2, r.u2, r.at_v, r.at_u) for r in out.collect()] == [(0, 1, 9, 9, 4.5, 5.0)]


def test_greedy_cover_of_many_sets_in_one_component():
    import time

    import numpy as np

    from laminar.operators import excise

    rng, wide = np.random.default_rng(1), 400
    cover = [np.unique([x, x + 1, x + wide, x + wide + 1, y, y + 1, y + wide, y + wide + 1]) for x, y in ((int(c), int(c) + int(d)) for c, d in zip(rng.integers(0, wide * wide, 20_000), rng.integers(1, 9, 20_000)))]
    incident = {int(x): [(q, 1.0 + q % 7) for q in (x, x - 1, x - wide, x - wide - 1)] for x in np.unique(np.concatenate(cover)).tolist()}
    began = time.time()
    chosen = set(excise.greedy(cover, incident))
    assert all(chosen & set(c.tolist()) for c in cover) and time.time() - began < 20


def _ties(pairs):
    """Straight and swapped ties among (v1, u1, v2, u2), by brute force."""
    near = lambda p, q: abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1
    for i, p in enumerate(pairs):
        for j, q in enumerate(pairs):
            if i != j:
                if near(p[:2], q[:2]) and near(p[2:], q[2:]):
                    yield i, j, 0
                if near(p[:2], q[2:]) and near(p[2:], q[:2]):
                    yield i, j, 1


def test_touching_pairs_are_tied_in_blocks_as_by_brute_force(spark):
    import numpy as np

    from laminar.operators import events

    rng = np.random.default_rng(5)
    # Around a corner of the blocks of 32, with ends on both sides of it and some that touch each other; and far apart, at negative places.
    pairs = [tuple(map(int, x)) for x in np.unique(np.r_[rng.integers(28, 38, (260, 4)), rng.integers(-40, -28, (60, 4)), rng.integers(30, 33, (12, 4)) + [0, 0, 90, 0]], axis=0)]
    rows = rng.permutation(len(pairs)).tolist()
    ties, event, torn, swapped = list(_ties(pairs)), {}, set(), {}
    beside = {}
    for i, j, kind in ties:
        beside.setdefault(i, []).append((j, kind))
    for start in sorted(range(len(pairs)), key=rows.__getitem__):
        if start in event:
            continue
        event[start], swapped[start], queue = rows[start], 0, [start]
        while queue:
            i = queue.pop()
            for j, kind in beside.get(i, ()):
                if j not in event:
                    event[j], swapped[j] = rows[start], swapped[i] ^ kind
                    queue.append(j)
                elif swapped[j] != swapped[i] ^ kind:
                    torn.add(rows[start])
    table = spark.createDataFrame([(7, r, *p) for r, p in zip(rows, pairs)], "surface_id long, row long, v1 int, u1 int, v2 int, u2 int")
    found = events.oriented(table)
    got = {r.row: r for r in found.collect()}
    assert len(got) == len(pairs) and len(torn) > 0 and len(set(event.values()) - torn) > 20
    for k, r in enumerate(rows):
        assert got[r].event == event[k] and got[r].ambiguous == (event[k] in torn)
        assert event[k] in torn or got[r].swapped == bool(swapped[k])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan  # no surface is one group
    space = events.in_product_space(table.selectExpr("surface_id AS s1", "v1", "u1", "surface_id AS s2", "v2", "u2"))
    named = {(r.v1, r.u1, r.v2, r.u2): r.event for r in space.collect()}
    assert len({(named[p], event[k]) for k, p in enumerate(pairs)}) == len(set(event.values())) == len(set(named.values()))


def test_ties_within_a_block_are_no_rows(spark, monkeypatch):
    from laminar.operators import events

    settled, seen = events.components, []
    monkeypatch.setattr(events, "components", lambda edges, *a: seen.append(edges.count()) or settled(edges, *a))
    patch = spark.range(400).selectExpr("0L AS s1", "int(id / 20) AS v1", "int(id % 20) AS u1", "0L AS s2", "int(id / 20) AS v2", "int(id % 20 + 40) AS u2")
    assert events.in_product_space(patch).select("event").distinct().count() == 1 and seen == [0]


def test_a_large_component_of_a_cover_stays_in_arrays():
    import tracemalloc

    import numpy as np

    from laminar.operators import excise

    rng, wide = np.random.default_rng(1), 1 << 20
    v, u = rng.integers(0, 200, 10_000), rng.integers(0, 31, 10_000)
    cover = np.sort(np.stack([(v + dv) * wide + c + du for c in (u, 63 - u) for dv in (0, 1) for du in (0, 1)], 1), 1)
    vertex = np.unique(cover)
    by, quad = np.repeat(vertex, 4), np.repeat(vertex, 4) - np.tile([0, 1, wide, wide + 1], len(vertex))
    tracemalloc.start()
    whole = excise.Cover(np.arange(len(cover) + 1) * 8, cover.reshape(-1), by, quad, 1.0 + quad % 7)
    chosen = whole.chosen()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isin(cover, chosen).any(1).all() and peak < 20e6


def test_components_of_a_cover_are_named_by_their_least_set(spark):
    from laminar.operators import excise

    wide = 1 << 20
    quad = lambda v, u: [v * wide + u, v * wide + u + 1, (v + 1) * wide + u, (v + 1) * wide + u + 1]
    # 5 and 9 touch by corners of one quad only; 7 shares a vertex with 5 far off; 3 is alone.
    sets = {5: quad(3, 3) + quad(20, 20), 9: quad(5, 5) + quad(90, 90), 7: quad(21, 21) + quad(60, 60), 3: quad(8, 8) + quad(40, 40)}
    table = spark.createDataFrame([(c, sorted(x)) for c, x in sets.items()], "cid long, coverage array<long>")
    found = excise.independent(table)
    assert {r.cid: r.component for r in found.collect()} == {5: 5, 9: 5, 7: 5, 3: 3}
    areas = spark.createDataFrame([(0, v, u, 1.0 + (v * 7 + u) % 5) for v in range(100) for u in range(100)], "surface_id long, v int, u int, area double")
    got = excise.solve(found, areas).collect()
    assert all({r.vertex for r in got} & set(x) for x in sets.values()) and {r.method for r in got} == {"optimal"}
    assert excise.reduced(table).count() == 4 and "Join" not in excise.reduced(table)._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_boxes_meet_once_and_crowded_cells_in_parts(spark, tmp_path, monkeypatch):
    from laminar.operators import spatial
    from laminar.plans import catalog

    monkeypatch.setattr(spatial, "COPIES", 8, raising=False)
    monkeypatch.setattr(spatial, "CROWD", 64, raising=False)
    # 30 boxes of 20 copies each, one of 60 more, boxes of negative size inside of others, keys twice, nulls, and a volume of 4.49865.
    part = """SELECT 100000 + i % 30 * 27 + i // 30 * 1000 AS p_partkey, (i % 30 * 7 % 45 + 5)::INT AS p_size, 410.3 + i % 30 * 3.7 AS p_retailprice FROM range(600) t(i)
        UNION ALL SELECT 1000 + i * 1000, 20, 433.3 FROM range(60) t(i) UNION ALL SELECT 30730 + i * 1000, -3, 440.0 FROM range(4) t(i) UNION ALL SELECT i, 9, 412.5 FROM range(5) t(i)
        UNION ALL SELECT * FROM (VALUES (70500, 3, 0.0), (71500, 3, 0.00045), (NULL, 9, 412.5), (7, NULL, 412.5), (8, 9, NULL), (21003, 9, 'nan'::DOUBLE), (22003, 9, 'nan'::DOUBLE))"""
    folder, con = _tables(tmp_path, part=part)
    want = con.execute(catalog.ORACLES["box_overlap_join"]).fetchall()
    found = catalog.QUERIES["box_overlap_join"](spark, folder)
    plain = lambda rows: sorted((a, b, str(v)) for a, b, v in rows)
    assert plain(found.select("a_k", "b_k", "overlap").collect()) == plain(want) and len(want) > 15_000
    assert sum(b % 1000 == 730 for _, b, _ in want) > 100 and any(v != v for _, _, v in want) and (70500, 71500, 4.4986) in want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan  # candidate pairs are no rows


def test_pairs_of_boxes_are_made_a_bounded_number_at_a_time():
    import numpy as np

    from laminar.operators import spatial

    at, keys = np.array([0, 1000, 2000]), np.arange(2000)
    parts = list(spatial._expanded(np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([1.0, 2.0, 3.0]), at, keys, True))
    assert len(parts) > 4 and max(len(p) for p, _, _ in parts) <= spatial.ROWS
    a, b, v = (np.concatenate(x) for x in zip(*parts))
    assert len(np.unique(a * 2000 + b)) == len(a) == 2000 * 1999 // 2 and (a < b).all()
    assert (v == 1.0 + (a >= 1000) + (b >= 1000)).all()
