"""Queries against their SQL, over the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["corpus_retention", "corpus_core_prefix", "corpus_recovery", "corpus_gates", "corpus_coverage", "corpus_drift", "rank_auc", "band_structure", "box_overlap_join", "mesh_quad_area", "tile_census", "event_sessions"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    cols = sorted(frame.columns)
    plain = lambda x: None if x is None or x != x else (round(float(x), 5) if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x))
    return sorted((tuple(plain(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    from laminar.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    want = want.astype(object).where(want.notna(), None)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_permutation_null_runs_a_thousand_rounds(spark):
    from laminar.plans import catalog

    r = catalog.QUERIES["permutation_null"](spark, SF).first()
    assert r.rounds == 1000 and 0 <= r.p <= 1
