"""Every catalog query against its DuckDB form on the smallest tables."""

import math
import os

import duckdb
import pytest

from quakeloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(clean(r[k]) for k in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 2e-5 * max(1, abs(y))) for x, y in zip(a, b, strict=True)), (a, b)


def in_order(*values):
    return all(a <= b for a, b in zip(values, values[1:], strict=False))


def consistency(rows):
    (r,) = rows
    return 0 <= r.quantile <= 1 and in_order(r.p05_ll, r.mean_ll, r.p95_ll) and r.consistent == (r.quantile >= 0.05)


def linked(rows):
    """Each observation once, in an event that is named after one of its members; some are linked."""
    home = {r.event_id: r.canonical_id for r in rows}
    return len(home) == len(rows) == 1500 and all(home[c] == c for c in home.values()) and len(set(home.values())) < 1500


def fitted(rows):
    (r,) = rows
    return r.n >= 30 and (r.mu is None or 0 < r.k0 <= 100 and 0 <= r.alpha <= 5 and 1e-4 <= r.c <= 10 and 0.3 <= r.p <= 3 and math.isfinite(r.nll))


#: What must hold of the queries that SQL does not express; each has tests of its values elsewhere too.
CHECKS = {
    "canonical_links": linked,
    "canonical_links_stream": linked,
    "mc_entire_range": lambda rows: len(rows) == 1 and rows[0].n > 900 and 2.5 < rows[0].mc < 4 and in_order(rows[0].low, rows[0].high) and rows[0].beta > 0,
    "declustered": lambda rows: len(rows) > 300 and sum(r.parent_id is None for r in rows) == 1 and 0 < sum(r.is_background for r in rows) <= len(rows),
    "omori_families": lambda rows: all(r.n >= 1 and (r.k is None) == (r.n < 20) and (r.k is None or r.k > 0) for r in rows) and len({r.family for r in rows}) == len(rows),
    "omori_weighted": lambda rows: len(rows) == 1,
    "temporal_etas_fit": fitted,
    "spatiotemporal_etas_fit": lambda rows: len(rows) == 1 and (rows[0].mu is None) == (rows[0].n < 150),
    "likelihood_test": consistency,
    "space_test": consistency,
    "magnitude_test": consistency,
    "simulated_catalogs": lambda rows: rows[0].runs == 500 and in_order(rows[0].q5, rows[0].q50, rows[0].q95) and rows[0].mean > 0 and rows[0].largest > 3,
    "model_promotion": lambda rows: rows[0].decision in ("insufficient_evidence", "retain_champion", "promote") and rows[0].folds > 0 and (rows[0].low is None or in_order(rows[0].low, rows[0].mean, rows[0].high)),
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_values_without_sql(spark, name):
    assert CHECKS[name](QUERIES[name](spark, SF).collect())
