"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from winlaw.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def norm(v):
    if isinstance(v, float):
        return f"{v + 0.0:.5g}"
    return v if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(catalog.oracle_sql()[name])
    theirs = [x[0] for x in r.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    want = sorted(([norm(row[i]) for i in at] for row in r.fetchall()), key=str)
    assert sorted(([norm(row[c]) for c in cols] for row in df.collect()), key=str) == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_zoo_fits_every_problem_on_all_its_inputs(spark, monkeypatch):
    """The fits themselves are left out: which problems are run, and over which terms."""
    from unittest.mock import MagicMock

    from winlaw.plans import queries as q

    bases = []
    monkeypatch.setattr(q.generators, "windows", MagicMock())
    monkeypatch.setattr(q.generators, "sigma_for_rho", MagicMock())
    monkeypatch.setattr(q.stats, "window_stats", lambda w, basis, *a: bases.append([n for n, _ in basis]) or MagicMock())
    monkeypatch.setattr(q, "cluster", MagicMock())
    monkeypatch.setattr(q.evaluate, "aligned_accuracy", lambda *a: 1.0)
    got = [r["problem"] for r in q.q_zoo(spark, "").collect()]
    assert got == list(q.generators.PROBLEMS)
    assert [("x2" in b) for b in bases] == [p.dims == 2 for p in q.generators.PROBLEMS.values()]
