"""Every registered query against its SQL, on the driver's tables."""

import math
import os

import pytest

from plumbline.queries import collect

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = collect()


@pytest.fixture(scope="module")
def connection():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.9g}")
    return str(v)[:19].removesuffix(" 00:00:00") if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    result = connection.execute(ORACLES[name])
    order = [x[0] for x in result.description]
    assert sorted(order) == names
    want = sorted(repr([plain(r[order.index(c)]) for c in names]) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0


def test_estimators_cover_all_symbols_and_folds(spark):
    from plumbline.operators import walkforward as wf
    from plumbline.queries import walkforward as q

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test data")
    folds = {tuple(r) for r in wf.folds_of(q.full_dataset(spark, small)).select("symbol", "fold").collect()}
    got = {tuple(r) for r in QUERIES["mod_06_estimators"](spark, small).select("model", "symbol", "fold").distinct().collect()}
    assert got == {(m, *f) for m in {x[0] for x in got} for f in folds} and len({s for _, s, _ in got}) > 1
