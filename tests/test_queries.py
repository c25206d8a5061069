"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from codonlake.plans import chaining, coverage, files, homology, intervals, signals, splicing

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = {k: (m.QUERIES[k], m.ORACLES[k]) for m in (signals, intervals, files, chaining, homology, splicing, coverage) for k in m.QUERIES}


def plain(v):
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(PLANS))
def test_same_rows(spark, sf, duck, name):
    query, sql = PLANS[name]
    got = query(spark, sf)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    table = duck.execute(sql).to_arrow_table()
    assert sorted(table.column_names) == names
    want = sorted((tuple(plain(r[c]) for c in names) for r in table.to_pylist()), key=repr)
    assert rows == want
