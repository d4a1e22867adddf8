import math

import duckdb
import pytest

from flowlens import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    if name not in queries.ORACLES:
        assert len(got.columns) and name
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(rows, got.columns) == plain(want.fetchall(), names)
