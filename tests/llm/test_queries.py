import math

import duckdb
import pytest

from flowlens.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows, names):
    return sorted((tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for _, v in sorted(zip(names, r, strict=True))) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)
