"""Each registered query against its SQL in DuckDB."""

import duckdb
import pytest

from cairn.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    want = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert norm(rows) == norm([tuple(r[i] for i in order) for r in want.fetchall()])
