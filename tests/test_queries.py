"""Every registered query of the core against its SQL on the smallest tables."""

import duckdb
import pytest

from pathweave.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("orders", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    line = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(line(r[c] for c in columns) for r in got.collect()) == sorted(line(r[k] for k in order) for r in want.fetchall())


def test_custom_observer(spark, sf):
    rows = QUERIES["custom_observer_replay"](spark, sf).collect()
    assert len(rows) > 700 and all(r.changes >= 0 for r in rows)


def test_entry_points():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
