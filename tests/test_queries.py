"""Every registered query of the engine against its SQL."""

from pathlib import Path

import duckdb
import pytest

from tidegraph.queries import ORACLE_SQL, QUERIES

SF_DIR = Path("/root/testdata/sf0.01")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def canonical(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return made


@pytest.mark.skipif(not SF_DIR.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    frame = QUERIES[name](spark, str(SF_DIR))
    columns = sorted(frame.columns)
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert canonical(tuple(r) for r in frame.select(*columns).collect()) == canonical(found)
