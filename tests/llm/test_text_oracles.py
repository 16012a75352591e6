from pathlib import Path

import duckdb
import pytest
from keelgrid.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    with duckdb.connect() as db:
        for table in Path(FOLDER).glob("*.parquet"):
            db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
        found = db.execute(queries.ORACLES[name])
        columns = sorted(c[0] for c in found.description)
        places = [[c[0] for c in found.description].index(c) for c in columns]
        want = [tuple(r[k] for k in places) for r in found.fetchall()]
    assert sorted(got.columns) == columns
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
