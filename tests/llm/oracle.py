"""Compare a registered query with its oracle SQL in DuckDB over the same Parquet tables."""

import duckdb

from ledgerlens.sources.testdata import TABLES


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def same(spark, name, sf="/root/testdata/sf0.001"):
    from ledgerlens.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, sf)
    want = duck(sf).execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
