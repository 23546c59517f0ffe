from __future__ import annotations

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_queries_against_sql(spark):
    import duckdb

    from threadquarry.llm import queries

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")

    def plain(rows, columns):
        return sorted(tuple("~" if r[c] is None else f"{r[c]:.9g}" if isinstance(r[c], float) else str(r[c]) for c in sorted(columns)) for r in rows)

    for name, query in queries.QUERIES.items():
        df = query(spark, DATA)
        got = [r.asDict() for r in df.collect()]
        if name in queries.SQL:
            cur = con.execute(queries.SQL[name])
            columns = [c[0] for c in cur.description]
            assert plain(got, columns) == plain([dict(zip(columns, r)) for r in cur.fetchall()], columns), name


def test_round_trip_is_empty(spark):
    from threadquarry.llm.queries import p8_round_trip

    assert p8_round_trip(spark, DATA).count() == 0
