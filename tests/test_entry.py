from __future__ import annotations

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"


def plain(rows, columns):
    def one(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(tuple(one(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_core_queries_against_sql(spark):
    import duckdb

    from threadquarry.plans import hierarchy, inventory, pipelines, reference

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    for module in (hierarchy, reference, pipelines, inventory):
        for name, query in module.QUERIES.items():
            df = query(spark, DATA)
            got = [r.asDict() for r in df.collect()]
            if name not in module.SQL:
                continue
            cur = con.execute(module.SQL[name])
            columns = [c[0] for c in cur.description]
            want = [dict(zip(columns, r)) for r in cur.fetchall()]
            assert sorted(df.columns) == sorted(columns), name
            assert plain(got, columns) == plain(want, columns), name


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(DATA):
        assert e.entry(spark).count() > 0


def test_the_rest_stands_without_llm(tmp_path):
    """A copy without the subpackage for training data imports, registers its queries, and has nothing of that subpackage left."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/threadquarry", tmp_path / "threadquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, sys; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q); assert not [m for m in sys.modules if m.startswith('threadquarry.llm')]; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
