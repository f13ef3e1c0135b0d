"""Every query with SQL equals DuckDB on the smallest tables; the entry module works without the optional folder."""

import os
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


from pulsegrid import queries as Q  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, con, name):
    got = Q.queries()[name](spark, SF).toPandas()
    want = con.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    order = sorted(got.columns)
    rows = lambda d: sorted(map(str, d[order].astype({c: float for c in order if str(d[c].dtype).startswith(("int", "float"))}).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry_without_the_optional_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(f"cp -r {root}/__spark_entry__.py {root}/pulsegrid {tmp_path} && rm -rf {tmp_path}/pulsegrid/llm", shell=True, check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op1_') for k in q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
